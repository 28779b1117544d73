"""Tables that cut lineage, kept in the folder that the whole cluster shares.

All tables of an application lie in one folder named after it, which is removed
when the driver ends.  What is left after a crash can be removed by that name.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side of a join may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

_folders: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset and everything runs in one process, a temporary folder becomes it.

    On a cluster it has to be set: a folder of one machine would lose tables.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_folders() -> None:
    for path, spark in _folders.items():
        with suppress(Exception):  # the JVM may have ended first
            _delete(spark, path)


def _application_folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/panelwright-{spark.sparkContext.applicationId}"
    _folders.setdefault(path, spark)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later jobs neither recompute it nor depend on any executor's disk."""
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Tables of a run of several steps, of which each needs only what the one before returned.

    ``keep`` writes the result of a step and removes all tables written since
    the last ``keep`` and the result before, which nothing needs any longer.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._folder = spark, _application_folder(spark)
        self._before = self._tables()

    def _tables(self) -> set[str]:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        files = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        return {f"{self._folder}/{x.getPath().getName()}" for x in files.listStatus(path)} if files.exists(path) else set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self._folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        for old in self._tables() - self._before - {path}:
            _delete(self._spark, old)
        return self._spark.read.schema(df.schema).parquet(path)


def _bytes(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType)), F.lit(0).cast("long"))
        return F.greatest(F.size(column), F.lit(0)) * 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised side for broadcast when it has at most ``rows`` rows and about ``size`` bytes; otherwise leave the join to shuffle."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) + F.lit(8) for f in df.schema.fields), F.lit(0)).cast("long")
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).collect()[0]
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= size else df


def largest(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows with the largest values (from 1) of a count column, at most ``limit`` of them.

    The cut is taken from a histogram over 64 steps an octave and a whole step
    stays or goes, so the driver sees a few thousand numbers at most, however
    many partitions there are, and never a sorted run from each.
    """
    step = F.floor(F.log2(F.col(column)) * 64)
    total, cut = 0, None
    for r in sorted(df.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > limit:
            break
        cut = r["step"]
    return df.where(step >= cut) if cut is not None else df.limit(0)


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of ``key``; the hash is cut before the sort, so each partition passes on its share only."""
    n = df.count()
    hashed = F.xxhash64(key)
    if n > limit:
        df = df.where(F.pmod(hashed, F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, 1.1 * limit / n + 0.001))))
    return df.orderBy(F.pmod(hashed, F.lit(1 << 20)), hashed, *df.columns).limit(limit)
