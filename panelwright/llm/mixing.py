"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; within a
source the documents in key order, cut at the source's word budget, are a
weighted sample without replacement.  Complete epochs come first.  DataFrame
operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm._storage import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that mark a text as less useful; the same class as in the quality rules.
SYMBOLS = "#*$%&|<>"
_BUCKET_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1, falling with the share of symbols; 1 for an empty or null text."""
    share = F.try_divide(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.length(text))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * F.coalesce(share, F.lit(0.0)))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from 48 bits of MD5: the same on every engine and every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, *, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """``__key, source, source_size`` to the same with ``target``.

    Sources take ``weights`` cyclically in code-point order, null last.  Each
    gets ``min(weight * level, cap * size)`` at the one level at which the
    targets sum to ``budget`` times all sizes; that is where repeated resharing
    of the excess ends.  In order of ``cap * size / weight`` the level implied
    by capping all earlier sources is largest exactly where capping stops.
    One row per source passes through these windows, whose time is linear in the
    number of sources.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    s = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    s = s.withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("__cap") / F.col("__w"), "__key")
    before = F.sum("__cap").over(filled.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__cap")
    falling = Window.orderBy((F.col("__cap") / F.col("__w")).desc(), F.col("__key").desc())
    rest = F.sum("__w").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("__level", (F.lit(float(budget)) * F.sum("source_size").over(whole) - before) / rest)
    return s.withColumn("target", F.least(F.col("__w") * F.max("__level").over(whole), F.col("__cap"))).drop("__w", "__cap", "__level")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, epochs, taken``.

    ``taken`` counts words: ``epochs`` complete passes over the source, then
    the documents with the smallest keys up to what is left of the target; the
    last of them is cut at the budget, so a source takes its target rounded
    down.  Documents with equal keys follow in order of id and size; equal
    rows are interchangeable.  A null or empty text has size 0 and is taken 0
    times; a null source is a source; a null id is an id like any other.  A
    document without words or a source of size 0 takes nothing.  An empty
    table gives an empty result.

    Only ids, keys and sizes are shuffled.  The running sum within a source is
    taken over key ranges of about 4000 rows each, offset by the sums of the
    earlier ranges, so no source, however large, meets in one task.
    """
    t = F.col(text)
    weight = quality_weight(t) if weight is None else weight
    drawn = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(t).alias("size"), (-F.log(uniform(F.col(doc_id), seed)) / weight).alias("__draw"))
    drawn = drawn.withColumn("__key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    drawn = materialize(drawn, "mix-draws")

    stats = drawn.groupBy("__key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"), F.avg("__draw").alias("__mean"))
    stats = materialize(targets(stats, weights=weights, budget=budget, cap=cap), "mix-targets")
    placed = drawn.drop("source").join(broadcast_if_small(stats), "__key")
    ranges = F.ceil(F.col("__rows") / F.lit(_BUCKET_ROWS))
    placed = placed.withColumn("__range", F.least(ranges - 1, F.floor(ranges * (F.lit(1.0) - F.exp(-F.col("__draw") / F.col("__mean"))))).cast("long"))

    earlier = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__key", "__range").agg(F.sum("size").alias("__sum")).select("__key", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__key", "__range").orderBy("__draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("__upto", F.sum("size").over(within)).join(offsets, ["__key", "__range"])

    size, whole = F.col("size"), F.col("source_size")
    epochs = F.coalesce(F.floor(F.try_divide(F.col("target"), whole)), F.lit(0)).cast("long")
    left = F.floor(F.col("target") - epochs * whole)
    part = F.greatest(F.lit(0), F.least(size, left - (F.col("__offset") + F.col("__upto") - size)))
    return summed.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * size + part).cast("long").alias("taken"))
