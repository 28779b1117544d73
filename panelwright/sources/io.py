"""Reading tables and mapping foreign schemas to canonical names."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright import contracts as C
from panelwright.errors import DataContractError
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State


def read(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or Arrow IPC by suffix; only the last passes through the driver."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if suffix in ("arrow", "feather", "ipc"):
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(path))
    raise DataContractError(f"no reader for {path}")


def as_spark(data: Any, spark: SparkSession, *, schema: Any = None, index: bool = False) -> DataFrame:
    """Spark frames as they are; pandas, Arrow, mappings, NumPy with names, and Arrow streams become frames."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.Series):
        data = data.to_frame(data.name or "value")
    if isinstance(data, pd.DataFrame):
        return spark.createDataFrame(data.reset_index() if index else data, schema)
    if isinstance(data, np.ndarray):
        if data.ndim == 2 and schema is None:
            raise DataContractError("a matrix needs column names")
        names = list(schema) if schema is not None else ["value"]
        return spark.createDataFrame(pd.DataFrame(data if data.ndim == 2 else data[:, None], columns=names))
    if isinstance(data, pa.Table):
        return spark.createDataFrame(data)
    if isinstance(data, Mapping):
        return spark.createDataFrame(pa.table(dict(data)))
    if hasattr(data, "__arrow_c_stream__"):
        return spark.createDataFrame(pa.table(data))
    raise DataContractError(f"cannot read {type(data).__name__}")


def summary(df: DataFrame) -> dict:
    """Columns and types, without a job."""
    return {"columns": df.columns, "types": [f.dataType.simpleString() for f in df.schema], "lazy": True, "source_type": "spark"}


def from_duckdb(relation: Any, spark: SparkSession, *, required: Iterable[str] = (), batch_size: int = 100_000, spool: str | None = None) -> FrameResult:
    """An executed relation by way of Arrow batches; no SQL is written or read.

    With ``spool``, a folder that the session reads too, each batch becomes a
    Parquet file there and the driver holds one batch at a time; without it,
    the relation has to fit the driver.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    if batch_size < 1:
        raise DataContractError("batches must hold a row")
    read = next((getattr(relation, name) for name in ("to_arrow_reader", "fetch_record_batch") if hasattr(relation, name)), None)
    if read is None:
        raise DataContractError("not a relation")
    reader = read(batch_size)
    if spool is None:
        table = reader.read_all()
        df, rows = spark.createDataFrame(table), table.num_rows
    else:
        folder, rows = f"{spool.rstrip('/')}/relation-{uuid.uuid4().hex}", 0
        os.makedirs(folder)
        for k, batch in enumerate(reader):
            pq.write_table(pa.Table.from_batches([batch]), f"{folder}/part-{k:06d}.parquet")
            rows += batch.num_rows
        pq.write_table(reader.schema.empty_table(), f"{folder}/part-schema.parquet")
        df = spark.read.parquet("file://" + os.path.abspath(folder))
    C.require_columns(df, required, "relation")
    columns = [{"column": f.name, "type": f.dataType.simpleString()} for f in df.schema]
    return FrameResult(df, Evidence(Metadata("adapters.duckdb_arrow", parameters={"batch_size": batch_size, "spooled": spool is not None}), {"column_count": len(columns), "row_count": rows}, (), {"columns": columns}))


def mapped(data: DataFrame, columns: Mapping[str, str], required: Iterable[str], name: str) -> DataFrame:
    """``canonical: source`` renames; order and other columns stay; a name that would occur twice is refused."""
    C.require_columns(data, columns.values(), name)
    if len(set(columns.values())) < len(columns):
        raise DataContractError("one source column is mapped twice")
    back = {s: c for c, s in columns.items()}
    names = [back.get(c, c) for c in data.columns]
    if len(set(names)) < len(names):
        raise DataContractError("the mapping makes a column name twice")
    out = data.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in data.columns])
    C.require_columns(out, required, name)
    return out


def _adapted(method: str, data: DataFrame, out: DataFrame, columns: Mapping[str, str], findings: tuple = (), count: bool = False, **extra: Any) -> FrameResult:
    metrics = {"source_column_count": len(data.columns), "normalized_column_count": len(out.columns), "row_count": out.count() if count else None, **extra}
    return FrameResult(out, Evidence(Metadata(method), metrics, findings, {"column_mapping": [{"canonical": c, "source": s} for c, s in columns.items()]}))


@dataclass(frozen=True)
class VendorSchema:
    schema_id: str
    columns: Mapping[str, str]
    required: tuple[str, ...]
    schema_version: int = 1
    availability: str = "unknown"
    revisions: str = "unknown"
    timezone: str | None = None
    timezone_columns: tuple[str, ...] = ()
    price_adjustment: str | None = None
    identifier_policy: str = "vendor_native"


def adapt_vendor(data: DataFrame, schema: VendorSchema, *, count: bool = False) -> FrameResult:
    C.require_one_of(schema.availability, ("point_in_time", "delayed", "unknown"), "availability")
    C.require_one_of(schema.revisions, ("versioned", "latest_only", "unknown"), "revisions")
    out = mapped(data, schema.columns, schema.required, schema.schema_id)
    if schema.availability == "point_in_time" and "available_time" not in out.columns:
        raise DataContractError("point-in-time data need available_time")
    if schema.revisions == "versioned" and not {"revision", "revision_id"} & set(out.columns):
        raise DataContractError("versioned data need a revision")
    for c in schema.timezone_columns:
        if not isinstance(out.schema[c].dataType, T.TimestampType):
            raise DataContractError(f"{c} has no time zone")
    return _adapted("adapters.vendor_schema", data, out, schema.columns, count=count)


#: What each kind of backtest artifact must carry.
BACKTEST_COLUMNS = {"returns": ("time", "return"), "trades": ("decision_time", "execution_time", "instrument", "side", "quantity", "price", "reference_price"), "positions": ("time", "instrument", "position")}


@dataclass(frozen=True)
class BacktestSemantics:
    returns: str
    return_frequency: str
    compounding: str
    position_timing: str
    execution_delay: str
    price_field: str
    price_adjustment: str
    costs: str
    borrow: str
    timezone: str
    calendar: str
    session: str
    missing_instruments: str
    delistings: str

    def __post_init__(self) -> None:
        if blank := [k for k in self.__dataclass_fields__ if not str(getattr(self, k)).strip()]:
            raise DataContractError(f"semantics must be declared: {blank}")


@dataclass(frozen=True)
class BacktestSchema:
    schema_id: str
    artifact: str
    columns: Mapping[str, str]
    semantics: BacktestSemantics
    schema_version: int = 1


def adapt_backtest(data: DataFrame, schema: BacktestSchema, *, count: bool = False) -> FrameResult:
    C.require_one_of(schema.artifact, BACKTEST_COLUMNS, "artifact")
    out = mapped(data, schema.columns, BACKTEST_COLUMNS[schema.artifact], schema.schema_id)
    return _adapted("adapters.backtest_artifact", data, out, schema.columns, count=count)


FACTOR_REQUIRED = ("time", "instrument", "signal")


@dataclass(frozen=True)
class FactorPanelSemantics:
    signal_observation: str = "unknown"
    decision_time_rule: str = "unknown"
    forward_return_entry: str = "unknown"
    forward_return_exit: str = "unknown"
    horizon_clock: str = "unknown"
    timezone: str = "unknown"
    calendar: str = "unknown"
    adjustment_policy: str = "unknown"
    group_availability: str = "unknown"
    imported_bucket_definition: str = "unknown"


@dataclass(frozen=True)
class FactorPanelSchema:
    schema_id: str
    columns: Mapping[str, str]
    semantics: FactorPanelSemantics = field(default_factory=FactorPanelSemantics)
    schema_version: int = 1


def adapt_factor_panel(data: DataFrame, schema: FactorPanelSchema, *, count: bool = False) -> FrameResult:
    out = mapped(data, schema.columns, FACTOR_REQUIRED, schema.schema_id)
    C.require_numeric(out, [c for c in ("signal", "forward_return", "weight") if c in out.columns], schema.schema_id)
    if "bucket" in out.columns and not isinstance(out.schema["bucket"].dataType, T.IntegralType):
        raise DataContractError("bucket must be a whole number")
    open_ = [k for k in schema.semantics.__dataclass_fields__ if getattr(schema.semantics, k) == "unknown"]
    findings = (Finding("FACTOR_PANEL_SEMANTICS_UNKNOWN", "Semantics not declared", f"{open_}.", State.UNKNOWN, Severity.MEDIUM, "temporal_integrity"),) if open_ else ()
    return _adapted("adapters.factor_panel", data, out, schema.columns, findings, count, unknown_semantics=len(open_))
