"""Data contracts: schema checks without a job, data checks fused into one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import infinite, missing

TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.IntegralType, T.FractionalType)
IDENTIFIER_TYPES = (T.StringType, T.IntegralType)


def columns_of(value: str | Sequence[str] | None) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def require_columns(df: DataFrame, required: Iterable[str], name: str = "data") -> None:
    if absent := [c for c in required if c not in df.columns]:
        raise DataContractError(f"{name} lacks the columns {absent}")


def require_numeric(df: DataFrame, columns: Iterable[str], name: str = "data") -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise DataContractError(f"{name}.{c} must be numeric")


def require_type(df: DataFrame, column: str, types: tuple, name: str) -> None:
    if not isinstance(df.schema[column].dataType, types):
        raise DataContractError(f"{name}.{column} has the type {df.schema[column].dataType.simpleString()}")


def require_same_types(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> None:
    for a, b in pairs:
        if left.schema[a].dataType != right.schema[b].dataType:
            raise DataContractError(f"keys {a} and {b} differ in type")


def require_one_of(value: str, allowed: Iterable[str], name: str) -> None:
    if value not in set(allowed):
        raise MethodContractError(f"{name} must be one of {sorted(allowed)}, not {value!r}")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows that share their key with another row; the key is partially aggregated before the shuffle."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counted.agg(F.sum("n")).collect()[0][0] or 0


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "data") -> None:
    if n := duplicate_rows(df, keys):
        raise DataContractError(f"{name} has {n} rows with a repeated key {list(keys)}")


def checked(df: DataFrame, checks: Mapping[str, Column], name: str = "data") -> dict[str, int]:
    """Counts of all conditions and the rows, in one job."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]).collect()[0]
    return row.asDict()


def refuse(counts: Mapping[str, int], keys: Iterable[str], name: str = "data") -> None:
    if bad := {k: counts[k] for k in keys if counts[k]}:
        raise DataContractError(f"{name} breaks its contract: " + ", ".join(f"{k} in {v} rows" for k, v in bad.items()))


def validate_panel(df: DataFrame, *, time: str, instrument: str, numeric: Sequence[str] = (), name: str = "panel", unique: bool = True) -> int:
    """Columns, types, null keys and infinities; returns the number of rows."""
    require_columns(df, [time, instrument, *numeric], name)
    require_numeric(df, numeric, name)
    require_type(df, time, TIME_TYPES, name)
    require_type(df, instrument, IDENTIFIER_TYPES, name)
    counts = checked(df, {"null time": F.col(time).isNull(), "null instrument": F.col(instrument).isNull(), **{f"infinite {c}": infinite(c) for c in numeric}}, name)
    refuse(counts, [k for k in counts if k != "rows"], name)
    if unique:
        require_unique(df, [time, instrument], name)
    return counts["rows"]


def numeric_policy(df: DataFrame, columns: Sequence[str], policy: str) -> DataFrame:
    """Rows with null or NaN in ``columns`` are dropped, or refused; infinities are refused by ``validate_panel``."""
    require_one_of(policy, ("drop", "raise"), "null_policy")
    bad = None
    for c in columns:
        bad = missing(c) if bad is None else bad | missing(c)
    if bad is None:
        return df
    if policy == "raise":
        refuse(checked(df, {"missing value": bad}), ["missing value"])
    return df.where(~bad)


def validate_label_intervals(df: DataFrame, *, observation_time: str, name: str = "labels") -> None:
    """``label_start < label_end``, entry within, and no start before the observation."""
    found = {}
    if {"label_start", "label_end"} <= set(df.columns):
        found["empty interval"] = F.col("label_start") >= F.col("label_end")
        found["interval before observation"] = F.col("label_start") < F.col(observation_time)
        if "entry_time" in df.columns:
            found["entry outside interval"] = (F.col("entry_time") < F.col("label_start")) | (F.col("entry_time") > F.col("label_end"))
    if found:
        refuse(checked(df, found), found, name)
