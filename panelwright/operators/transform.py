"""Signal transforms: buckets as column expressions, neutralisation by grouped least squares."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import average_rank, missing
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State, attrition


@dataclass(frozen=True)
class BucketSpec:
    """How a cross-section is cut; built by the class methods."""

    kind: str
    count: int
    boundaries: tuple[float, ...] = ()
    tie_policy: str = "balanced"
    split_at: float | None = None
    equal_to: str = "upper"
    out_of_range: str = "raise"

    @classmethod
    def quantiles(cls, count: int = 10, *, edges: Sequence[float] | None = None, tie_policy: str = "balanced", split_at: float | None = None, equal_to: str = "upper") -> BucketSpec:
        """Equal or custom probability ranges; with ``split_at`` the values below and above it are cut apart."""
        C.require_one_of(tie_policy, ("balanced", "preserve"), "tie_policy")
        C.require_one_of(equal_to, ("upper", "lower"), "equal_to")
        cuts = [k / count for k in range(count + 1)] if edges is None else [float(e) for e in edges]
        if len(cuts) < 3 or cuts[0] != 0 or cuts[-1] != 1 or any(b <= a for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
            raise MethodContractError("probability edges must rise strictly from 0 to 1 over at least two buckets")
        if split_at is not None and edges is not None:
            raise MethodContractError("custom edges and a split exclude one another")
        return cls("quantiles", len(cuts) - 1, tuple(cuts), tie_policy, split_at, equal_to)

    @classmethod
    def equal_width(cls, count: int) -> BucketSpec:
        if count < 2:
            raise MethodContractError("at least two buckets are needed")
        return cls("equal_width", count)

    @classmethod
    def edges(cls, edges: Sequence[float], *, out_of_range: str = "raise") -> BucketSpec:
        C.require_one_of(out_of_range, ("raise", "drop"), "out_of_range")
        cuts = [float(e) for e in edges]
        if len(cuts) < 3 or any(b <= a for a, b in zip(cuts[:-1], cuts[1:], strict=True)):
            raise MethodContractError("edges must rise strictly over at least two buckets")
        return cls("edges", len(cuts) - 1, tuple(cuts), out_of_range=out_of_range)

    @classmethod
    def threshold(cls, value: float, *, equal_to: str = "upper") -> BucketSpec:
        C.require_one_of(equal_to, ("upper", "lower"), "equal_to")
        return cls("threshold", 2, (float(value),), equal_to=equal_to)


def _above(position: Column, interior: Sequence[float]) -> Column:
    """1 plus the number of interior boundaries at or below ``position``."""
    bounds = F.array(*[F.lit(float(b)) for b in interior]) if interior else F.array().cast("array<double>")
    return F.lit(1) + F.size(F.filter(bounds, lambda b: position >= b))


def _side(x: Column, at: float, equal_to: str) -> Column:
    return ((x >= at) if equal_to == "upper" else (x > at)).cast("int")


def bucket_frame(signal: DataFrame, spec: BucketSpec, *, by: Sequence[str], value: str = "signal", instrument: str = "instrument", ascending: bool = True) -> DataFrame:
    """``signal`` with ``bucket`` from 1; null in groups that cannot be cut and for values out of range.

    Values are taken as present.  One shuffle on ``by`` serves size, ranks and
    extremes.  A quantile position is ``(rank - 1/2) / size``: of the row in
    (value, instrument) order when balanced, of the average rank when ties are
    preserved.  It differs from ntile, which fills the first buckets up.
    """
    by, x = list(by), F.col(value).cast("double")
    key = x if ascending else -x
    out = signal
    if spec.kind == "quantiles":
        part = list(by)
        if spec.split_at is not None:
            out = out.withColumn("__side", _side(x, spec.split_at, spec.equal_to))
            part = [*by, "__side"]
        size = F.count(F.lit(1)).over(Window.partitionBy(*part))
        place = F.row_number().over(Window.partitionBy(*part).orderBy(key, instrument)) if spec.tie_policy == "balanced" else average_rank(key, part)
        position = (place - F.lit(0.5)) / size
        if spec.split_at is None:
            bucket = F.when(size >= spec.count, _above(position, spec.boundaries[1:-1]))
        else:
            low, high = spec.count // 2, spec.count - spec.count // 2
            first, second = (low, high) if ascending else (high, low)
            below = _above(position, [k / low for k in range(1, low)])
            above = F.lit(low) + _above(position, [k / high for k in range(1, high)])
            if not ascending:
                below = F.lit(low) + _above(position, [k / high for k in range(1, high)])
                above = _above(position, [k / low for k in range(1, low)])
            bucket = F.when((F.col("__side") == 0) & (size >= first), below).when((F.col("__side") == 1) & (size >= second), above)
    elif spec.kind == "equal_width":
        w = Window.partitionBy(*by)
        low, high = F.min(key).over(w), F.max(key).over(w)
        bucket = F.when(high > low, F.least(F.lit(spec.count), F.floor((key - low) * F.lit(spec.count) / (high - low)).cast("int") + 1))
    elif spec.kind == "edges":
        bucket = F.when(x.between(spec.boundaries[0], spec.boundaries[-1]), _above(x, spec.boundaries[1:-1]))
        bucket = bucket if ascending else F.lit(spec.count + 1) - bucket
    else:
        bucket = _side(x, spec.boundaries[0], spec.equal_to) + 1
        bucket = bucket if ascending else F.lit(3) - bucket
    return out.withColumn("bucket", bucket.cast("int")).drop("__side")


def bucketize(signal: DataFrame, *, spec: BucketSpec | None = None, by: str | Sequence[str] = "time", time: str = "time", instrument: str = "instrument", signal_value: str = "signal", available_time: str | None = None, ascending: bool = True, small_group_policy: str = "raise", null_policy: str = "drop") -> FrameResult:
    """Rows with their bucket; groups that cannot be cut raise or are dropped and counted."""
    from panelwright.operators.signal import group_availability

    spec = spec or BucketSpec.quantiles()
    by = C.columns_of(by)
    C.require_one_of(small_group_policy, ("raise", "drop"), "small_group_policy")
    C.require_columns(signal, by, "signal")
    if "bucket" in signal.columns:
        raise DataContractError("signal already has a column bucket")
    rows = C.validate_panel(signal, time=time, instrument=instrument, numeric=[signal_value], name="signal")
    findings = group_availability(signal, ["time" if c == time else c for c in by], time, available_time)
    clean = C.numeric_policy(signal, [signal_value], null_policy)
    full = bucket_frame(clean, spec, by=by, value=signal_value, instrument=instrument, ascending=ascending).persist()
    groups = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("bucket").alias("kept"), F.countDistinct("bucket").alias("k")).agg(F.sum("n"), F.sum("kept"), F.count_if(F.col("kept") == 0), F.count_if((F.col("k") < spec.count) & (F.col("kept") > 0)), F.max("k")).collect()[0]
    used, kept, bad, thin, effective = (v or 0 for v in groups)
    if spec.kind == "edges" and spec.out_of_range == "raise" and kept < used:
        raise DataContractError(f"{used - kept} values lie outside the edges")
    if spec.kind != "edges" and small_group_policy == "raise" and kept < used:
        raise DataContractError(f"{used - kept} rows lie in groups that cannot be cut")
    if kept < used:
        findings.append(Finding("BUCKET_UNDERSIZED_GROUPS", "Rows without a bucket", f"{used - kept} rows were dropped.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    if thin:
        findings.append(Finding("BUCKETS_EFFECTIVE_COUNT_REDUCED", "Fewer buckets than asked for", f"{thin} groups have empty buckets.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    out = full.where("bucket is not null")
    metrics = {"input_rows": rows, "retained_rows": kept, "excluded_rows": rows - kept, "excluded_numeric_rows": rows - used, "excluded_bucket_rows": used - kept, "excluded_groups": bad, "requested_buckets": spec.count, "effective_buckets": effective}
    tables = {"bucket_counts": out.groupBy("bucket").count().orderBy("bucket"), "data_attrition": [attrition("bucketize", "missing value", input_rows=rows, retained_rows=used, policy=null_policy), attrition("bucketize", "no bucket", input_rows=used, retained_rows=kept, policy=small_group_policy)]}
    return FrameResult(out, Evidence(Metadata("signal.bucketize", parameters={"kind": spec.kind, "by": by}), metrics, tuple(findings), tables))


def demean_frame(signal: DataFrame, *, by: Sequence[str], value: str = "signal", categories: Sequence[str] = ()) -> DataFrame:
    """Residual of categories only: the value less its mean within (``by``, categories); no Python."""
    return signal.withColumn("residual", F.col(value) - F.avg(value).over(Window.partitionBy(*by, *categories)))


def single_exposure_frame(signal: DataFrame, *, by: Sequence[str], value: str = "signal", exposure: str) -> DataFrame:
    """Residual of one exposure with an intercept, from windowed moments; no Python."""
    w = Window.partitionBy(*by)
    x, y = F.col(exposure).cast("double"), F.col(value).cast("double")
    slope = F.try_divide(F.covar_pop(x, y).over(w), F.var_pop(x).over(w))
    return signal.withColumn("residual", y - F.avg(y).over(w) - F.coalesce(slope, F.lit(0.0)) * (x - F.avg(x).over(w)))


def _design(pdf: pd.DataFrame, exposures: Sequence[str], categorical: Sequence[str], intercept: bool) -> tuple[np.ndarray, list[str]]:
    cols, names = ([np.ones(len(pdf))], ["intercept"]) if intercept else ([], [])
    for c in exposures:
        if c in categorical:
            for level in sorted(pdf[c].unique())[1:]:
                cols.append((pdf[c] == level).to_numpy(dtype=float))
                names.append(f"{c}={level}")
        else:
            cols.append(pdf[c].to_numpy(dtype=float))
            names.append(c)
    return np.column_stack(cols) if cols else np.zeros((len(pdf), 0)), names


def neutralize(signal: DataFrame, *, exposures: str | Sequence[str], exposure_data: DataFrame | None = None, categorical: Sequence[str] = (), by: str | Sequence[str] = "time", signal_time: str = "time", exposure_time: str = "time", instrument: str = "instrument", signal_value: str = "signal", weight: str | None = None, available_time: str | None = None, intercept: bool = True, min_residual_df: int = 2, insufficient_policy: str = "raise", null_policy: str = "drop") -> FrameResult:
    """Weighted least-squares residual of the signal on its exposures within each group.

    Rank-deficient groups take the minimum-norm solution.  Groups with fewer
    residual degrees of freedom than asked raise or are dropped.  Each group is
    one cross-section, whose size does not grow with the history; it is solved
    once, from the columns of the regression alone, and its coefficients meet
    the rows in a join.
    """
    exposures, by = C.columns_of(exposures), C.columns_of(by)
    C.require_one_of(insufficient_policy, ("raise", "drop"), "insufficient_policy")
    if not exposures or not set(categorical) <= set(exposures):
        raise MethodContractError("categorical exposures must be among the exposures")
    rows = C.validate_panel(signal, time=signal_time, instrument=instrument, numeric=[signal_value], name="signal")
    data = signal
    if exposure_data is not None:
        C.require_columns(exposure_data, [exposure_time, instrument, *exposures], "exposure_data")
        C.require_unique(exposure_data, [exposure_time, instrument], "exposure_data")
        other = exposure_data.select(F.col(exposure_time).alias(signal_time), instrument, *[c for c in (*exposures, *([available_time] if available_time else []), *([weight] if weight and weight in exposure_data.columns else []))])
        data = signal.drop(*exposures).join(other, [signal_time, instrument])
    C.require_columns(data, [*by, *exposures, *([weight] if weight else [])], "signal")
    if available_time is not None:
        C.refuse(C.checked(data, {"exposure known too late": F.col(available_time).isNull() | (F.col(available_time) > F.col(signal_time))}), ["exposure known too late"])
    numeric = [signal_value, *[c for c in exposures if c not in categorical], *([weight] if weight else [])]
    matched = data.count()
    clean = C.numeric_policy(data, numeric, null_policy).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in categorical], F.lit(True))).persist()
    if weight:
        C.refuse(C.checked(clean, {"non-positive weight": F.col(weight) <= 0}), ["non-positive weight"])
    keys = ", ".join(f"`{c}` {clean.schema[c].dataType.simpleString()}" for c in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, names = _design(pdf, exposures, categorical, intercept)
        y = pdf[signal_value].to_numpy(dtype=float)
        w = np.sqrt(pdf[weight].to_numpy(dtype=float)) if weight else np.ones(len(y))
        beta, _, rank, s = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)
        total = float((w * w * (y - np.average(y, weights=w * w)) ** 2).sum())
        r2 = 1 - float((w * w * (y - x @ beta) ** 2).sum()) / total if total > 0 else None
        condition = float(s[0] / s[-1]) if len(s) and s[-1] > 0 else None
        row = {c: pdf[c].iloc[0] for c in by} | {"n": len(pdf), "parameters": len(beta), "rank": int(rank), "residual_df": len(pdf) - int(rank), "condition_number": condition, "weighted_r_squared": r2, "names": names, "beta": [float(b) for b in beta]}
        return pd.DataFrame([row])

    needed = clean.select(*by, *[F.col(c).cast("string").alias(c) if c in categorical else F.col(c) for c in dict.fromkeys([signal_value, *exposures, *([weight] if weight else [])]) if c not in by])
    diag = needed.groupBy(*by).applyInPandas(solve, f"{keys}, n long, parameters long, rank long, residual_df long, condition_number double, weighted_r_squared double, names array<string>, beta array<double>").persist()
    found = F.map_from_arrays("names", "beta")
    part = lambda key: F.coalesce(F.try_element_at(F.col("__beta"), key), F.lit(0.0))
    fit = part(F.lit("intercept"))
    for c in exposures:
        fit = fit + (part(F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) if c in categorical else part(F.lit(c)) * F.col(c).cast("double"))
    solved = diag.where(F.col("residual_df") >= min_residual_df).select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], found.alias("__beta"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)])
    kept = clean.join(solved, same).withColumn("residual", F.col(signal_value).cast("double") - fit).drop("__beta", *[f"__by{k}" for k in range(len(by))])
    counts = diag.agg(F.sum("n"), F.count_if(F.col("rank") < F.col("parameters")), F.count(F.lit(1)), F.sum(F.when(F.col("residual_df") >= min_residual_df, F.col("n")).otherwise(0))).collect()[0]
    used, deficient, groups, retained = (v or 0 for v in counts)
    if retained < used and insufficient_policy == "raise":
        raise DataContractError(f"{used - retained} rows lie in groups with too few degrees of freedom")
    findings = [Finding("NEUTRALIZATION_RANK_DEFICIENT", "Rank-deficient groups", f"{deficient} groups take the minimum-norm solution.", State.WARN, Severity.MEDIUM, "statistical_validity")] if deficient else []
    metrics = {"input_signal_rows": rows, "matched_rows": matched, "retained_rows": retained, "excluded_rows": rows - retained, "rank_deficient_groups": deficient, "n_groups": groups}
    coefficients = diag.select(*by, F.explode(F.arrays_zip("names", "beta")).alias("c")).select(*by, F.col("c.names").alias("exposure"), F.col("c.beta").alias("coefficient"))
    tables = {"neutralization_diagnostics": diag.drop("names", "beta"), "neutralization_coefficients": coefficients, "data_attrition": [attrition("exposures", "unmatched", input_rows=rows, retained_rows=matched, policy="drop"), attrition("exposures", "missing value", input_rows=matched, retained_rows=used, policy=null_policy), attrition("groups", "degrees of freedom", input_rows=used, retained_rows=retained, policy=insufficient_policy)]}
    return FrameResult(kept, Evidence(Metadata("signal.neutralize", parameters={"exposures": exposures, "by": by}), metrics, tuple(findings), tables))

