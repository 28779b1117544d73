"""Regimes by prior quantiles, and outcomes by regime."""

from __future__ import annotations

from bisect import bisect_left, insort
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import missing, pearson
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State

#: Rows of a regime series; longer ones should be aggregated to periods first.
MAX_ROWS = 500_000


def threshold_frame(data: DataFrame, *, method: str, lower: float, upper: float, time: str = "time", value: str = "value", min_history: int = 20, window: int | None = None) -> DataFrame:
    """``threshold_lower, threshold_upper, history_count`` from observations strictly before each row, or from all where they are declared retrospective.

    A regime series is one aggregated series of at most ``MAX_ROWS`` periods,
    never a panel.  It is swept once in time order by one task, which keeps the
    history sorted, so every row costs two look-ups and one insertion.
    """
    if method == "retrospective":
        x = F.when(~missing(value), F.col(value).cast("double"))
        whole = Window.partitionBy()
        return data.withColumns({"threshold_lower": F.percentile(x, F.lit(lower)).over(whole), "threshold_upper": F.percentile(x, F.lit(upper)).over(whole), "history_count": F.count(x).over(whole)})

    def sweep(parts):
        pdf = pd.concat(list(parts), ignore_index=True).sort_values(time, kind="stable", ignore_index=True)
        x = pdf[value].to_numpy(dtype=float)
        kept: list[float] = []
        lows, highs, counts = [], [], []

        def at(q: float) -> float:
            k = q * (len(kept) - 1)
            a = int(k)
            return kept[a] + (k - a) * (kept[min(a + 1, len(kept) - 1)] - kept[a])

        for i in range(len(x)):
            good = len(kept) >= min_history and kept
            lows.append(at(lower) if good else None)
            highs.append(at(upper) if good else None)
            counts.append(len(kept))
            if x[i] == x[i]:
                insort(kept, x[i])
            if method == "rolling" and i >= window and x[i - window] == x[i - window]:
                kept.pop(bisect_left(kept, x[i - window]))
        yield pdf.assign(threshold_lower=lows, threshold_upper=highs, history_count=counts)

    schema = data.schema.simpleString()[7:-1] + ",threshold_lower:double,threshold_upper:double,history_count:bigint"
    return data.coalesce(1).mapInPandas(sweep, schema)


def label_frame(data: DataFrame, value: str = "value") -> DataFrame:
    x = F.col(value).cast("double")
    known = ~missing(value) & F.col("threshold_lower").isNotNull() & F.col("threshold_upper").isNotNull() & (F.abs(x) != float("inf"))
    return data.withColumn("regime", F.when(~F.coalesce(known, F.lit(False)), "unknown").when(x <= F.col("threshold_lower"), "low").when(x >= F.col("threshold_upper"), "high").otherwise("middle"))


def quantile_regimes(data: DataFrame, *, method: str = "expanding", lower: float = 0.33, upper: float = 0.67, min_history: int = 20, window: int | None = None, time: str = "time", value: str = "value", available_time: str | None = None) -> FrameResult:
    """Low, middle, high or unknown by thresholds that use only the past (or are fixed, or declared retrospective)."""
    C.require_one_of(method, ("fixed", "expanding", "rolling", "retrospective"), "method")
    if method == "fixed" and lower >= upper or method != "fixed" and not 0 < lower < upper < 1:
        raise MethodContractError("thresholds must rise; probabilities must lie in (0, 1)")
    if method == "rolling" and (not window or window < min_history):
        raise MethodContractError("a rolling window must hold the least history")
    C.require_columns(data, [time, value, *([available_time] if available_time else [])])
    C.require_unique(data, [time])
    rows = data.count()
    if method == "fixed":
        out = data.withColumns({"threshold_lower": F.lit(float(lower)), "threshold_upper": F.lit(float(upper)), "history_count": F.lit(None).cast("long")})
    elif rows > MAX_ROWS:
        raise DataContractError(f"{rows} rows; aggregate to at most {MAX_ROWS} periods first")
    else:
        out = threshold_frame(data, method=method, lower=lower, upper=upper, time=time, value=value, min_history=min_history, window=window)
    out = label_frame(out, value).persist()
    late = C.checked(data, {"late": F.col(available_time) > F.col(time)})["late"] if available_time else 0
    unknown = out.where("regime = 'unknown'").count()
    findings = []
    if method == "retrospective":
        findings.append(Finding("REGIME_RETROSPECTIVE_THRESHOLDS", "Thresholds see the future", "Quantiles are of the whole series.", State.WARN, Severity.HIGH, "bias"))
    else:
        findings.append(Finding("REGIME_THRESHOLDS_POINT_IN_TIME", "Thresholds see the past only", "Each threshold uses earlier rows.", State.PASS, Severity.INFO, "bias"))
    if late:
        findings.append(Finding("REGIME_SOURCE_NOT_AVAILABLE", "Source known too late", f"{late} values were not known in time.", State.FAIL, Severity.HIGH, "bias"))
    if unknown:
        findings.append(Finding("REGIME_UNCLASSIFIED_ROWS", "Unclassified rows", f"{unknown} rows.", State.UNKNOWN, Severity.LOW, "robustness"))
    metrics = {"row_count": rows, "classified_rows": rows - unknown, "unknown_rows": unknown, "future_available_rows": late}
    return FrameResult(out, Evidence(Metadata("regime.quantile_regimes", parameters={"method": method, "lower": lower, "upper": upper}), metrics, tuple(findings), {"regimes": out.groupBy("regime").count().orderBy("regime")}))


def analysis_frame(data: DataFrame, *, time: str = "time", regime: str = "regime", outcome: str = "outcome", annualization: float = 1.0) -> DataFrame:
    """Per regime: counts, lag-1 effective size, moments, interval, drawdown, shares and leave-one-out total."""
    rows = data.select(F.col(regime).alias("regime"), F.col(time).alias("t"), F.when(~missing(outcome), F.col(outcome).cast("double")).alias("y"))
    w = Window.partitionBy("regime").orderBy("t")
    valid = rows.where("y is not null")
    stepped = valid.withColumns({"y0": F.lag("y").over(w), "cum": F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    peak = F.greatest(F.lit(0.0), F.max("cum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stepped = stepped.withColumn("down", F.col("cum") - peak)
    own = stepped.groupBy("regime").agg(F.count(F.lit(1)).alias("valid_count"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.sum("y").alias("total"), F.sum(F.abs("y")).alias("absolute_total"), F.try_divide(F.count_if(F.col("y") > 0).cast("double"), F.count(F.lit(1)).cast("double")).alias("hit_rate"), F.min("down").alias("max_drawdown"))
    lagged = stepped.where("y0 is not null").groupBy("regime").agg(pearson("y", "y0").alias("lag1"))
    raw = rows.groupBy("regime").agg(F.count(F.lit(1)).alias("raw_count"))
    out = raw.join(own, "regime", "left").join(lagged, "regime", "left")
    n = F.col("valid_count").cast("double")
    effective = F.when(F.col("lag1") > 0, F.greatest(F.lit(1.0), F.least(n, n / (1 + 2 * F.col("lag1"))))).otherwise(n)
    out = out.withColumn("effective_count", effective)
    half = F.lit(1.96) * F.col("std") / F.sqrt("effective_count")
    whole = Window.partitionBy()
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole).cast("double"))
    return out.withColumns({"sharpe": F.try_divide("mean", "std") * F.lit(sqrt(annualization)), "mean_lower": F.col("mean") - half, "mean_upper": F.col("mean") + half, "observation_share": share("valid_count"), "net_share": share("total"), "absolute_share": share("absolute_total"), "leave_one_out_total": F.sum("total").over(whole) - F.col("total")})


def regime_analysis(data: DataFrame, *, time: str = "time", regime: str = "regime", outcome: str = "outcome", classification_mode: str = "unknown", available_time: str | None = None, annualization: float = 1.0, min_observations: int = 20, concentration_threshold: float = 0.5, overlapping: bool = False) -> Evidence:
    """How outcomes are spread over regimes."""
    C.require_one_of(classification_mode, ("point_in_time", "retrospective", "unknown"), "classification_mode")
    C.require_columns(data, [time, regime, outcome, *([available_time] if available_time else [])])
    c = C.checked(data, {"missing": missing(outcome), "unknown": F.col(regime).isNull() | (F.col(regime) == "unknown"), "late": (F.col(available_time) > F.col(time)) if available_time else F.lit(False), "infinite": F.abs(F.col(outcome).cast("double")) == float("inf")})
    C.refuse(c, ["infinite"])
    table = analysis_frame(data, time=time, regime=regime, outcome=outcome, annualization=annualization).persist()
    rows = [r.asDict() for r in table.collect()]
    if not rows:
        raise DataContractError("no rows")
    good = [r for r in rows if r["absolute_total"] is not None]
    top = max(good, key=lambda r: (r["absolute_share"] or 0, str(r["regime"])), default=None)
    hhi = sum((r["absolute_share"] or 0) ** 2 for r in good) if good else None
    findings = []
    thin = [r["regime"] for r in rows if (r["valid_count"] or 0) < min_observations]
    if thin:
        findings.append(Finding("REGIME_INSUFFICIENT_EVIDENCE", "Thin regimes", f"{thin} have fewer than {min_observations} outcomes.", State.UNKNOWN, Severity.MEDIUM, "robustness"))
    if c["unknown"]:
        findings.append(Finding("REGIME_UNKNOWN_CLASSIFICATION", "Unclassified rows", f"{c['unknown']} rows.", State.UNKNOWN, Severity.MEDIUM, "robustness"))
    if classification_mode == "retrospective":
        findings.append(Finding("REGIME_ANALYSIS_RETROSPECTIVE", "Regimes see the future", "Declared retrospective.", State.WARN, Severity.HIGH, "bias"))
    if available_time is None:
        findings.append(Finding("REGIME_AVAILABILITY_UNKNOWN", "Availability unknown", "It is not known when regimes were known.", State.UNKNOWN, Severity.MEDIUM, "bias"))
    elif c["late"]:
        findings.append(Finding("REGIME_AVAILABILITY_LEAKAGE", "Regimes known too late", f"{c['late']} rows.", State.FAIL, Severity.HIGH, "bias"))
    else:
        findings.append(Finding("REGIME_AVAILABILITY_POINT_IN_TIME", "Regimes known in time", "All rows.", State.PASS, Severity.INFO, "bias"))
    if overlapping:
        findings.append(Finding("REGIME_LABELS_OVERLAP", "Outcomes overlap", "Overlapping outcomes are not independent.", State.WARN, Severity.MEDIUM, "robustness"))
    if top and (top["absolute_share"] or 0) > concentration_threshold and len(good) > 1:
        findings.append(Finding("REGIME_OUTCOME_CONCENTRATION", "Outcome in one regime", f"{top['regime']} holds {top['absolute_share']:.3f}.", State.WARN, Severity.HIGH, "robustness"))
    valid = c["rows"] - c["missing"]
    metrics = {"row_count": c["rows"], "valid_outcomes": valid, "excluded_outcomes": c["missing"], "regime_count": len(rows), "unknown_rows": c["unknown"], "future_available_rows": c["late"], "total_outcome": sum(r["total"] for r in good), "total_absolute_outcome": sum(r["absolute_total"] for r in good), "top_regime": top and top["regime"], "top_absolute_outcome_share": top and top["absolute_share"], "top_observation_share": max((r["observation_share"] or 0 for r in good), default=None), "absolute_outcome_hhi": hhi}
    return Evidence(Metadata("regime.analysis", parameters={"classification_mode": classification_mode}), metrics, tuple(findings), {"conditional_evidence": table, "observations": data.select(time, regime, outcome).limit(100)})

