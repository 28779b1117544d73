"""Cross-sectional signal diagnostics: information coefficients, bucket returns, turnover, decay.

Every statistic of a cross-section is a window or an aggregate over
``(time[, horizon][, group])``: the two ranks, the group size and the
correlation share one shuffle on that key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import average_rank, missing, pearson, ratio
from panelwright.operators.transform import BucketSpec, bucket_frame
from panelwright.result import Evidence, Finding, Metadata, Severity, State, attrition


def aligned(signal: DataFrame, labels: DataFrame, *, time: str = "time", instrument: str = "instrument", value: str = "signal", label_time: str = "observation_time", label_value: str = "forward_return", extra: Sequence[str] = ()) -> DataFrame:
    """Inner join of signal and labels on (time, instrument): ``time, instrument, x, y[, horizon], *extra``."""
    left = signal.select(F.col(time).alias("time"), F.col(instrument).alias("instrument"), F.col(value).cast("double").alias("x"), *[F.col(c) for c in extra])
    horizon = [F.col("horizon")] if "horizon" in labels.columns else []
    right = labels.select(F.col(label_time).alias("time"), F.col("instrument"), F.col(label_value).cast("double").alias("y"), *horizon)
    return left.join(right, ["time", "instrument"])


def keys_of(panel: DataFrame, by: Sequence[str]) -> list[str]:
    return [*by, *(["horizon"] if "horizon" in panel.columns and "horizon" not in by else [])]


def ic_frame(panel: DataFrame, *, by: Sequence[str] = ("time",), method: str = "spearman", min_observations: int = 3) -> DataFrame:
    """Per group ``ic`` and ``n`` of the pairs ``x, y``; groups below ``min_observations`` are left out, constant ones have a null."""
    keys = keys_of(panel, by)
    pairs = panel.where(~(missing("x") | missing("y")))
    if method == "spearman":
        pairs = pairs.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), average_rank("x", keys).alias("x"), average_rank("y", keys).alias("y"))
    else:
        pairs = pairs.withColumns({"x0": F.col("x"), "y0": F.col("y")})
    varies = (F.min("x0") < F.max("x0")) & (F.min("y0") < F.max("y0"))
    return pairs.groupBy(*keys).agg(F.when(varies, pearson("x", "y")).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_observations)


def ic_summary_frame(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, deviation, ratio, t statistic and positive share of the defined coefficients."""
    n = F.count("ic")
    grouped = ic.groupBy(*by) if by else ic.groupBy()
    return grouped.agg(
        F.avg("ic").alias("mean_ic"),
        F.median("ic").alias("median_ic"),
        F.stddev_samp("ic").alias("std_ic"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(n)).alias("t_stat"),
        F.try_divide(F.count_if(F.col("ic") > 0).cast("double"), n.cast("double")).alias("positive_fraction"),
        n.alias("n_periods"),
    )


def group_availability(signal: DataFrame, by: Sequence[str], time: str, available_time: str | None) -> list[Finding]:
    """Groups must be known when the signal is; without a time of knowledge that is unknown."""
    if not [c for c in by if c != "time"]:
        return []
    if available_time is None:
        return [Finding("GROUP_AVAILABILITY_UNKNOWN", "Group availability unknown", "It is not known when the groups became known.", State.UNKNOWN, Severity.HIGH, "temporal_integrity")]
    C.require_columns(signal, [available_time], "signal")
    late = C.checked(signal, {"late": F.col(available_time).isNull() | (F.col(available_time) > F.col(time))})["late"]
    if late:
        raise DataContractError(f"{late} rows use a group before it was known")
    return [Finding("GROUP_AVAILABILITY_VERIFIED", "Groups known in time", "Every group was known at its observation.", State.PASS, Severity.INFO, "temporal_integrity")]


def _by(by: str | Sequence[str], time: str) -> list[str]:
    out = ["time" if c == time else c for c in C.columns_of(by)]
    if "time" not in out:
        raise MethodContractError("by must include the time")
    return out


def _pairs(signal, labels, by, time, instrument, value, label_time, label_value, null_policy):
    extra = [c for c in by if c not in ("time", "horizon")]
    rows = C.validate_panel(signal, time=time, instrument=instrument, numeric=[value], name="signal")
    C.require_columns(labels, [label_time, "instrument", label_value], "labels")
    C.require_unique(labels, [label_time, "instrument", *(["horizon"] if "horizon" in labels.columns else [])], "labels")
    C.require_same_types(signal, labels, [(time, label_time), (instrument, "instrument")])
    C.validate_label_intervals(labels, observation_time=label_time)
    panel = aligned(signal, labels, time=time, instrument=instrument, value=value, label_time=label_time, label_value=label_value, extra=extra).persist()
    counts = C.checked(panel, {"missing": missing("x") | missing("y")})
    if null_policy == "raise" and counts["missing"]:
        raise DataContractError(f"{counts['missing']} pairs have a missing value")
    return panel, rows, counts


def ic(signal: DataFrame, labels: DataFrame, *, method: str = "spearman", by: str | Sequence[str] = "time", time: str = "time", instrument: str = "instrument", signal_value: str = "signal", label_time: str = "observation_time", label_value: str = "forward_return", min_observations: int = 3, group_available_time: str | None = None, null_policy: str = "drop") -> Evidence:
    """Information coefficient per period (and horizon and group), with summaries.

    With groups beyond time, the overall series is recomputed from the pooled
    rows; it is not an average of the groups.
    """
    C.require_one_of(method, ("spearman", "pearson"), "method")
    C.require_one_of(null_policy, ("drop", "raise"), "null_policy")
    by = _by(by, time)
    findings = group_availability(signal, by, time, group_available_time)
    panel, rows, counts = _pairs(signal, labels, by, time, instrument, signal_value, label_time, label_value, null_policy)
    series = ic_frame(panel, by=by, method=method, min_observations=min_observations).persist()
    tables = {"ic_by_period": series.orderBy(*keys_of(panel, by))}
    overall = series
    if len(by) > 1:
        overall = ic_frame(panel, by=["time"], method=method, min_observations=min_observations)
        tables["ic_overall_by_period"] = overall.orderBy(*keys_of(panel, ["time"]))
    if "horizon" in panel.columns:
        tables["ic_by_horizon"] = ic_summary_frame(series, ["horizon"])
        if len(by) > 1:
            tables["ic_overall_by_horizon"] = ic_summary_frame(overall, ["horizon"])
    summary = ic_summary_frame(overall).collect()[0].asDict()
    undefined, kept = series.agg(F.count_if(F.col("ic").isNull()), F.sum("n")).collect()[0]
    used = counts["rows"] - counts["missing"]
    if undefined:
        findings.append(Finding("IC_UNDEFINED_GROUPS", "Undefined coefficients", f"{undefined} groups are constant in signal or return.", State.WARN, Severity.MEDIUM, "statistical_validity", {"groups": undefined}))
    if (kept or 0) < used:
        findings.append(Finding("IC_UNDERSIZED_GROUPS", "Undersized groups left out", f"{used - (kept or 0)} pairs lie in groups below {min_observations}.", State.WARN, Severity.LOW, "statistical_validity"))
    if summary["n_periods"] < 20:
        findings.append(Finding("IC_PERIOD_SUPPORT_LOW", "Few periods", f"Only {summary['n_periods']} periods have a coefficient.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    tables["data_attrition"] = [attrition("alignment", "missing value", input_rows=counts["rows"], retained_rows=used, policy=null_policy), attrition("groups", "undersized", input_rows=used, retained_rows=kept or 0, policy="drop")]
    metrics = summary | {"signal_rows": rows, "matched_rows_before_policy": counts["rows"], "excluded_rows": rows - (kept or 0), "undefined_groups": undefined}
    return Evidence(Metadata(f"signal.ic.{method}", parameters={"by": by, "min_observations": min_observations}), metrics, tuple(findings), tables)


def bucket_frames(panel: DataFrame, *, by: Sequence[str] = ("time",), top: int, bucket: str = "bucket") -> dict[str, DataFrame]:
    """``period``: mean, median and n per (group, bucket); ``spread`` per group; ``buckets`` over periods.

    The median of a bucket is the median of its period medians.
    """
    keys = keys_of(panel, by)
    pairs = panel.where(~missing("y"))
    period = pairs.groupBy(*keys, bucket).agg(F.avg("y").alias("mean_return"), F.median("y").alias("median_return"), F.count(F.lit(1)).alias("n"))
    spread = period.groupBy(*keys).agg((F.max(F.when(F.col(bucket) == top, F.col("mean_return"))) - F.max(F.when(F.col(bucket) == 1, F.col("mean_return")))).alias("spread"))
    over = [k for k in keys if k != "time"]
    buckets = period.groupBy(*over, bucket).agg(F.avg("mean_return").alias("mean_return"), F.median("median_return").alias("median_return"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_periods"))
    return {"period": period, "spread": spread, "buckets": buckets}


def monotonicity_frame(buckets: DataFrame, by: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """Spearman of bucket and mean return, and the share of rising neighbours; on one row a bucket."""
    one = buckets.withColumn("__all", F.lit(1))
    keys = [*by, "__all"]
    step = Window.partitionBy(*keys).orderBy(bucket)
    ranked = one.select(*keys, average_rank(bucket, keys).alias("a"), average_rank("mean_return", keys).alias("b"), (F.col("mean_return") - F.lag("mean_return").over(step)).alias("rise"))
    return ranked.groupBy(*keys).agg(pearson("a", "b").alias("spearman_monotonicity"), F.try_divide(F.count_if(F.col("rise") > 0).cast("double"), F.count("rise").cast("double")).alias("adjacent_order_fraction"), F.count(F.lit(1)).alias("n_buckets")).drop("__all")


def bucket_returns(bucketed: DataFrame, labels: DataFrame, *, by: str | Sequence[str] = "time", time: str = "time", instrument: str = "instrument", bucket: str = "bucket", label_time: str = "observation_time", label_value: str = "forward_return", null_policy: str = "drop") -> Evidence:
    """Returns per bucket and period, the spread of the top over the bottom, and monotonicity."""
    by = _by(by, time)
    C.require_columns(bucketed, [time, instrument, bucket], "bucketed")
    signal = bucketed.withColumn("__x", F.col(bucket).cast("double"))
    extra = [c for c in by if c not in ("time", "horizon")]
    panel = aligned(signal, labels, time=time, instrument=instrument, value="__x", label_time=label_time, label_value=label_value, extra=extra).withColumn("bucket", F.col("x").cast("int")).persist()
    counts = C.checked(panel, {"missing": missing("y")})
    if null_policy == "raise":
        C.refuse(counts, ["missing"], "labels")
    found = panel.agg(F.max("bucket"), F.countDistinct("bucket")).collect()[0]
    if not found[0]:
        raise DataContractError("no bucketed row has a label")
    frames = bucket_frames(panel, by=by, top=found[0])
    over = [k for k in keys_of(panel, by) if k != "time"]
    pooled = bucket_frames(panel, by=["time"], top=found[0]) if len(by) > 1 else frames
    pooled_over = [k for k in keys_of(panel, ["time"]) if k != "time"]
    mono = monotonicity_frame(frames["buckets"], over)
    head = monotonicity_frame(pooled["buckets"].groupBy("bucket").agg(F.avg("mean_return").alias("mean_return"))).collect()[0] if pooled_over else monotonicity_frame(pooled["buckets"]).collect()[0]
    spread = pooled["spread"].agg(F.avg("spread")).collect()[0][0]
    findings = []
    if head["spearman_monotonicity"] is None or abs(head["spearman_monotonicity"]) < 0.7:
        findings.append(Finding("BUCKET_MONOTONICITY_WEAK", "Bucket returns not monotonic", "Mean returns do not follow the bucket order.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    n = counts["rows"] - counts["missing"]
    tables = {"bucket_returns": frames["buckets"].orderBy(*over, "bucket"), "bucket_returns_by_period": frames["period"], "bucket_spread_by_period": frames["spread"], "bucket_monotonicity": mono, "data_attrition": [attrition("alignment", "missing label", input_rows=counts["rows"], retained_rows=n, policy=null_policy)]}
    if len(by) > 1:
        tables |= {"bucket_returns_overall": pooled["buckets"], "bucket_spread_overall_by_period": pooled["spread"]}
    metrics = {"mean_top_bottom_spread": spread, "spearman_monotonicity": head["spearman_monotonicity"], "adjacent_order_fraction": head["adjacent_order_fraction"], "n_buckets": found[1], "n_observations": n, "matched_rows_before_policy": counts["rows"], "excluded_rows": counts["missing"]}
    return Evidence(Metadata("signal.bucket_returns", parameters={"by": by}), metrics, tuple(findings), tables)


def quantiles(signal: DataFrame, labels: DataFrame, *, quantiles: int = 10, by: str | Sequence[str] = "time", time: str = "time", instrument: str = "instrument", signal_value: str = "signal", label_time: str = "observation_time", label_value: str = "forward_return", group_available_time: str | None = None, null_policy: str = "drop") -> Evidence:
    """Balanced quantile buckets within each group, undersized groups dropped, then their returns."""
    names = ["time" if c == time else c for c in C.columns_of(by)]
    findings = group_availability(signal, names, time, group_available_time)
    C.validate_panel(signal, time=time, instrument=instrument, numeric=[signal_value], name="signal")
    clean = C.numeric_policy(signal, [signal_value], null_policy)
    bucketed = bucket_frame(clean, BucketSpec.quantiles(quantiles), by=C.columns_of(by), value=signal_value, instrument=instrument)
    dropped = bucketed.where("bucket is null").count()
    found = bucket_returns(bucketed.where("bucket is not null"), labels, by=by, time=time, instrument=instrument, label_time=label_time, label_value=label_value, null_policy=null_policy)
    if dropped:
        findings.append(Finding("QUANTILE_UNDERSIZED_GROUPS", "Undersized groups dropped", f"{dropped} rows lie in groups below {quantiles}.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    if "BUCKET_MONOTONICITY_WEAK" in found.codes():
        findings.append(Finding("QUANTILE_MONOTONICITY_WEAK", "Quantile returns not monotonic", "Mean returns do not follow the quantile order.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    rename = {"bucket_returns": "quantile_returns", "bucket_returns_by_period": "quantile_returns_by_period", "bucket_spread_by_period": "spread_by_period", "bucket_monotonicity": "monotonicity"}
    tables = {rename.get(k, k): v.withColumnRenamed("bucket", "quantile") if isinstance(v, DataFrame) and "bucket" in v.columns else v for k, v in found.tables.items()}
    return Evidence(Metadata("signal.quantiles", parameters={"quantiles": quantiles, "by": names}), {**found.metrics, "n_quantiles": quantiles, "excluded_undersized_groups": dropped}, tuple(findings), tables)


def turnover_frames(signal: DataFrame, *, quantiles: int = 5, lags: Sequence[int] = (1,), time: str = "time", instrument: str = "instrument", value: str = "signal") -> dict[str, DataFrame]:
    """``rank``: per (time, lag) mean move of the rank fraction and autocorrelation; ``membership``: per (time, lag, bucket) turnover.

    A lag counts periods of the whole panel, so an instrument that is absent
    then has no pair.  The period index is ranked on the distinct times only.
    """
    clean = signal.where(~missing(value)).select(F.col(time).alias("time"), F.col(instrument).alias("instrument"), F.col(value).cast("double").alias("x"))
    periods = clean.select("time").distinct().withColumn("p", F.row_number().over(Window.orderBy("time")))
    size = F.count(F.lit(1)).over(Window.partitionBy("time"))
    order = F.row_number().over(Window.partitionBy("time").orderBy("x", "instrument"))
    ranked = clean.select("time", "instrument", "x", ((average_rank("x", ["time"]) - 1) / F.greatest(size - 1, F.lit(1))).alias("f"), (F.floor((order - 1) * F.lit(quantiles) / size) + 1).cast("int").alias("bucket"), size.alias("size"))
    ranked = ranked.join(periods, "time")
    shifts = F.explode(F.array(*[F.lit(int(k)) for k in lags])).alias("lag")
    now = ranked.select("*", shifts).withColumn("q", F.col("p") - F.col("lag"))
    then = ranked.select(F.col("p").alias("q"), "instrument", F.col("x").alias("x0"), F.col("f").alias("f0"), F.col("bucket").alias("b0"))
    both = now.join(then, ["q", "instrument"])
    rank = both.groupBy("time", "lag").agg(F.avg(F.abs(F.col("f") - F.col("f0"))).alias("rank_turnover"), pearson("x", "x0").alias("signal_autocorrelation"), F.count(F.lit(1)).alias("n_common"))
    common = both.where("bucket = b0").groupBy("time", "lag", "bucket").agg(F.count(F.lit(1)).alias("common"))
    sizes = ranked.groupBy("time", "p", "bucket").agg(F.count(F.lit(1)).alias("k"))
    grid = periods.select("time", "p", shifts, F.explode(F.sequence(F.lit(1), F.lit(quantiles))).alias("bucket")).where("p > lag").withColumn("q", F.col("p") - F.col("lag"))
    current = sizes.select("p", "bucket", F.col("k").alias("current"))
    previous = sizes.select(F.col("p").alias("q"), "bucket", F.col("k").alias("previous"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = grid.join(current, ["p", "bucket"], "left").join(previous, ["q", "bucket"], "left").join(common, ["time", "lag", "bucket"], "left")
    membership = joined.select("time", "lag", "bucket", F.try_divide((zero("current") + zero("previous") - 2 * zero("common")).cast("double"), (zero("current") + zero("previous")).cast("double")).alias("turnover"))
    return {"rank": rank, "membership": membership}


def turnover(signal: DataFrame, *, quantiles: int = 5, lags: Sequence[int] = (1,), time: str = "time", instrument: str = "instrument", signal_value: str = "signal", null_policy: str = "drop") -> Evidence:
    """Rank turnover, signal autocorrelation and bucket membership turnover at exact period lags."""
    lags = sorted(set(int(k) for k in lags))
    if 1 not in lags or min(lags) < 1 or quantiles < 2:
        raise MethodContractError("lags must be positive and include 1; at least two quantiles")
    rows = C.validate_panel(signal, time=time, instrument=instrument, numeric=[signal_value], name="signal")
    clean = C.numeric_policy(signal, [signal_value], null_policy).persist()
    frames = turnover_frames(clean, quantiles=quantiles, lags=lags, time=time, instrument=instrument, value=signal_value)
    rank = frames["rank"].persist()
    by_lag = rank.groupBy("lag").agg(F.avg("rank_turnover").alias("mean_rank_turnover"), F.avg("signal_autocorrelation").alias("mean_signal_autocorrelation"), F.count(F.lit(1)).alias("n_transitions"))
    head = {r["lag"]: r for r in by_lag.collect()}.get(1)
    used = clean.count()
    metrics = {"mean_rank_turnover": head and head["mean_rank_turnover"], "mean_signal_autocorrelation": head and head["mean_signal_autocorrelation"], "n_transitions": head["n_transitions"] if head else 0, "n_observations": used, "excluded_rows": rows - used}
    tables = {"turnover_by_period": rank.where("lag = 1").orderBy("time"), "turnover_by_period_lag": rank.orderBy("lag", "time"), "turnover_by_lag": by_lag.orderBy("lag"), "membership_turnover_by_period_lag": frames["membership"], "data_attrition": [attrition("signal", "missing value", input_rows=rows, retained_rows=used, policy=null_policy)]}
    return Evidence(Metadata("signal.turnover", parameters={"quantiles": quantiles, "lags": lags}), metrics, (), tables)


def decay_frame(panel: DataFrame, *, quantiles: int = 5, min_observations: int = 3) -> DataFrame:
    """Per horizon the coefficient summary and the mean and deviation of the quantile spread."""
    series = ic_frame(panel, min_observations=min_observations)
    summary = ic_summary_frame(series, ["horizon"])
    bucketed = bucket_frame(panel.where(~(missing("x") | missing("y"))), BucketSpec.quantiles(quantiles), by=["time", "horizon"], value="x", instrument="instrument").where("bucket is not null")
    spread = bucket_frames(bucketed, top=quantiles)["spread"].groupBy("horizon").agg(F.avg("spread").alias("mean_spread"), F.stddev_samp("spread").alias("std_spread"), F.count("spread").alias("n_spread_periods"))
    return summary.join(spread, "horizon", "full")


def decay(signal: DataFrame, labels: DataFrame, *, quantiles: int = 5, time: str = "time", instrument: str = "instrument", signal_value: str = "signal", label_time: str = "observation_time", label_value: str = "forward_return", null_policy: str = "drop") -> Evidence:
    """Coefficient and spread by horizon."""
    C.require_columns(labels, ["horizon"], "labels")
    panel, _, counts = _pairs(signal, labels, ["time"], time, instrument, signal_value, label_time, label_value, null_policy)
    bucketed = bucket_frame(panel.where(~(missing("x") | missing("y"))), BucketSpec.quantiles(quantiles), by=["time", "horizon"], value="x", instrument="instrument").where("bucket is not null")
    table = decay_frame(panel, quantiles=quantiles).orderBy(F.regexp_extract("horizon", r"\d+", 0).cast("int"))
    metrics = {"n_horizons": panel.select("horizon").distinct().count(), "n_observations": counts["rows"] - counts["missing"]}
    return Evidence(Metadata("signal.decay", parameters={"quantiles": quantiles}), metrics, (), {"ic_decay": table, "ic_by_period_horizon": ic_frame(panel), "spread_by_period_horizon": bucket_frames(bucketed, top=quantiles)["spread"]})

