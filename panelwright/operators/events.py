"""Event windows and responses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import missing
from panelwright.operators.pit import asof_frame, elapsed
from panelwright.operators.resample import default_block_length, stationary_matrix
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State, attrition


def price_index(prices: DataFrame, *, time: str = "time", instrument: str = "instrument", price: str = "close") -> DataFrame:
    """Prices with ``price_index`` from 0 and ``last_index`` per instrument."""
    w = Window.partitionBy(instrument)
    return prices.select(F.col(instrument).alias("instrument"), F.col(time).alias("price_time"), F.when(~missing(price), F.col(price).cast("double")).alias("price"), (F.row_number().over(w.orderBy(time)) - 1).alias("price_index"), (F.count(F.lit(1)).over(w) - 1).alias("last_index"))


def aligned_events(events: DataFrame, prices: DataFrame, *, anchor: str = "available_time", event_time: str = "event_time", available_time: str = "available_time", before: int = 5, after: int = 10) -> DataFrame:
    """One row per event: first priced observation at or after the anchor, its index, price and status."""
    indexed = price_index(prices)
    # The next priced observation is carried on every price row, so one sweep over the events finds it and the next row of any kind.
    later = Window.partitionBy("instrument").orderBy(F.desc("price_index")).rowsBetween(Window.unboundedPreceding, 0)
    carried = indexed.withColumn("priced", F.last(F.when(F.col("price").isNotNull(), F.struct("price_time", "price_index", "price")), ignorenulls=True).over(later))
    sides = events.select("event_id", "instrument", F.col(event_time).alias("event_time"), F.col(available_time).alias("available_time"), F.col(anchor).alias("anchor"))
    met = asof_frame(sides, carried.select("instrument", "price_time", "price_index", "last_index", "priced"), left_time="anchor", right_time="price_time", by=["instrument"], forward=True)
    priced = F.col("match.priced")
    first = met.select("event_id", "instrument", "event_time", "available_time", "anchor", priced["price_time"].alias("anchor_time"), priced["price_index"].alias("anchor_index"), priced["price"].alias("anchor_price"), F.when(priced.isNotNull(), F.col("match.last_index")).alias("last_index"), F.col("match.price_index").alias("eligible_index"))
    known = indexed.select("instrument").distinct().withColumn("has_prices", F.lit(True))
    out = first.join(known, "instrument", "left")
    status = F.when(F.col("anchor_index").isNotNull(), "aligned").when(F.col("has_prices"), "no_eligible_anchor").otherwise("no_instrument_prices")
    return out.select("event_id", "instrument", "event_time", "available_time", "anchor", "anchor_time", "anchor_index", "anchor_price", "last_index", (F.col("anchor_index") - F.col("eligible_index")).alias("skipped_null_prices"), status.alias("status"), (F.col("anchor_index") - before).alias("window_start"), (F.col("anchor_index") + after).alias("window_end"))


def window_frame(aligned: DataFrame, prices: DataFrame, *, before: int = 5, after: int = 10) -> DataFrame:
    """Offsets around each aligned event met with the price index by an equi-join; ``response`` is null where no price is."""
    indexed = price_index(prices).select("instrument", "price_index", "price_time", "price")
    offsets = aligned.where("status = 'aligned'").select("event_id", "instrument", "anchor_time", "anchor_index", "anchor_price", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    joined = offsets.withColumn("price_index", F.col("anchor_index") + F.col("offset")).join(indexed, ["instrument", "price_index"], "left")
    return joined.select("event_id", "instrument", "anchor_time", "offset", "price_time", "price", (F.try_divide("price", "anchor_price") - 1).alias("response"))


def cluster_frame(aligned: DataFrame) -> DataFrame:
    """Events of an instrument whose index windows overlap share a cluster; numbering restarts per instrument."""
    w = Window.partitionBy("instrument").orderBy("window_start", "window_end", "event_id")
    reach = F.max("window_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.col("window_start") > reach)).cast("int")
    rows = aligned.where("status = 'aligned'").withColumn("begins", begins)
    rows = rows.withColumn("cluster", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("overlaps", F.count(F.lit(1)).over(Window.partitionBy("instrument", "cluster")) > 1).drop("begins")


def event_windows(events: DataFrame, prices: DataFrame, *, anchor: str = "available_time", before: int = 5, after: int = 10, alignment: str = "next", overlap_policy: str = "raise", price_adjustment: str | None = None, event_time: str = "event_time", available_time: str = "available_time") -> FrameResult:
    """Price paths around events, anchored by default at the time each event became known."""
    C.require_one_of(anchor, ("available_time", "event_time"), "anchor")
    C.require_one_of(alignment, ("next",), "alignment")
    C.require_one_of(overlap_policy, ("raise", "keep"), "overlap_policy")
    if before < 0 or after < 0:
        raise MethodContractError("the window must not be negative")
    C.require_columns(events, ["event_id", "instrument", event_time, available_time], "events")
    C.require_columns(prices, ["time", "instrument", "close"], "prices")
    C.require_unique(events, ["event_id"], "events")
    C.require_unique(prices, ["time", "instrument"], "prices")
    C.refuse(C.checked(events, {"null key": F.col("event_id").isNull() | F.col("instrument").isNull() | F.col(anchor).isNull()}), ["null key"], "events")
    aligned = aligned_events(events, prices, anchor=anchor, event_time=event_time, available_time=available_time, before=before, after=after).persist()
    clusters = cluster_frame(aligned)
    paths = window_frame(aligned, prices, before=before, after=after).persist()
    per_event = paths.groupBy("event_id").agg(F.count_if(F.col("price_time").isNotNull() & F.col("price").isNull()).alias("missing_prices"), F.count_if(F.col("price_time").isNull() & (F.col("offset") < 0)).alias("left_censored"), F.count_if(F.col("price_time").isNull() & (F.col("offset") > 0)).alias("right_censored"))
    kind = aligned.schema["anchor"].dataType
    coverage = aligned.join(per_event, "event_id", "left").join(clusters.select("event_id", "cluster", "overlaps"), "event_id", "left").withColumn("anchor_delay", elapsed(F.col("anchor_time"), F.col("anchor"), kind)).persist()
    c = coverage.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "aligned").alias("aligned"), F.count_if(F.coalesce(F.col("left_censored") + F.col("right_censored") > 0, F.lit(False))).alias("censored"), F.count_if(F.coalesce("overlaps", F.lit(False))).alias("overlapping"), F.count_if(F.coalesce(F.col("anchor") < F.col("available_time"), F.lit(False))).alias("ahead"), F.coalesce(F.sum("skipped_null_prices"), F.lit(0)).alias("skipped")).collect()[0]
    if c["overlapping"] and overlap_policy == "raise":
        raise DataContractError(f"the windows of {c['overlapping']} events overlap")
    findings = []
    if c["ahead"]:
        findings.append(Finding("EVENT_RETROSPECTIVE_ANCHOR_LOOKAHEAD", "Anchored before known", f"{c['ahead']} events are anchored before they were known.", State.WARN, Severity.HIGH, "temporal_integrity"))
    if c["overlapping"]:
        findings.append(Finding("EVENT_WINDOWS_OVERLAP", "Windows overlap", f"{c['overlapping']} events share observations.", State.WARN, Severity.MEDIUM, "statistical_validity"))
    if c["censored"]:
        findings.append(Finding("EVENT_WINDOWS_CENSORED", "Windows cut off", f"{c['censored']} events lack observations.", State.WARN, Severity.MEDIUM, "data_integrity"))
    if price_adjustment is None:
        findings.append(Finding("EVENT_PRICE_ADJUSTMENT_UNKNOWN", "Price adjustment not declared", "Splits and dividends may appear as responses.", State.UNKNOWN, Severity.HIGH, "data_integrity"))
    metrics = {"n_events": c["n"], "aligned_events": c["aligned"], "n_window_rows": paths.count(), "censored_events": c["censored"], "overlapping_events": c["overlapping"], "retrospective_lookahead_events": c["ahead"], "skipped_null_anchor_prices": c["skipped"]}
    return FrameResult(paths, Evidence(Metadata("events.event_windows", parameters={"anchor": anchor, "before": before, "after": after}), metrics, tuple(findings), {"event_coverage": coverage, "data_attrition": [attrition("events", "not aligned", input_rows=c["n"], retained_rows=c["aligned"], policy="drop")]}))


def complete_cluster_frame(windows: DataFrame) -> DataFrame:
    """Sums and counts per (anchor time, offset) of the events whose whole path is priced: all that the bootstrap needs."""
    whole = windows.groupBy("event_id").agg(F.count_if(F.col("response").isNull()).alias("gaps")).where("gaps = 0").select("event_id")
    return windows.join(whole, "event_id", "left_semi").groupBy("anchor_time", "offset").agg(F.sum("response").alias("total"), F.count(F.lit(1)).alias("n"))


def event_response(windows: DataFrame | FrameResult, *, confidence: float = 0.95, resamples: int = 2000, expected_block_length: float | None = None, seed: int | None = None, min_clusters: int = 20) -> Evidence:
    """Mean response by offset with clustered bootstrap bands.

    Events are first summed per anchor time in Spark; only clusters by offsets
    reach the driver, where each replicate is a matrix product.
    """
    if not 0 < confidence < 1 or resamples < 100:
        raise MethodContractError("confidence must lie in (0, 1) and resamples be at least 100")
    df = windows.frame if isinstance(windows, FrameResult) else windows
    C.require_columns(df, ["event_id", "anchor_time", "offset", "response"], "windows")
    means = df.groupBy("offset").agg(F.avg("response").alias("mean_response"), F.count("response").alias("n")).orderBy("offset").toPandas()
    clusters: pd.DataFrame = complete_cluster_frame(df).toPandas()
    n_events = df.select("event_id").distinct().count()
    wide = clusters.pivot(index="anchor_time", columns="offset", values="total").sort_index() if len(clusters) else pd.DataFrame()
    counts = clusters.groupby("anchor_time")["n"].first().sort_index().to_numpy(dtype=float) if len(clusters) else np.zeros(0)
    k, complete = len(wide), int(counts.sum())
    base = {"n_events": n_events, "n_complete_events": complete, "n_clusters": k}
    record = [attrition("paths", "incomplete", input_rows=n_events, retained_rows=complete, policy="drop")]
    rows = [{"offset": int(r.offset), "mean_response": None if pd.isna(r.mean_response) else float(r.mean_response), "n": int(r.n)} for r in means.itertuples()]
    meta = Metadata("events.event_response", parameters={"confidence": confidence, "resamples": resamples}, seed=seed)
    if k < min_clusters:
        finding = Finding("EVENT_INFERENCE_SUPPORT_INSUFFICIENT", "Too few clusters", f"{k} of {min_clusters} clusters.", State.UNKNOWN, Severity.HIGH, "statistical_validity")
        return Evidence(meta, {**base, "successful_resamples": 0}, (finding,), {"event_response": rows, "data_attrition": record})
    rng = np.random.default_rng(np.random.SeedSequence(seed).spawn(1)[0])
    index = stationary_matrix(k, resamples=resamples, expected_block_length=expected_block_length or default_block_length(k), rng=rng)
    times = np.zeros((resamples, k))
    np.add.at(times, (np.repeat(np.arange(resamples), k), index.ravel()), 1)
    total = wide.to_numpy(dtype=float)
    center = total.sum(axis=0) / counts.sum()
    draws = (times @ total) / (times @ counts)[:, None]
    error = draws.std(axis=0, ddof=1)
    moving = error > 0
    critical = float(np.quantile(np.max(np.abs((draws - center)[:, moving]) / error[moving], axis=1), confidence)) if moving.any() else None
    low, high = np.quantile(draws, [(1 - confidence) / 2, (1 + confidence) / 2], axis=0)
    by_offset = {int(o): j for j, o in enumerate(wide.columns)}
    for r in rows:
        j = by_offset.get(r["offset"])
        band = j is not None and moving[j]
        r |= {"complete_mean": None if j is None else float(center[j]), "lower": float(low[j]) if band else None, "upper": float(high[j]) if band else None, "simultaneous_lower": float(center[j] - critical * error[j]) if band else None, "simultaneous_upper": float(center[j] + critical * error[j]) if band else None}
    early = [center[j] for o, j in by_offset.items() if o < 0]
    metrics = {**base, "successful_resamples": resamples, "simultaneous_critical_value": critical, "pre_event_mean_response": float(np.mean(early)) if early else None, "pre_event_max_absolute_mean": float(np.max(np.abs(early))) if early else None}
    finding = Finding("EVENT_CLUSTERED_INFERENCE_AVAILABLE", "Clustered bands", f"{k} clusters.", State.PASS, Severity.INFO, "statistical_validity")
    return Evidence(meta, metrics, (finding,), {"event_response": rows, "data_attrition": record})
