"""Forward returns in trading observations."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import infinite
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State, attrition

#: Entry rule to (observations of delay, price column or null for the declared one).
ENTRIES = {None: (0, None), "current_close": (0, None), "next_close": (1, None), "next_open": (1, "open")}


def horizons_of(value: int | str | Sequence[int | str]) -> dict[str, int]:
    """``{"5D": 5}`` from 5, "5D" or several of them; a day is one trading observation."""
    out: dict[str, int] = {}
    for h in [value] if isinstance(value, int | str) else list(value):
        m = re.fullmatch(r"(\d+)D?", str(h))
        if not m or int(m[1]) < 1 or isinstance(h, bool):
            raise MethodContractError(f"horizon {h!r} is not a positive number of observations")
        out[f"{int(m[1])}D"] = int(m[1])
    if not out:
        raise MethodContractError("at least one horizon is needed")
    return out


def label_frame(prices: DataFrame, *, horizons: Sequence[int | str] | int | str, time: str = "time", instrument: str = "instrument", price: str = "close", entry: str | None = None, delisting_return: str | None = None) -> DataFrame:
    """The plan: one window over the instrument serves all horizons, which are then exploded in place."""
    lag, entry_price = ENTRIES[entry]
    w = Window.partitionBy(instrument).orderBy(time)
    bought = F.lead(F.col(entry_price or price).cast("double"), lag).over(w) if lag else F.col(entry_price or price).cast("double")
    entered = F.lead(time, lag).over(w) if lag else F.col(time)
    ends = []
    for name, h in horizons_of(horizons).items():
        sold = F.lead(F.col(price).cast("double"), h).over(w)
        r = F.try_divide(sold, bought) - 1
        if delisting_return:
            r = F.coalesce(r, F.lead(F.col(delisting_return).cast("double"), h).over(w))
        ends.append(F.struct(F.lit(name).alias("horizon"), F.lit(h).alias("h"), F.lead(time, h).over(w).alias("label_end"), r.alias("forward_return")))
    wide = prices.select(F.col(time).alias("observation_time"), F.col(instrument).alias("instrument"), entered.alias("entry_time"), bought.alias("bought"), F.array(*ends).alias("ends"))
    long = wide.select("observation_time", "instrument", "entry_time", "bought", F.explode("ends").alias("e"))
    return long.select("observation_time", F.col("observation_time").alias("label_start"), "entry_time", F.col("e.label_end").alias("label_end"), "instrument", F.col("e.horizon").alias("horizon"), F.when(F.col("bought").isNotNull(), F.col("e.forward_return")).alias("forward_return"))


def forward_returns(prices: DataFrame, *, horizons: Sequence[int | str] | int | str = (5,), time: str = "time", instrument: str = "instrument", price: str = "close", signal_time: str = "close", entry: str | None = "next_close", price_adjustment: str | None = None, delisting_return: str | None = None, missing: str = "drop", allow_same_close: bool = False) -> FrameResult:
    """``exit[t + h] / entry[t + lag] - 1`` per instrument; rows without a boundary are censored and counted."""
    if entry not in ENTRIES:
        raise MethodContractError(f"entry must be one of {sorted(k for k in ENTRIES if k)}")
    C.require_one_of(missing, ("drop", "raise"), "missing")
    lag, entry_price = ENTRIES[entry]
    if signal_time == "close" and lag == 0 and not allow_same_close:
        raise MethodContractError("a signal seen at the close cannot trade at the same close")
    spans = horizons_of(horizons)
    for name, h in spans.items():
        if h < lag or h == lag and entry_price is None and lag:
            raise MethodContractError(f"horizon {name} ends before it begins")
    used = list(dict.fromkeys([price, *([entry_price] if entry_price else [])]))
    C.require_columns(prices, [time, instrument, *used, *([delisting_return] if delisting_return else [])], "prices")
    C.require_numeric(prices, used, "prices")
    bad = {f"non-positive or infinite {c}": (F.col(c) <= 0) | infinite(c) for c in used}
    gap = None
    for c in used:
        m = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        gap = m if gap is None else gap | m
    counts = C.checked(prices, {"null key": F.col(time).isNull() | F.col(instrument).isNull(), **bad, "missing": gap})
    C.refuse(counts, ["null key", *bad], "prices")
    if missing == "raise" and counts["missing"]:
        raise DataContractError(f"prices has {counts['missing']} rows without a price")
    C.require_unique(prices, [time, instrument], "prices")
    clean = prices.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in used})
    full = label_frame(clean, horizons=list(spans.values()), time=time, instrument=instrument, price=price, entry=entry, delisting_return=delisting_return)
    labels = full.where("forward_return is not null and label_end is not null and entry_time is not null")
    coverage = labels.groupBy("horizon").agg(F.count(F.lit(1)).alias("n_labels"), F.countDistinct("instrument").alias("n_instruments"))
    total = labels.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instrument").alias("i")).collect()[0]
    findings = []
    if price_adjustment is None:
        findings.append(Finding("PRICE_ADJUSTMENT_UNKNOWN", "Price adjustment not declared", "Splits and dividends may appear as returns.", State.UNKNOWN, Severity.HIGH, "data_integrity"))
    if delisting_return is None:
        findings.append(Finding("DELISTING_RETURNS_UNKNOWN", "Delisting returns not supplied", "Returns of instruments that stop trading are censored.", State.UNKNOWN, Severity.HIGH, "data_integrity"))
    possible = counts["rows"] * len(spans)
    metrics = {"n_labels": total["n"], "n_instruments": total["i"], "n_horizons": len(spans), "source_missing_rows": counts["missing"], "censored_rows": possible - total["n"]}
    tables = {"coverage_by_horizon": coverage, "data_attrition": [attrition("labels", "boundary not observed", input_rows=possible, retained_rows=total["n"], policy=missing)]}
    meta = Metadata("labels.forward_returns", parameters={"horizons": list(spans), "entry": entry, "price": price, "signal_time": signal_time})
    return FrameResult(labels, Evidence(meta, metrics, tuple(findings), tables))
