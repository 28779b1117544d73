"""Trading costs as column expressions; scenario surfaces from sufficient statistics.

A cost model gives one nullable column a trade; null is unknown and passes
through the sum.  Stress, break-even and capacity reduce the trades to a few
sums first; scenarios multiply those and never the trades.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from math import sqrt
from typing import Any, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import DataContractError, MethodContractError
from panelwright.functions.columns import infinite
from panelwright.result import Evidence, Finding, FrameResult, Metadata, Severity, State

REQUIRED = ("decision_time", "execution_time", "instrument", "side", "quantity", "price", "reference_price")


def size() -> Column:
    return F.abs(F.col("quantity").cast("double"))


def notional() -> Column:
    return size() * F.col("price").cast("double")


def canonical_trades(trades: DataFrame, *, columns: Mapping[str, str] | None = None, signed: bool = True) -> DataFrame:
    """Trades under their canonical names, validated in one aggregate."""
    names = {**{c: c for c in REQUIRED}, **(columns or {})}
    C.require_columns(trades, names.values(), "trades")
    clash = {v for k, v in names.items() if k != v}
    out = trades.select(*[F.col(s).alias(c) for c, s in names.items()], *[F.col(f"`{c}`") for c in trades.columns if c not in names and c not in clash])
    C.require_numeric(out, ["quantity", "price", "reference_price"], "trades")
    side = F.lower("side")
    bad = {
        "null field": reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REQUIRED]),
        "execution before decision": F.col("execution_time") < F.col("decision_time"),
        "non-positive price": (F.col("price") <= 0) | (F.col("reference_price") <= 0) | infinite("price") | infinite("reference_price"),
        "unknown side": ~side.isin("buy", "sell"),
        "infinite quantity": infinite("quantity"),
    }
    if signed:
        bad["sign of quantity"] = ((side == "buy") & (F.col("quantity") < 0)) | ((side == "sell") & (F.col("quantity") > 0))
    else:
        bad["negative quantity"] = F.col("quantity") < 0
    C.refuse(C.checked(out, bad, "trades"), bad, "trades")
    return out.withColumn("side", side)


class CostModel(Protocol):
    name: str
    version: str

    @property
    def required_fields(self) -> tuple[str, ...]: ...

    def cost(self, trades: DataFrame) -> Column: ...


def _known(value: str, available: str | None) -> Column:
    """A market value, null where it was not known by execution."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return F.when(F.coalesce(F.col(available) <= F.col("execution_time"), F.lit(False)), x) if available else x


@dataclass(frozen=True)
class CommissionModel:
    fixed: float = 0.0
    per_unit: float = 0.0
    bps: float = 0.0
    minimum: float = 0.0
    name: str = "commission"
    version: str = "1"
    required_fields: tuple[str, ...] = ()

    def cost(self, trades: DataFrame) -> Column:
        full = F.greatest(F.lit(self.fixed) + F.lit(self.per_unit) * size() + F.lit(self.bps / 1e4) * notional(), F.lit(self.minimum))
        return F.when(size() == 0, F.lit(0.0)).otherwise(full)


@dataclass(frozen=True)
class SpreadModel:
    """Half or all of an assumed or quoted spread."""

    bps: float | None = None
    crossing: str = "half"
    bid: str = "bid"
    ask: str = "ask"
    name: str = "spread"
    version: str = "1"

    @property
    def required_fields(self) -> tuple[str, ...]:
        return () if self.bps is not None else (self.bid, self.ask)

    def cost(self, trades: DataFrame) -> Column:
        C.require_one_of(self.crossing, ("half", "full"), "crossing")
        share = F.lit(self.bps / 1e4) if self.bps is not None else F.try_divide(F.col(self.ask).cast("double") - F.col(self.bid), F.col("reference_price").cast("double"))
        return notional() * share * F.lit(0.5 if self.crossing == "half" else 1.0)


@dataclass(frozen=True)
class SlippageModel:
    per_unit: float = 0.0
    bps: float = 0.0
    name: str = "slippage"
    version: str = "1"
    required_fields: tuple[str, ...] = ()

    def cost(self, trades: DataFrame) -> Column:
        return F.lit(self.per_unit) * size() + F.lit(self.bps / 1e4) * notional()


@dataclass(frozen=True)
class VolatilitySlippageModel:
    coefficient: float
    volatility: str = "volatility"
    available_time: str | None = None
    name: str = "volatility_slippage"
    version: str = "1"

    @property
    def required_fields(self) -> tuple[str, ...]:
        return tuple(c for c in (self.volatility, self.available_time) if c)

    def cost(self, trades: DataFrame) -> Column:
        return notional() * F.lit(self.coefficient) * _known(self.volatility, self.available_time)


@dataclass(frozen=True)
class ParticipationImpactModel:
    """Impact grows with the share of volume; a cap bounds the fraction paid."""

    coefficient: float
    exponent: float = 1.0
    cap: float | None = None
    max_participation: float | None = None
    volume: str = "adv"
    volatility: str = "volatility"
    available_time: str | None = None
    name: str = "participation_impact"
    version: str = "1"

    @property
    def required_fields(self) -> tuple[str, ...]:
        return tuple(c for c in (self.volume, self.volatility, self.available_time) if c)

    def participation(self) -> Column:
        return F.try_divide(size(), _known(self.volume, self.available_time))

    def fraction(self) -> Column:
        return F.lit(self.coefficient) * _known(self.volatility, self.available_time) * F.pow(self.participation(), F.lit(self.exponent))

    def cost(self, trades: DataFrame) -> Column:
        f = self.fraction()
        # least() skips nulls; an unknown fraction must stay unknown.
        return notional() * (f if self.cap is None else F.when(f.isNotNull(), F.least(f, F.lit(self.cap))))


def SquareRootImpactModel(coefficient: float, **settings: Any) -> ParticipationImpactModel:
    return ParticipationImpactModel(coefficient, **{"exponent": 0.5, "name": "square_root_impact", **settings})


@dataclass(frozen=True)
class BorrowCostModel:
    """Annual rate on short positions for the days held; a missing rate raises, stays unknown or is assumed."""

    missing_rate: str = "unknown"
    conservative_rate: float | None = None
    rate: str = "borrow_rate"
    days: str = "holding_days"
    name: str = "borrow"
    version: str = "1"

    @property
    def required_fields(self) -> tuple[str, ...]:
        return (self.rate, self.days)

    def cost(self, trades: DataFrame) -> Column:
        C.require_one_of(self.missing_rate, ("raise", "unknown", "conservative"), "missing_rate")
        rate = F.col(self.rate).cast("double")
        if self.missing_rate == "conservative":
            if self.conservative_rate is None:
                raise MethodContractError("a conservative rate is needed")
            rate = F.coalesce(rate, F.lit(self.conservative_rate))
        return F.when(F.col("side") == "sell", notional() * rate * F.col(self.days) / F.lit(365.0)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class CompositeCostModel:
    models: tuple[CostModel, ...]
    name: str = "composite"
    version: str = "1"

    @property
    def required_fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for m in self.models for f in m.required_fields))


def cost_frame(trades: DataFrame, models: Sequence[CostModel]) -> DataFrame:
    """Trades with ``cost_<model>`` and ``total_cost``; one projection, no shuffle."""
    names = [m.name for m in models]
    if len(set(names)) < len(names):
        raise MethodContractError("two models have one name")
    if clash := [n for n in names if f"cost_{n}" in trades.columns]:
        raise DataContractError(f"the trades already carry {clash}; they would be charged twice")
    out = trades.withColumns({f"cost_{m.name}": m.cost(trades) for m in models})
    return out.withColumn("total_cost", reduce(lambda a, b: a + b, [F.col(f"cost_{n}") for n in names], F.lit(0.0)))


def estimate(trades: DataFrame, model: CostModel, *, currency: str, columns: Mapping[str, str] | None = None, signed: bool = True, allow_executed_prices: bool = False) -> FrameResult:
    """Cost of each trade and totals; one unknown trade makes the total unknown."""
    models = list(model.models) if isinstance(model, CompositeCostModel) else [model]
    ready = canonical_trades(trades, columns=columns, signed=signed)
    C.require_columns(ready, [f for m in models for f in m.required_fields], "trades")
    if not allow_executed_prices and any(m.name in ("spread", "slippage", "volatility_slippage") for m in models):
        C.refuse(C.checked(ready, {"price that already differs from its reference": F.col("price") != F.col("reference_price")}), ["price that already differs from its reference"])
    out = cost_frame(ready, models)
    extra: dict[str, Column] = {}
    for m in models:
        if isinstance(m, ParticipationImpactModel):
            extra["breach"] = m.participation() > m.max_participation if m.max_participation is not None else F.lit(False)
            extra["capped"] = m.fraction() > m.cap if m.cap is not None else F.lit(False)
        if isinstance(m, BorrowCostModel):
            extra["no_rate"] = (F.col("side") == "sell") & F.col(m.rate).isNull()
    agg = out.agg(F.count(F.lit(1)).alias("n"), F.count("total_cost").alias("known"), F.sum("total_cost").alias("total"), *[F.sum(f"cost_{m.name}").alias(f"c_{m.name}") for m in models], *[F.count(f"cost_{m.name}").alias(f"k_{m.name}") for m in models], *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in extra.items()]).collect()[0].asDict()
    findings = []
    if agg.get("breach"):
        findings.append(Finding("COST_PARTICIPATION_LIMIT_EXCEEDED", "Participation limit", f"{agg['breach']} trades.", State.FAIL, Severity.HIGH, "costs.capacity"))
    if agg.get("capped"):
        findings.append(Finding("COST_IMPACT_CAP_APPLIED", "Impact capped", f"{agg['capped']} trades.", State.WARN, Severity.MEDIUM, "costs.impact"))
    if agg.get("no_rate"):
        policy = next(m.missing_rate for m in models if isinstance(m, BorrowCostModel))
        if policy == "raise":
            raise DataContractError(f"{agg['no_rate']} short trades have no borrow rate")
        known = policy == "conservative"
        findings.append(Finding("COST_BORROW_CONSERVATIVE_ASSUMPTION" if known else "COST_BORROW_UNKNOWN", "Borrow rate missing", f"{agg['no_rate']} trades.", State.WARN if known else State.UNKNOWN, Severity.HIGH, "costs.borrow"))
    complete = agg["known"] == agg["n"]
    metrics = {"trade_count": agg["n"], "known_rows": agg["known"], "unknown_rows": agg["n"] - agg["known"], "known_total_cost": agg["total"] or 0.0, "total_cost": (agg["total"] or 0.0) if complete else None, "component_totals": {m.name: (agg[f"c_{m.name}"] or 0.0) if agg[f"k_{m.name}"] == agg["n"] else None for m in models}, "unit": "currency", "currency": currency}
    return FrameResult(out, Evidence(Metadata(f"costs.{model.name}", model.version), metrics, tuple(findings), {"per_trade_costs": out.select("instrument", "execution_time", *[f"cost_{m.name}" for m in models], "total_cost").limit(1000)}))


def trade_sums(trades: DataFrame, *, gross: str = "gross_pnl", period: str | None = None, base: Column | None = None) -> DataFrame:
    """Per period (or in all): gross, notional, base cost and unknown base costs.  What every scenario needs."""
    keyed = trades.withColumn("__base", base if base is not None else F.lit(0.0))
    grouped = keyed.groupBy(F.col(period).alias("period")) if period else keyed.groupBy(F.lit(0).alias("period"))
    return grouped.agg(F.sum(F.col(gross).cast("double")).alias("gross"), F.sum(notional()).alias("notional"), F.coalesce(F.sum("__base"), F.lit(0.0)).alias("base"), F.count_if(F.col("__base").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n"))


def scenarios_of(spread_bps: Sequence[float], slippage_bps: Sequence[float], commission_bps: Sequence[float], scenarios: Sequence[Mapping[str, float]] | None) -> list[dict]:
    rows = [dict(s) for s in scenarios] if scenarios else [{"spread_bps": a, "slippage_bps": b, "commission_bps": c} for a, b, c in product(spread_bps, slippage_bps, commission_bps)]
    out = [{"scenario": k, **{n: float(r.get(n, 0.0)) for n in ("spread_bps", "slippage_bps", "commission_bps")}} for k, r in enumerate(rows)]
    if not out or any(v < 0 for r in out for v in r.values()):
        raise MethodContractError("scenarios must exist and not be negative")
    return out


def stress_frame(sums: DataFrame, scenarios: Sequence[Mapping[str, float]], *, capital: float | None = None, annualization: float = 1.0) -> DataFrame:
    """Net results of every scenario from per-period sums.

    The scenario grid is a driver-side list in an array column, not a join.
    """
    grid = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])).alias("s")
    rate = (F.col("s.commission_bps") + F.col("s.spread_bps") / 2 + F.col("s.slippage_bps")) / 1e4
    each = sums.select("*", grid).withColumn("cost", F.col("base") + F.col("notional") * rate).withColumn("net", F.col("gross") - F.col("cost"))
    scale = F.lit(float(capital)) if capital else F.lit(1.0)
    complete = F.sum("unknown") == 0
    out = each.groupBy("s.scenario", "s.spread_bps", "s.slippage_bps", "s.commission_bps").agg(F.sum("gross").alias("gross_pnl"), F.when(complete, F.sum("cost")).alias("cost"), F.when(complete, F.sum("net")).alias("net_pnl"), F.when(complete & F.lit(bool(capital)), F.sum("net") / scale).alias("net_return"), F.when(complete, F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.lit(sqrt(annualization))).alias("net_sharpe"), complete.alias("complete"))
    return out


def stress(trades: DataFrame, *, spread_bps: Sequence[float] = (0.0,), slippage_bps: Sequence[float] = (0.0,), commission_bps: Sequence[float] = (0.0,), scenarios: Sequence[Mapping[str, float]] | None = None, base_models: Sequence[CostModel] = (), capital: float | None = None, annualization: float = 1.0, period: str | None = None, gross_pnl: str = "gross_pnl", currency: str = "USD", columns: Mapping[str, str] | None = None) -> Evidence:
    """Net P&L, return and Sharpe over a grid of cost assumptions, beside base models."""
    grid = scenarios_of(spread_bps, slippage_bps, commission_bps, scenarios)
    ready = canonical_trades(trades, columns=columns)
    C.require_columns(ready, [gross_pnl, *([period] if period else [])], "trades")
    base = reduce(lambda a, b: a + b, [m.cost(ready) for m in base_models]) if base_models else None
    sums = trade_sums(ready, gross=gross_pnl, period=period, base=base).persist()
    surface = stress_frame(sums, grid, capital=capital, annualization=annualization).persist()
    if not period:
        surface = surface.withColumn("net_sharpe", F.lit(None).cast("double"))
    rows = [r.asDict() for r in surface.collect()]
    known = [r["net_pnl"] for r in rows if r["net_pnl"] is not None]
    total = sums.agg(F.sum("gross"), F.sum("notional"), F.sum("unknown")).collect()[0]
    findings = [Finding("COST_STRESS_INCOMPLETE", "Unknown base costs", f"{total[2]} trades.", State.UNKNOWN, Severity.HIGH, "costs.stress")] if total[2] else []
    metrics = {"scenario_count": len(rows), "gross_pnl": total[0], "total_notional": total[1], "best_net_pnl": max(known, default=None), "worst_net_pnl": min(known, default=None), "complete_scenarios": len(known), "currency": currency}
    return Evidence(Metadata("costs.stress", parameters={"capital": capital}), metrics, tuple(findings), {"stress_surface": surface.orderBy("scenario")})


def break_even_cost(trades: DataFrame, *, metric: str = "net_pnl", threshold: float = 0.0, lower_bps: float = 0.0, upper_bps: float = 100.0, tolerance_bps: float = 0.01, max_iterations: int = 100, capital: float | None = None, annualization: float = 1.0, period: str | None = None, gross_pnl: str = "gross_pnl", columns: Mapping[str, str] | None = None) -> Evidence:
    """The uniform cost at which a metric meets a threshold.

    One aggregate, then a screen of 33 points for monotonicity and a bisection
    on the per-period sums.
    """
    C.require_one_of(metric, ("net_pnl", "net_return", "net_sharpe", "cagr"), "metric")
    if not 0 <= lower_bps < upper_bps or tolerance_bps <= 0 or metric in ("net_return", "cagr") and not capital or metric in ("net_sharpe", "cagr") and not period:
        raise MethodContractError("bounds must rise, returns need capital and period metrics a period")
    ready = canonical_trades(trades, columns=columns)
    rows = trade_sums(ready, gross=gross_pnl, period=period).orderBy("period").toPandas()
    g, v = rows["gross"].to_numpy(dtype=float), rows["notional"].to_numpy(dtype=float)
    trace: list[dict] = []

    def at(bps: float) -> float:
        net = g - v * bps / 1e4
        if metric == "net_pnl":
            out = net.sum()
        elif metric == "net_return":
            out = net.sum() / capital
        elif metric == "net_sharpe":
            sd = net.std(ddof=1) if len(net) > 1 else 0.0
            out = net.mean() / sd * sqrt(annualization) if sd > 0 else float("nan")
        else:
            growth = np.prod(1 + net / capital) if (1 + net / capital > 0).all() else 0.0
            out = growth ** (annualization / len(net)) - 1
        trace.append({"step": len(trace), "bps": float(bps), "value": float(out) if np.isfinite(out) else None})
        return float(out)

    points = np.linspace(lower_bps, upper_bps, 33)
    values = np.array([at(b) for b in points])
    falling = bool(np.isfinite(values).all() and (np.diff(values) <= 1e-12 * np.maximum(1, np.abs(values[:-1]))).all())
    solution, steps, findings = None, 0, []
    if not falling:
        status = "non_monotonic"
        findings.append(Finding("COST_BREAK_EVEN_NON_MONOTONIC", "Not monotonic", "The metric does not fall with cost.", State.UNKNOWN, Severity.HIGH, "costs.break_even"))
    elif values[0] <= threshold:
        status, solution = "crossed_at_lower_bound", float(lower_bps)
    elif values[-1] > threshold:
        status = "no_crossing"
        findings.append(Finding("COST_BREAK_EVEN_NOT_BRACKETED", "Not bracketed", "The threshold is not reached.", State.UNKNOWN, Severity.MEDIUM, "costs.break_even"))
    else:
        k = int(np.argmax(values <= threshold))
        a, b = points[k - 1], points[k]
        while b - a > tolerance_bps and steps < max_iterations:
            m = (a + b) / 2
            a, b = (a, m) if at(m) <= threshold else (m, b)
            steps += 1
        solution = float((a + b) / 2)
        status = "converged" if b - a <= tolerance_bps else "iteration_limit"
        if status == "iteration_limit":
            findings.append(Finding("COST_BREAK_EVEN_ITERATION_LIMIT", "Iteration limit", "The bracket is wider than asked.", State.WARN, Severity.MEDIUM, "costs.break_even"))
    metrics = {"status": status, "metric": metric, "threshold": threshold, "solution_bps": solution, "monotonic_decreasing": falling, "iterations": steps, "lower_bps": lower_bps, "upper_bps": upper_bps, "tolerance_bps": tolerance_bps}
    return Evidence(Metadata("costs.break_even_cost"), metrics, tuple(findings), {"solver_trace": trace})


def liquidity_frame(trades: DataFrame, *, volume: str = "adv", available_time: str | None = None, max_participation: float = 0.1) -> DataFrame:
    share = F.try_divide(size(), _known(volume, available_time))
    return trades.withColumn("participation", share).withColumn("liquidity", F.when(F.col("participation").isNull(), "unknown").when(F.col("participation") > max_participation, "breach").otherwise("pass"))


def liquidity_diagnostics(trades: DataFrame, *, volume: str = "adv", available_time: str | None = None, classification_mode: str = "point_in_time", max_participation: float = 0.1, columns: Mapping[str, str] | None = None) -> Evidence:
    """Share of volume of each trade against a limit."""
    C.require_one_of(classification_mode, ("point_in_time", "retrospective"), "classification_mode")
    ready = canonical_trades(trades, columns=columns)
    C.require_columns(ready, [volume, *([available_time] if available_time else [])], "trades")
    out = liquidity_frame(ready, volume=volume, available_time=available_time, max_participation=max_participation).persist()
    c = out.agg(F.count(F.lit(1)).alias("n"), F.count("participation").alias("known"), F.count_if(F.col("liquidity") == "breach").alias("breach"), F.median("participation").alias("median"), F.percentile("participation", F.lit(0.95)).alias("p95"), F.max("participation").alias("max")).collect()[0]
    findings = []
    if c["n"] > c["known"]:
        findings.append(Finding("COST_LIQUIDITY_UNKNOWN", "Unknown liquidity", f"{c['n'] - c['known']} trades.", State.UNKNOWN, Severity.HIGH, "costs.liquidity"))
    if c["breach"]:
        findings.append(Finding("COST_LIQUIDITY_CONSTRAINT_BREACH", "Participation limit", f"{c['breach']} trades.", State.FAIL, Severity.HIGH, "costs.liquidity"))
    if classification_mode == "retrospective":
        findings.append(Finding("COST_LIQUIDITY_RETROSPECTIVE", "Retrospective volume", "Volume may postdate the trade.", State.WARN, Severity.MEDIUM, "costs.temporal"))
    metrics = {"trade_count": c["n"], "known_rows": c["known"], "unknown_rows": c["n"] - c["known"], "coverage": c["known"] / c["n"] if c["n"] else None, "breach_rows": c["breach"], "breach_fraction": c["breach"] / c["known"] if c["known"] else None, "median_participation": c["median"], "p95_participation": c["p95"], "max_observed_participation": c["max"]}
    return Evidence(Metadata("costs.liquidity_diagnostics", parameters={"max_participation": max_participation}), metrics, tuple(findings), {"liquidity": out.groupBy("liquidity").count()})


def capacity_frame(trades: DataFrame, *, capital: Sequence[float], base_capital: float, scenarios: Sequence[Mapping[str, float]], volume: str = "adv", volatility: str = "volatility", available_time: str | None = None, max_participation: float = 0.1, gross: str = "gross_pnl") -> DataFrame:
    """Per (scenario, capital): impact, linear cost, net result and breaches.

    With scale s the impact is s^1.5 times one sum and linear costs are s times
    another; breaches at each scale are counted in the same aggregate.
    """
    scales = [float(c) / base_capital for c in capital]
    v, sd = _known(volume, available_time), _known(volatility, available_time)
    part = F.try_divide(size(), v)
    unit = notional() * sd * F.sqrt(part)
    unknown = (size() > 0) & unit.isNull()
    one = trades.agg(F.sum(F.col(gross).cast("double")).alias("gross"), F.sum(notional()).alias("notional"), F.coalesce(F.sum(unit), F.lit(0.0)).alias("unit"), F.count_if(F.coalesce(unknown, F.lit(True))).alias("unknown"), F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.coalesce(part * s > max_participation, F.lit(False))) for s in scales]).alias("breaches"))
    points = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("capital"), F.lit(s).alias("scale"), F.lit(k).alias("k")) for k, (c, s) in enumerate(zip(capital, scales, strict=True))])).alias("p")
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(float(s.get("impact_coefficient", 1.0))).alias("c"), F.lit(float(s.get("linear_bps", 0.0))).alias("bps")) for i, s in enumerate(scenarios)])).alias("s")
    each = one.select("*", points).select("*", grid)
    known = F.col("unknown") == 0
    impact = F.when(known, F.col("unit") * F.col("s.c") * F.pow("p.scale", F.lit(1.5)))
    linear = F.col("notional") * F.col("p.scale") * F.col("s.bps") / 1e4
    net = F.col("gross") * F.col("p.scale") - impact - linear
    return each.select(F.col("s.scenario").alias("scenario"), F.col("p.capital").alias("capital"), F.col("p.scale").alias("scale"), (F.col("gross") * F.col("p.scale")).alias("gross_pnl"), impact.alias("impact_cost"), linear.alias("linear_cost"), net.alias("net_pnl"), (net / F.col("p.capital")).alias("net_return"), F.col("breaches")[F.col("p.k")].alias("breach_rows"), F.col("unknown").alias("unknown_rows"))


def capacity_curve(trades: DataFrame, *, capital: Sequence[float], base_capital: float, scenarios: Sequence[Mapping[str, float]] = ({"impact_coefficient": 1.0},), volume: str = "adv", volatility: str = "volatility", available_time: str | None = None, classification_mode: str = "point_in_time", max_participation: float = 0.1, gross_pnl: str = "gross_pnl", columns: Mapping[str, str] | None = None) -> Evidence:
    """Net result against capital; a curve, not one capacity number."""
    if base_capital <= 0 or not capital or any(c <= 0 for c in capital) or not scenarios:
        raise MethodContractError("capital must be positive and scenarios given")
    ready = canonical_trades(trades, columns=columns)
    C.require_columns(ready, [volume, volatility, gross_pnl], "trades")
    curve = capacity_frame(ready, capital=sorted(capital), base_capital=base_capital, scenarios=scenarios, volume=volume, volatility=volatility, available_time=available_time, max_participation=max_participation, gross=gross_pnl).persist()
    rows = curve.collect()
    n = ready.count()
    unknown = rows[0]["unknown_rows"] if rows else 0
    findings = []
    if unknown:
        findings.append(Finding("COST_CAPACITY_UNKNOWN_LIQUIDITY", "Unknown liquidity", f"{unknown} trades.", State.UNKNOWN, Severity.HIGH, "costs.capacity"))
    if any(r["breach_rows"] for r in rows):
        findings.append(Finding("COST_CAPACITY_CONSTRAINT_BREACH", "Participation limit", "Some capitals breach it.", State.FAIL, Severity.HIGH, "costs.capacity"))
    if classification_mode == "retrospective":
        findings.append(Finding("COST_CAPACITY_RETROSPECTIVE", "Retrospective market data", "Market data may postdate the trade.", State.WARN, Severity.MEDIUM, "costs.temporal"))
    metrics = {"curve_points": len(rows), "capital_points": len(capital), "scenario_count": len(scenarios), "liquidity_coverage": 1 - unknown / n if n else None, "unknown_liquidity_rows": unknown, "returns_single_capacity_number": False}
    return Evidence(Metadata("costs.capacity_curve", parameters={"base_capital": base_capital}), metrics, tuple(findings), {"capacity_curve": curve.orderBy("scenario", "capital")})
