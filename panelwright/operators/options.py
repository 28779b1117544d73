"""Option chains: coordinates, delta buckets, residuals against a surface."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright import contracts as C
from panelwright.errors import MethodContractError
from panelwright.functions.columns import infinite, missing
from panelwright.result import Evidence, FrameResult, Metadata

REQUIRED = ("time", "instrument", "underlying", "expiration", "strike", "option_type", "bid", "ask", "underlying_price", "rate", "dividend")
OPTIONAL = ("mid", "iv", "delta", "expected_iv", "gamma", "vega", "theta", "open_interest")


def coordinate_frame(chain: DataFrame, year_basis: float = 365.25) -> DataFrame:
    """Adds mid, time to expiry in years, forward and log-moneyness."""
    mid = F.coalesce("mid", (F.col("bid") + F.col("ask")) / 2) if "mid" in chain.columns else (F.col("bid") + F.col("ask")) / 2
    span = F.when(F.lit(chain.schema["time"].dataType.typeName() == "date"), F.datediff(F.to_date("expiration"), F.to_date("time")).cast("double")).otherwise((F.unix_timestamp(F.col("expiration").cast("timestamp")) - F.unix_timestamp(F.col("time").cast("timestamp"))) / 86400.0)
    out = chain.withColumn("mid", mid).withColumn("time_to_expiry", span / F.lit(float(year_basis)))
    out = out.withColumn("forward", F.col("underlying_price") * F.exp((F.col("rate") - F.col("dividend")) * F.col("time_to_expiry")))
    return out.withColumn("log_moneyness", F.ln(F.col("strike") / F.col("forward")))


def validate_chain(data: DataFrame, *, columns: Mapping[str, str] | None = None, year_basis: float = 365.25) -> FrameResult:
    """The chain under canonical names with its coordinates, or an error that counts what is wrong."""
    if year_basis <= 0:
        raise MethodContractError("the year basis must be positive")
    names = {**{c: c for c in (*REQUIRED, *OPTIONAL) if c in data.columns}, **(columns or {})}
    C.require_columns(data, [names.get(c, c) for c in REQUIRED], "chain")
    clash = set(names.values())
    out = data.select(*[F.col(s).alias(c) for c, s in names.items()], *[F.col(f"`{c}`") for c in data.columns if c not in clash and c not in names])
    out = out.withColumn("option_type", F.lower("option_type"))
    has = set(out.columns)
    mid_ok = (F.col("mid") < F.col("bid")) | (F.col("mid") > F.col("ask")) if "mid" in has else F.lit(False)
    bad = {
        "null field": sum([F.col(c).isNull().cast("int") for c in REQUIRED], F.lit(0)) > 0,
        "crossed quote": (F.col("bid") > F.col("ask")) | (F.col("bid") < 0) | mid_ok,
        "non-positive strike or price": (F.col("strike") <= 0) | (F.col("underlying_price") <= 0) | infinite("strike"),
        "unknown option type": ~F.col("option_type").isin("call", "put"),
        "expired": F.col("expiration") <= F.col("time"),
        "delta beyond one": F.abs(F.col("delta")) > 1 if "delta" in has else F.lit(False),
        "negative volatility": F.col("iv") < 0 if "iv" in has else F.lit(False),
    }
    c = C.checked(out, bad, "chain")
    C.refuse(c, bad, "chain")
    C.require_unique(out, ["time", "instrument"], "chain")
    chain = coordinate_frame(out, year_basis)
    n = chain.agg(F.count(F.lit(1)).alias("quote_count"), F.countDistinct("instrument").alias("instrument_count"), F.countDistinct("underlying").alias("underlying_count"), F.countDistinct("expiration").alias("expiration_count")).collect()[0]
    return FrameResult(chain, Evidence(Metadata("options.validate_chain", parameters={"year_basis": year_basis}), n.asDict()))


def delta_bucket_frame(chain: DataFrame, edges: Sequence[float]) -> DataFrame:
    """``delta_bucket``: left-closed ranges of the absolute delta, the last one closed."""
    d = F.abs("delta")
    out = None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        last = b == edges[-1]
        inside = (d >= a) & ((d <= b) if last else (d < b))
        label = F.lit(f"[{a:g},{b:g}{']' if last else ')'}")
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return chain.withColumn("delta_bucket", out)


def delta_buckets(chain: DataFrame | FrameResult, *, edges: Sequence[float] = (0.0, 0.1, 0.25, 0.4, 0.6, 0.75, 0.9, 1.0)) -> FrameResult:
    df = chain.frame if isinstance(chain, FrameResult) else chain
    if len(edges) < 2 or edges[0] != 0 or edges[-1] != 1 or any(b <= a for a, b in zip(edges[:-1], edges[1:], strict=True)):
        raise MethodContractError("edges must rise from 0 to 1")
    C.require_columns(df, ["delta"], "chain")
    C.refuse(C.checked(df, {"missing delta": missing("delta")}), ["missing delta"], "chain")
    out = delta_bucket_frame(df, edges)
    counts = out.groupBy("delta_bucket").count().orderBy("delta_bucket")
    rows = counts.collect()
    return FrameResult(out, Evidence(Metadata("options.delta_buckets", parameters={"edges": list(edges)}), {"quote_count": sum(r["count"] for r in rows), "occupied_buckets": len(rows)}, (), {"bucket_counts": counts}))


def residual_frame(chain: DataFrame, *, observed: str = "iv", expected: str = "expected_iv", output: str = "iv_residual", by: Sequence[str] = ("time", "underlying", "expiration")) -> DataFrame:
    r = F.col(observed) - F.col(expected)
    return chain.withColumn(output, r).groupBy(*by).agg(F.count(output).alias("n"), F.avg(output).alias("mean_residual"), F.median(output).alias("median_residual"), F.sqrt(F.avg(F.pow(output, F.lit(2)))).alias("rmse"), F.try_divide(F.count_if(F.col(output) > 0).cast("double"), F.count(output).cast("double")).alias("positive_fraction"))


def empirical_residual(chain: DataFrame | FrameResult, *, observed: str = "iv", expected: str = "expected_iv", output: str = "iv_residual") -> FrameResult:
    """Observed less expected, overall and by (time, underlying, expiration)."""
    df = chain.frame if isinstance(chain, FrameResult) else chain
    C.require_columns(df, [observed, expected], "chain")
    C.refuse(C.checked(df, {"missing value": missing(observed) | missing(expected), "infinite value": infinite(observed) | infinite(expected)}), ["missing value", "infinite value"], "chain")
    out = df.withColumn(output, F.col(observed) - F.col(expected))
    head = residual_frame(df, observed=observed, expected=expected, output=output, by=[F.lit(1).alias("all")]).collect()
    h = head[0].asDict() if head else {"n": 0, "mean_residual": None, "median_residual": None, "rmse": None, "positive_fraction": None}
    metrics = {"quote_count": h["n"], **{k: h[k] for k in ("mean_residual", "median_residual", "rmse", "positive_fraction")}}
    return FrameResult(out, Evidence(Metadata("options.empirical_residual"), metrics, (), {"surface_groups": residual_frame(df, observed=observed, expected=expected, output=output)}))
