"""Queries over the star-schema tables, each with the SQL that states the same result.

Doubles are rounded to six places on both sides, because sums are taken in
different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.columns import average_rank, ratio
from panelwright.operators import costs, cv, events, infer, labels, options, pit, portfolio, regime, signal, transform
from panelwright.operators.transform import BucketSpec, bucket_frame
from panelwright.plans.panels import month, monthly, regions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PX = """
px AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_suppkey AS instrument, min(l_extendedprice) AS open,
  sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS adv, round(avg(l_discount), 9) AS signal FROM lineitem GROUP BY 1, 2),
sector AS (SELECT s_suppkey AS instrument, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lab AS (SELECT time AS observation_time, instrument, lead(close, 1) OVER w / close - 1 AS r1, lead(close, 3) OVER w / close - 1 AS r3, lead(time, 1) OVER w AS e1, lead(time, 3) OVER w AS e3 FROM px WINDOW w AS (PARTITION BY instrument ORDER BY time)),
labels AS (SELECT observation_time, instrument, '1D' AS horizon, r1 AS forward_return, e1 AS label_end FROM lab WHERE r1 IS NOT NULL
  UNION ALL SELECT observation_time, instrument, '3D', r3, e3 FROM lab WHERE r3 IS NOT NULL),
panel AS (SELECT px.time, px.instrument, px.signal AS x, l.forward_return AS y, l.horizon, s.sector FROM px JOIN labels l ON px.time = l.observation_time AND px.instrument = l.instrument JOIN sector s ON s.instrument = px.instrument),
one AS (SELECT * FROM panel WHERE horizon = '1D')
"""


#: Date columns of the results; they are returned as text.
DATES: dict[str, tuple[str, ...]] = {
    "forward_returns": ("observation_time", "label_end"),
    "forward_returns_next_open": ("observation_time", "entry_time"),
    "ic_pearson": ("time",),
    "ic_spearman": ("time",),
    "ic_by_group": ("time",),
    "bucketize_balanced": ("time",),
    "bucketize_preserve": ("time",),
    "bucketize_custom_edges": ("time",),
    "bucketize_equal_width": ("time",),
    "bucketize_edges": ("time",),
    "bucketize_threshold": ("time",),
    "bucketize_split": ("time",),
    "bucket_returns_by_period": ("time",),
    "bucket_spread": ("time",),
    "turnover_rank": ("time",),
    "turnover_membership": ("time",),
    "neutralize_one_exposure": ("time",),
    "neutralize_group_demean": ("time",),
    "portfolio_weights": ("time",),
    "cohort_returns": ("time",),
    "one_way_turnover": ("time",),
    "revision_diagnostics": ("effective_time",),
    "universe_drift": ("previous_time", "snapshot_time"),
    "event_windows": ("anchor_time", "price_time"),
    "regime_expanding": ("time",),
    "regime_rolling": ("time",),
    "average_ranks": ("time",),
}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, negative zero to zero, dates to text."""

    def plain(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, places) + F.lit(0.0)
        return (c.cast("string") if isinstance(f.dataType, T.DateType) else c).alias(f.name)

    return df.select(*[plain(f) for f in df.schema])


def query(name: str, sql: str | None = None, with_panel: bool = True, places: int = 6):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), places)
        if sql:
            body = sql.strip()
            if with_panel:
                body = f"WITH {PX.strip()}{', ' if body.startswith('WITH ') else ' '}{body.removeprefix('WITH ')}"
            dates = DATES.get(name, ())
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({body})" if dates else body
        return f

    return register


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def corr(x: str = "x", y: str = "y") -> str:
    return f"CASE WHEN count(*) >= 2 THEN greatest(-1.0, least(1.0, covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0))) END"


def rank(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def label_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_frame(monthly(spark, sf_dir), horizons=[1, 3], entry=None).where("forward_return is not null")


def panel(spark: SparkSession, sf_dir: str, horizon: str | None = None) -> DataFrame:
    lab = label_panel(spark, sf_dir)
    lab = lab.where(F.col("horizon") == horizon).drop("horizon") if horizon else lab
    sg = monthly(spark, sf_dir).join(regions(spark, sf_dir), "instrument")
    return signal.aligned(sg, lab, extra=["sector"])


# Labels and signal diagnostics


@query("forward_returns", f"SELECT observation_time, instrument, horizon, label_end, {r('forward_return')} AS forward_return FROM labels")
def _(spark, sf_dir):
    return label_panel(spark, sf_dir).select("observation_time", "instrument", "horizon", "label_end", "forward_return")


@query("forward_returns_next_open", f"WITH o AS (SELECT time AS observation_time, instrument, lead(time, 1) OVER w AS entry_time, lead(close, 2) OVER w / lead(open, 1) OVER w - 1 AS forward_return FROM px WINDOW w AS (PARTITION BY instrument ORDER BY time)) SELECT observation_time, instrument, entry_time, {r('forward_return')} AS forward_return FROM o WHERE forward_return IS NOT NULL")
def _(spark, sf_dir):
    return labels.label_frame(monthly(spark, sf_dir), horizons=[2], entry="next_open").where("forward_return is not null").select("observation_time", "instrument", "entry_time", "forward_return")


@query("ic_pearson", f"SELECT time, {r(corr())} AS ic, count(*) AS n FROM one GROUP BY time HAVING count(*) >= 3")
def _(spark, sf_dir):
    return signal.ic_frame(panel(spark, sf_dir, "1D"), method="pearson")


RANKED = f"rk AS (SELECT time, horizon, {rank('x', 'time, horizon')} AS x, {rank('y', 'time, horizon')} AS y FROM panel)"


@query("ic_spearman", f"WITH {RANKED} SELECT time, horizon, {r(corr())} AS ic, count(*) AS n FROM rk GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf_dir):
    return signal.ic_frame(panel(spark, sf_dir))


@query("ic_by_group", f"WITH rk AS (SELECT time, sector, {rank('x', 'time, sector')} AS x, {rank('y', 'time, sector')} AS y FROM one) SELECT time, sector, {r(corr())} AS ic, count(*) AS n FROM rk GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf_dir):
    return signal.ic_frame(panel(spark, sf_dir, "1D"), by=["time", "sector"])


SUMMARY = f"{r('avg(ic)')} AS mean_ic, {r('median(ic)')} AS median_ic, {r('stddev_samp(ic)')} AS std_ic, {r('avg(ic) / nullif(stddev_samp(ic), 0)')} AS ic_ir, {r('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(ic)), 0)')} AS t_stat, {r('count(*) FILTER (ic > 0) / count(ic)')} AS positive_fraction, count(ic) AS n_periods"


@query("ic_summary", f"WITH {RANKED}, ic AS (SELECT time, horizon, {corr()} AS ic FROM rk GROUP BY ALL HAVING count(*) >= 3) SELECT horizon, {SUMMARY} FROM ic GROUP BY horizon")
def _(spark, sf_dir):
    return signal.ic_summary_frame(signal.ic_frame(panel(spark, sf_dir)), ["horizon"])


def _bucket(spec: BucketSpec, ascending: bool = True):
    def run(spark, sf_dir):
        return bucket_frame(monthly(spark, sf_dir), spec, by=["time"], ascending=ascending).where("bucket is not null").select("time", "instrument", "bucket")

    return run


def _positions(pos: str, cuts: list[str]) -> str:
    return "1 + " + " + ".join(f"CAST({pos} >= {c} AS INT)" for c in cuts)


FIFTHS = [f"CAST({k / 5!r} AS DOUBLE)" for k in range(1, 5)]
BALANCED = "(row_number() OVER (PARTITION BY time ORDER BY signal, instrument) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY time)"
PRESERVED = f"(({rank('signal', 'time')})::DOUBLE - 0.5::DOUBLE) / count(*) OVER (PARTITION BY time)"
query("bucketize_balanced", f"SELECT time, instrument, CASE WHEN count(*) OVER (PARTITION BY time) >= 5 THEN {_positions(BALANCED, FIFTHS)} END AS bucket FROM px")(_bucket(BucketSpec.quantiles(5)))
query("bucketize_preserve", f"SELECT time, instrument, CASE WHEN count(*) OVER (PARTITION BY time) >= 5 THEN {_positions(PRESERVED, FIFTHS)} END AS bucket FROM px")(_bucket(BucketSpec.quantiles(5, tie_policy="preserve")))
query("bucketize_custom_edges", f"SELECT time, instrument, CASE WHEN count(*) OVER (PARTITION BY time) >= 3 THEN {_positions(BALANCED, ['CAST(0.2 AS DOUBLE)', 'CAST(0.9 AS DOUBLE)'])} END AS bucket FROM px")(_bucket(BucketSpec.quantiles(edges=[0, 0.2, 0.9, 1])))
query("bucketize_equal_width", "WITH b AS (SELECT time, instrument, signal, min(signal) OVER (PARTITION BY time) AS lo, max(signal) OVER (PARTITION BY time) AS hi FROM px) SELECT time, instrument, CASE WHEN hi > lo THEN least(4, CAST(floor((signal - lo) * 4 / (hi - lo)) AS INT) + 1) END AS bucket FROM b")(_bucket(BucketSpec.equal_width(4)))
query("bucketize_edges", "SELECT time, instrument, CASE WHEN signal BETWEEN 0.03 AND 0.07 THEN 1 + CAST(signal >= 0.045 AS INT) + CAST(signal >= 0.055 AS INT) END AS bucket FROM px WHERE signal BETWEEN 0.03 AND 0.07")(_bucket(BucketSpec.edges([0.03, 0.045, 0.055, 0.07], out_of_range="drop")))
query("bucketize_threshold", "SELECT time, instrument, 1 + CAST(signal > 0.05 AS INT) AS bucket FROM px")(_bucket(BucketSpec.threshold(0.05, equal_to="lower")))
query(
    "bucketize_split",
    """WITH b AS (SELECT time, instrument, CAST(signal >= 0.05 AS INT) AS side, signal FROM px),
p AS (SELECT time, instrument, side, count(*) OVER (PARTITION BY time, side) AS n, (row_number() OVER (PARTITION BY time, side ORDER BY signal, instrument) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY time, side) AS pos FROM b)
SELECT time, instrument, CASE WHEN side = 0 AND n >= 2 THEN 1 + CAST(pos >= CAST(0.5 AS DOUBLE) AS INT) WHEN side = 1 AND n >= 2 THEN 3 + CAST(pos >= CAST(0.5 AS DOUBLE) AS INT) END AS bucket FROM p WHERE n >= 2""",
)(_bucket(BucketSpec.quantiles(4, split_at=0.05)))

BUCKETED = f"bk AS (SELECT time, horizon, instrument, y, CASE WHEN count(*) OVER (PARTITION BY time, horizon) >= 5 THEN {_positions('(row_number() OVER (PARTITION BY time, horizon ORDER BY x, instrument) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY time, horizon)', FIFTHS)} END AS bucket, x FROM panel), per AS (SELECT time, horizon, bucket, avg(y) AS mean_return, median(y) AS median_return, count(*) AS n FROM bk WHERE bucket IS NOT NULL GROUP BY ALL), spr AS (SELECT time, horizon, max(mean_return) FILTER (bucket = 5) - max(mean_return) FILTER (bucket = 1) AS spread FROM per GROUP BY ALL)"


def _bucketed(spark, sf_dir) -> DataFrame:
    return bucket_frame(panel(spark, sf_dir), BucketSpec.quantiles(5), by=["time", "horizon"], value="x").where("bucket is not null")


@query("bucket_returns", f"WITH {BUCKETED} SELECT horizon, bucket, {r('avg(mean_return)')} AS mean_return, {r('median(median_return)')} AS median_return, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_periods FROM per GROUP BY ALL")
def _(spark, sf_dir):
    return signal.bucket_frames(_bucketed(spark, sf_dir), top=5)["buckets"]


@query("bucket_returns_by_period", f"WITH {BUCKETED} SELECT time, horizon, bucket, {r('mean_return')} AS mean_return, {r('median_return')} AS median_return, n FROM per")
def _(spark, sf_dir):
    return signal.bucket_frames(_bucketed(spark, sf_dir), top=5)["period"]


@query("bucket_spread", f"WITH {BUCKETED} SELECT time, horizon, {r('spread')} AS spread FROM spr")
def _(spark, sf_dir):
    return signal.bucket_frames(_bucketed(spark, sf_dir), top=5)["spread"]


@query("bucket_monotonicity", f"WITH {BUCKETED}, b AS (SELECT horizon, bucket, avg(mean_return) AS m FROM per GROUP BY ALL), k AS (SELECT horizon, {rank('bucket', 'horizon')} AS x, {rank('m', 'horizon')} AS y, m - lag(m) OVER (PARTITION BY horizon ORDER BY bucket) AS rise FROM b) SELECT horizon, {r(corr())} AS spearman_monotonicity, {r('count(*) FILTER (rise > 0) / nullif(count(rise), 0)')} AS adjacent_order_fraction, count(*) AS n_buckets FROM k GROUP BY horizon")
def _(spark, sf_dir):
    return signal.monotonicity_frame(signal.bucket_frames(_bucketed(spark, sf_dir), top=5)["buckets"], ["horizon"])


@query("decay_by_horizon", f"WITH {RANKED}, ic AS (SELECT time, horizon, {corr()} AS ic FROM rk GROUP BY ALL HAVING count(*) >= 3), {BUCKETED}, a AS (SELECT horizon, {SUMMARY} FROM ic GROUP BY horizon), b AS (SELECT horizon, {r('avg(spread)')} AS mean_spread, {r('stddev_samp(spread)')} AS std_spread, count(spread) AS n_spread_periods FROM spr GROUP BY horizon) SELECT * FROM a FULL JOIN b USING (horizon)")
def _(spark, sf_dir):
    return signal.decay_frame(panel(spark, sf_dir))


TURN = f"""per AS (SELECT time, row_number() OVER (ORDER BY time) AS p FROM (SELECT DISTINCT time FROM px)),
k AS (SELECT px.time, p, instrument, signal AS x, ({rank('signal', 'px.time')} - 1) / greatest(count(*) OVER (PARTITION BY px.time) - 1, 1) AS f,
  CAST(floor((row_number() OVER (PARTITION BY px.time ORDER BY signal, instrument) - 1) * 5 / count(*) OVER (PARTITION BY px.time)) AS INT) + 1 AS bucket FROM px JOIN per ON px.time = per.time),
lags AS (SELECT unnest([1, 3]) AS lag),
j AS (SELECT a.time, lag, a.instrument, a.x, b.x AS x0, a.f, b.f AS f0, a.bucket, b.bucket AS b0 FROM k a JOIN lags ON true JOIN k b ON a.p - lag = b.p AND a.instrument = b.instrument)"""


@query("turnover_rank", f"WITH {TURN} SELECT time, CAST(lag AS INT) AS lag, {r('avg(abs(f - f0))')} AS rank_turnover, {r(corr('x', 'x0'))} AS signal_autocorrelation, count(*) AS n_common FROM j GROUP BY time, lag")
def _(spark, sf_dir):
    return signal.turnover_frames(monthly(spark, sf_dir), quantiles=5, lags=[1, 3])["rank"]


@query(
    "turnover_membership",
    f"""WITH {TURN}, s AS (SELECT p, bucket, count(*) AS c FROM k GROUP BY ALL), g AS (SELECT time, p, lag, b AS bucket FROM per JOIN lags ON p > lag JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS b) ON true),
c AS (SELECT time, lag, bucket, count(*) AS m FROM j WHERE bucket = b0 GROUP BY ALL),
t AS (SELECT g.time, g.lag, g.bucket, coalesce(a.c, 0) + coalesce(b.c, 0) AS n, coalesce(c.m, 0) AS m FROM g LEFT JOIN s a ON g.p = a.p AND g.bucket = a.bucket LEFT JOIN s b ON g.p - g.lag = b.p AND g.bucket = b.bucket LEFT JOIN c ON g.time = c.time AND g.lag = c.lag AND g.bucket = c.bucket)
SELECT time, CAST(lag AS INT) AS lag, bucket, {r('(n - 2 * m) / nullif(n, 0)')} AS turnover FROM t""",
)
def _(spark, sf_dir):
    return signal.turnover_frames(monthly(spark, sf_dir), quantiles=5, lags=[1, 3])["membership"]


@query("neutralize_one_exposure", f"WITH f AS (SELECT time, regr_slope(signal, adv) AS b, regr_intercept(signal, adv) AS a FROM px GROUP BY time) SELECT px.time, instrument, {r('signal - a - b * adv')} AS residual FROM px JOIN f ON px.time = f.time")
def _(spark, sf_dir):
    return transform.single_exposure_frame(monthly(spark, sf_dir), by=["time"], exposure="adv").select("time", "instrument", "residual")


@query("neutralize_group_demean", f"SELECT px.time, px.instrument, {r('signal - avg(signal) OVER (PARTITION BY px.time, sector)', 12)} AS residual FROM px JOIN sector ON px.instrument = sector.instrument", places=12)
def _(spark, sf_dir):
    df = monthly(spark, sf_dir).join(regions(spark, sf_dir), "instrument")
    return transform.demean_frame(df, by=["time"], categories=["sector"]).select("time", "instrument", "residual")


WEIGHTS = f"""bk AS (SELECT time, instrument, x, y, {_positions('(row_number() OVER (PARTITION BY time ORDER BY x, instrument) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY time)', FIFTHS)} AS bucket FROM one),
leg AS (SELECT *, CASE WHEN bucket = 5 THEN 1 ELSE -1 END AS leg FROM bk WHERE bucket IN (1, 5)),
sc AS (SELECT *, {rank('leg * x', 'time, leg')} AS score FROM leg),
w AS (SELECT time, instrument, bucket, leg, leg * score / sum(score) OVER (PARTITION BY time, leg) * 0.5 AS weight, y FROM sc)"""


def _weights(spark, sf_dir) -> DataFrame:
    bucketed = bucket_frame(panel(spark, sf_dir, "1D"), BucketSpec.quantiles(5), by=["time"], value="x")
    return portfolio.weight_frame(bucketed, long_buckets=[5], short_buckets=[1], weighting="rank")


@query("portfolio_weights", f"WITH {WEIGHTS} SELECT time, instrument, bucket, {r('weight')} AS weight, {r('weight * y')} AS contribution FROM w")
def _(spark, sf_dir):
    return _weights(spark, sf_dir).select("time", "instrument", "bucket", "weight", "contribution")


@query("cohort_returns", f"WITH {WEIGHTS} SELECT time, {r('sum(weight * y)')} AS cohort_return, {r('sum(abs(weight))')} AS gross_exposure, {r('sum(weight)')} AS net_exposure, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short, {r('sum(weight * weight)')} AS hhi FROM w GROUP BY time")
def _(spark, sf_dir):
    return portfolio.cohort_frame(_weights(spark, sf_dir))


@query("one_way_turnover", f"WITH {WEIGHTS}, p AS (SELECT time, row_number() OVER (ORDER BY time) AS p FROM (SELECT DISTINCT time FROM w)), h AS (SELECT p, instrument, weight FROM w JOIN p USING (time)), c AS (SELECT coalesce(a.p, b.p + 1) AS p, coalesce(a.weight, 0) - coalesce(b.weight, 0) AS d FROM h a FULL JOIN h b ON a.p = b.p + 1 AND a.instrument = b.instrument) SELECT time, {r('sum(abs(d)) / 2')} AS one_way_turnover FROM c JOIN p USING (p) WHERE c.p > 1 GROUP BY time")
def _(spark, sf_dir):
    return portfolio.turnover_frame(_weights(spark, sf_dir))


# Point in time

EV = """e AS (SELECT event_id, user_id, ts, event_type, value FROM events), l AS (SELECT event_id, user_id, ts FROM e WHERE event_type = 'error'), v AS (SELECT user_id, ts AS known, value FROM e WHERE event_type = 'purchase')"""


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return left, e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("known"), "value")


def _asof(spark, sf_dir, **kw):
    left, right = _sides(spark, sf_dir)
    return pit.asof_frame(left, right, left_time="ts", right_time="known", by=["user_id"], **kw).select("event_id", "user_id", F.col("match.known").alias("known"), F.col("match.value").alias("value"))


@query("asof_backward", f"WITH {EV} SELECT event_id, l.user_id, known, {r('value')} AS value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.known", with_panel=False)
def _(spark, sf_dir):
    return _asof(spark, sf_dir)


@query("asof_strict", f"WITH {EV} SELECT event_id, l.user_id, known, {r('value')} AS value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts > v.known", with_panel=False)
def _(spark, sf_dir):
    return _asof(spark, sf_dir, exact=False)


@query("asof_forward", f"WITH {EV} SELECT event_id, l.user_id, known, {r('value')} AS value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts <= v.known", with_panel=False)
def _(spark, sf_dir):
    return _asof(spark, sf_dir, forward=True)


@query("asof_tolerance", f"WITH {EV}, m AS (SELECT event_id, l.user_id, l.ts, known, value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.known) SELECT event_id, user_id, CASE WHEN epoch_us(ts) - epoch_us(known) <= 86400000000 THEN known END AS known, {r('CASE WHEN epoch_us(ts) - epoch_us(known) <= 86400000000 THEN value END')} AS value, {r('CASE WHEN epoch_us(ts) - epoch_us(known) <= 86400000000 THEN (epoch_us(ts) - epoch_us(known)) / 1e6 END')} AS information_age FROM m", with_panel=False)
def _(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return pit.asof_join(left, right, left_time="ts", right_time="known", by="user_id", tolerance=86400.0).frame.select("event_id", "user_id", "known", "value", "information_age")


@query("asof_revision", f"WITH {EV}, d AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS known, event_id AS revision, value FROM e WHERE event_type = 'purchase'), t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, known ORDER BY revision DESC) = 1) SELECT event_id, l.user_id, coalesce(revision, -1) AS revision, {r('value')} AS value FROM l ASOF LEFT JOIN t ON l.user_id = t.user_id AND l.ts >= t.known", with_panel=False)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", F.date_trunc("day", "ts").cast(e.schema["ts"].dataType).alias("known"), F.col("event_id").alias("revision"), "value")
    return pit.asof_frame(left, right, left_time="ts", right_time="known", by=["user_id"], order=["revision"]).select("event_id", "user_id", F.coalesce(F.col("match.revision"), F.lit(-1)).alias("revision"), F.col("match.value").alias("value"))


def trades(spark, sf_dir) -> DataFrame:
    """Line items with the date of their order; shipping before ordering is planted leakage."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_orderdate").alias("decision_time"), F.col("l_shipdate").alias("execution_time"), F.col("l_suppkey").alias("instrument"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("price"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("reference_price"), (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.04))).alias("gross_pnl"), (F.col("l_quantity") * F.lit(20.0)).alias("adv"), (F.col("l_tax") + F.lit(0.1)).alias("volatility"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("borrow_rate"), F.col("l_linenumber").cast("double").alias("holding_days"))


TR = """tr AS (SELECT o_orderdate AS decision_time, l_shipdate AS execution_time, l_suppkey AS instrument, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS q,
 round(l_extendedprice / l_quantity, 4) AS price, l_extendedprice * (l_discount - 0.04::DOUBLE) AS gross_pnl, l_quantity * 20.0::DOUBLE AS adv, l_tax + 0.1::DOUBLE AS volatility, CASE WHEN l_linenumber > 1 THEN l_tax END AS borrow_rate, CAST(l_linenumber AS DOUBLE) AS holding_days
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ok AS (SELECT *, q * price AS v FROM tr WHERE decision_time <= execution_time)"""


def valid_trades(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).where("decision_time <= execution_time")


@query("future_data_check", f"WITH {TR} SELECT count(*) AS n, count(*) FILTER (decision_time < execution_time) AS before, count(*) FILTER (execution_time < decision_time) AS future_rows, count(*) FILTER (execution_time = decision_time) AS equal_rows, {r('sum(q) FILTER (execution_time < decision_time) / sum(q)')} AS future_materiality FROM tr", with_panel=False)
def _(spark, sf_dir):
    t = trades(spark, sf_dir)
    late = F.col("execution_time") < F.col("decision_time")
    q = F.abs("quantity")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision_time") < F.col("execution_time")).alias("before"), F.count_if(late).alias("future_rows"), F.count_if(F.col("execution_time") == F.col("decision_time")).alias("equal_rows"), ratio(F.sum(F.when(late, q)), F.sum(q)).alias("future_materiality"))


REV = "rv AS (SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS effective_time, o_orderkey AS revision, o_orderdate AS available_time, o_totalprice AS value FROM orders)"


@query("revision_diagnostics", f"WITH {REV}, s AS (SELECT *, available_time < lag(available_time) OVER (PARTITION BY entity, effective_time ORDER BY revision) AS back FROM rv) SELECT entity, effective_time, count(*) AS versions, min(available_time) AS first_available, max(available_time) AS last_available, count(DISTINCT value) AS distinct_values, count(*) FILTER (back) AS order_violations FROM s GROUP BY ALL", with_panel=False)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), month("o_orderdate").alias("effective_time"), F.col("o_orderkey").alias("revision"), F.col("o_orderdate").alias("available_time"), F.col("o_totalprice").alias("value"))
    return pit.revision_frame(o, entity=["entity"], effective_time="effective_time", available_time="available_time", revision="revision", value="value")


MEMBER = "mb AS (SELECT user_id AS instrument, CAST(date_trunc('day', ts) AS DATE) AS valid_from, CASE WHEN event_id % 9 > 0 THEN CAST(date_trunc('day', ts) AS DATE) + CAST(event_id % 5 AS INT) END AS valid_to, CAST(date_trunc('day', ts) AS DATE) + CAST(event_id % 3 AS INT) AS available_time, event_id FROM events)"


def membership(spark, sf_dir) -> DataFrame:
    e, day = table(spark, sf_dir, "events"), F.to_date("ts")
    return e.select(F.col("user_id").alias("instrument"), day.alias("valid_from"), F.when(F.col("event_id") % 9 > 0, F.date_add(day, (F.col("event_id") % 5).cast("int"))).alias("valid_to"), F.date_add(day, (F.col("event_id") % 3).cast("int")).alias("available_time"), "event_id")


@query("membership_at", f"WITH {MEMBER}, mid AS (SELECT min(valid_from) + 15 AS d FROM mb) SELECT event_id, instrument, available_time <= d AS known FROM mb, mid WHERE valid_from <= d AND (valid_to IS NULL OR d < valid_to)", with_panel=False)
def _(spark, sf_dir):
    m = membership(spark, sf_dir)
    at: date = m.agg(F.date_add(F.min("valid_from"), 15)).collect()[0][0]
    return pit.membership_frame(m, at).select("event_id", "instrument", (F.col("available_time") <= F.lit(at)).alias("known"))


@query("membership_overlaps", f"WITH {MEMBER}, o AS (SELECT event_id, bool_or(valid_to IS NULL) OVER w AS open_before, max(valid_to) OVER w AS reach, valid_from FROM mb WINDOW w AS (PARTITION BY instrument ORDER BY valid_from, valid_to NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT count(*) AS n, count(*) FILTER (coalesce(open_before, false) OR coalesce(reach > valid_from, false)) AS overlapping FROM o", with_panel=False)
def _(spark, sf_dir):
    return pit.overlap_frame(membership(spark, sf_dir), identity=["instrument"], valid_from="valid_from", valid_to="valid_to").agg(F.count(F.lit(1)).alias("n"), F.count_if("overlaps").alias("overlapping"))


@query(
    "universe_drift",
    f"""WITH s AS (SELECT DISTINCT time, instrument FROM px), t AS (SELECT time, lead(time) OVER (ORDER BY time) AS nxt FROM (SELECT DISTINCT time FROM s)), z AS (SELECT time, count(*) AS k FROM s GROUP BY time),
c AS (SELECT t.time AS previous_time, t.nxt AS snapshot_time, count(*) AS retained FROM t JOIN s a ON a.time = t.time JOIN s b ON b.time = t.nxt AND a.instrument = b.instrument GROUP BY ALL)
SELECT previous_time, snapshot_time, a.k AS previous_size, b.k AS current_size, b.k - retained AS additions, a.k - retained AS removals, retained, {r('retained / a.k')} AS retention, {r('retained / (a.k + b.k - retained)')} AS jaccard, {r('1.0 - retained / (a.k + b.k - retained)')} AS drift FROM c JOIN z a ON a.time = previous_time JOIN z b ON b.time = snapshot_time""",
)
def _(spark, sf_dir):
    return pit.drift_frame(monthly(spark, sf_dir), snapshot_time="time").drop("universe")


@query("dataset_contract", "SELECT count(*) AS n, count(*) FILTER (l_shipdate IS NULL) AS null_dates, (SELECT CAST(sum(k) AS BIGINT) FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_key_rows FROM lineitem", with_panel=False)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    keyed = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("l_shipdate").isNull()).alias("z"))
    return keyed.agg(F.sum("k").alias("n"), F.sum("z").alias("null_dates"), F.sum(F.when(F.col("k") > 1, F.col("k"))).alias("duplicate_key_rows"))


# Events

EVW = """pr AS (SELECT user_id AS instrument, CAST(date_trunc('day', ts) AS DATE) AS time, arg_max(value, ts) AS close FROM events GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY instrument) - 1 AS last FROM pr),
ev AS (SELECT event_id, user_id AS instrument, CAST(date_trunc('day', ts) AS DATE) AS anchor FROM events WHERE event_type = 'error'),
al AS (SELECT event_id, ev.instrument, ix.time AS anchor_time, i AS anchor_index, close AS anchor_price FROM ev ASOF LEFT JOIN ix ON ev.instrument = ix.instrument AND ev.anchor <= ix.time),
win AS (SELECT al.event_id, al.instrument, anchor_time, o AS "offset", ix.time AS price_time, ix.close / nullif(anchor_price, 0) - 1 AS response FROM al JOIN (SELECT unnest(range(-2, 4)) AS o) ON true LEFT JOIN ix ON ix.instrument = al.instrument AND ix.i = anchor_index + o WHERE anchor_index IS NOT NULL)"""


def _event_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    prices = e.groupBy(F.col("user_id").alias("instrument"), F.col("day").alias("time")).agg(F.max_by("value", "ts").alias("close"))
    ev = e.where("event_type = 'error'").select("event_id", F.col("user_id").alias("instrument"), F.col("day").alias("event_time"), F.col("day").alias("available_time"))
    return ev, prices


def _windows(spark, sf_dir):
    ev, prices = _event_tables(spark, sf_dir)
    aligned = events.aligned_events(ev, prices, before=2, after=3)
    return aligned, events.window_frame(aligned, prices, before=2, after=3)


@query("event_windows", f'WITH {EVW} SELECT event_id, instrument, anchor_time, CAST("offset" AS INT) AS "offset", price_time, {r("response")} AS response FROM win', with_panel=False)
def _(spark, sf_dir):
    return _windows(spark, sf_dir)[1].select("event_id", "instrument", "anchor_time", "offset", "price_time", "response")


@query("event_mean_response", f'WITH {EVW} SELECT CAST("offset" AS INT) AS "offset", {r("avg(response)")} AS mean_response, count(response) AS n FROM win GROUP BY ALL', with_panel=False)
def _(spark, sf_dir):
    return _windows(spark, sf_dir)[1].groupBy("offset").agg(F.avg("response").alias("mean_response"), F.count("response").alias("n"))


@query("event_clusters", f"WITH {EVW}, s AS (SELECT event_id, instrument, anchor_index - 2 AS a, anchor_index + 3 AS b FROM al WHERE anchor_index IS NOT NULL), f AS (SELECT *, CAST(coalesce(a > max(b) OVER (PARTITION BY instrument ORDER BY a, b, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS INT) AS begins FROM s), c AS (SELECT event_id, instrument, CAST(sum(begins) OVER (PARTITION BY instrument ORDER BY a, b, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f) SELECT *, count(*) OVER (PARTITION BY instrument, cluster) > 1 AS overlaps FROM c", with_panel=False)
def _(spark, sf_dir):
    return events.cluster_frame(_windows(spark, sf_dir)[0]).select("event_id", "instrument", "cluster", "overlaps")


# Cross-validation


def _cv_rows(spark, sf_dir) -> DataFrame:
    lab = label_panel(spark, sf_dir).where("horizon = '3D'")
    return lab.select("observation_time", "label_start", "label_end", F.concat_ws("/", F.col("observation_time").cast("string"), F.col("instrument").cast("string")).alias("row_id"))


CVR = "cvr AS (SELECT observation_time AS t, observation_time AS s, label_end AS e, CAST(observation_time AS VARCHAR) || '/' || CAST(instrument AS VARCHAR) AS row_id FROM labels WHERE horizon = '3D'), tm AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM cvr)), gr AS (SELECT t, i, CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // (n // {k}) END AS g FROM tm)"
ROLE = "CASE WHEN tested THEN 'test' WHEN overlap THEN 'purged' WHEN embargo THEN 'embargoed' ELSE 'train' END"


@query("purged_kfold", "WITH " + CVR.format(k=4) + f", fold AS (SELECT g AS fold, max(i) AS last FROM gr GROUP BY g), ts AS (SELECT DISTINCT g AS fold, c.s, c.e FROM cvr c JOIN gr USING (t)), x AS (SELECT fold, c.row_id, gr.g = fold AS tested, EXISTS (SELECT 1 FROM ts WHERE ts.fold = f.fold AND c.s < ts.e AND c.e > ts.s) AS overlap, gr.i > last AND gr.i <= last + 2 AS embargo FROM cvr c JOIN gr USING (t) JOIN fold f ON true) SELECT CAST(fold AS INT) AS fold, row_id, {ROLE} AS role FROM x")
def _(spark, sf_dir):
    return cv.PurgedKFold(4, embargo=2).split(_cv_rows(spark, sf_dir)).assignments


@query("combinatorial_purged_kfold", "WITH " + CVR.format(k=4) + f", cb AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM (SELECT unnest(range(0, 4)) AS a) JOIN (SELECT unnest(range(0, 4)) AS b) ON a < b), mem AS (SELECT fold, a AS g FROM cb UNION ALL SELECT fold, b FROM cb), lst AS (SELECT fold, g, max(i) AS last FROM mem JOIN gr USING (g) GROUP BY ALL), ts AS (SELECT DISTINCT fold, c.s, c.e FROM cvr c JOIN gr USING (t) JOIN mem USING (g)), x AS (SELECT cb.fold, c.row_id, gr.g IN (cb.a, cb.b) AS tested, EXISTS (SELECT 1 FROM ts WHERE ts.fold = cb.fold AND c.s < ts.e AND c.e > ts.s) AS overlap, EXISTS (SELECT 1 FROM lst WHERE lst.fold = cb.fold AND gr.i > last AND gr.i <= last + 1) AS embargo FROM cvr c JOIN gr USING (t) JOIN cb ON true) SELECT CAST(fold AS INT) AS fold, row_id, {ROLE} AS role FROM x")
def _(spark, sf_dir):
    return cv.CombinatorialPurgedKFold(4, 2, embargo=1).split(_cv_rows(spark, sf_dir)).assignments


@query("walk_forward", "WITH " + CVR.format(k=4) + ", f AS (SELECT unnest(range(0, 40)) AS fold), x AS (SELECT fold, row_id, CASE WHEN i >= fold * 12 AND i < fold * 12 + 24 THEN 'train' WHEN i >= fold * 12 + 24 AND i < fold * 12 + 36 THEN 'test' END AS role FROM cvr JOIN tm USING (t) JOIN f ON fold * 12 + 36 <= n) SELECT CAST(fold AS INT) AS fold, row_id, role FROM x WHERE role IS NOT NULL")
def _(spark, sf_dir):
    return cv.WalkForward(24, 12).split(_cv_rows(spark, sf_dir), time="observation_time").assignments


# Costs

MODELS = (costs.CommissionModel(fixed=1.0, bps=5.0, minimum=2.0), costs.SpreadModel(bps=8.0), costs.SlippageModel(per_unit=0.01, bps=2.0), costs.VolatilitySlippageModel(0.1), costs.ParticipationImpactModel(0.5, exponent=0.7, cap=0.02), costs.SquareRootImpactModel(0.3), costs.BorrowCostModel())


@query(
    "cost_models",
    f"""WITH {TR}, c AS (SELECT instrument, CASE WHEN q = 0 THEN 0.0 ELSE greatest(1.0 + 5.0 / 1e4 * v, 2.0) END AS a, v * 8.0 / 1e4 * 0.5 AS b, 0.01 * q + 2.0 / 1e4 * v AS c, v * 0.1 * volatility AS d,
 v * least(0.5 * volatility * pow(q / adv, 0.7), 0.02) AS e, v * 0.3 * volatility * sqrt(q / adv) AS f, CASE WHEN side = 'sell' THEN v * borrow_rate * holding_days / 365.0 ELSE 0.0 END AS g FROM ok)
SELECT instrument, count(*) AS n, {r('sum(a)', 1)} AS commission, {r('sum(b)', 1)} AS spread, {r('sum(c)', 1)} AS slippage, {r('sum(d)', 1)} AS volatility_slippage, {r('sum(e)', 1)} AS participation_impact, {r('sum(f)', 1)} AS square_root_impact, {r('sum(g)', 1)} AS borrow, count(g) AS known FROM c GROUP BY instrument""",
    with_panel=False,
    places=1,
)
def _(spark, sf_dir):
    t = costs.cost_frame(valid_trades(spark, sf_dir), MODELS)
    return t.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"cost_{m.name}").alias(m.name) for m in MODELS], F.count("total_cost").alias("known"))


@query("stress_surface", f"WITH {TR}, p AS (SELECT date_trunc('month', execution_time) AS period, sum(gross_pnl) AS g, sum(v) AS v FROM ok GROUP BY 1), s AS (SELECT row_number() OVER () - 1 AS k, a, b FROM (SELECT unnest([0.0, 5.0, 10.0]) AS a) JOIN (SELECT unnest([0.0, 2.0, 4.0]) AS b) ON true) SELECT {r('a')} AS spread_bps, {r('b')} AS slippage_bps, {r('sum(g)')} AS gross_pnl, {r('sum(g - v * (a / 2 + b) / 1e4)')} AS net_pnl, {r('avg(g - v * (a / 2 + b) / 1e4) / stddev_samp(g - v * (a / 2 + b) / 1e4)')} AS net_sharpe FROM p JOIN s ON true GROUP BY a, b", with_panel=False)
def _(spark, sf_dir):
    t = valid_trades(spark, sf_dir).withColumn("period", F.date_trunc("month", "execution_time"))
    grid = costs.scenarios_of([0.0, 5.0, 10.0], [0.0, 2.0, 4.0], [0.0], None)
    return costs.stress_frame(costs.trade_sums(t, period="period"), grid).select("spread_bps", "slippage_bps", "gross_pnl", "net_pnl", "net_sharpe")


@query("liquidity", f"WITH {TR} SELECT CASE WHEN q / adv > 0.04 THEN 'breach' ELSE 'pass' END AS liquidity, count(*) AS n, {r('avg(q / adv)')} AS mean_participation, {r('quantile_cont(q / adv, 0.95)')} AS p95 FROM ok GROUP BY 1", with_panel=False)
def _(spark, sf_dir):
    t = costs.liquidity_frame(valid_trades(spark, sf_dir), max_participation=0.04)
    return t.groupBy("liquidity").agg(F.count(F.lit(1)).alias("n"), F.avg("participation").alias("mean_participation"), F.percentile("participation", F.lit(0.95)).alias("p95"))


@query("capacity_curve", f"WITH {TR}, o AS (SELECT sum(gross_pnl) AS g, sum(v) AS v, sum(v * volatility * sqrt(q / adv)) AS u FROM ok), c AS (SELECT unnest([1e6, 4e6, 1.6e7]) AS capital), m AS (SELECT unnest([0.5, 1.0]) AS k) SELECT CAST(k * 2 - 1 AS INT) AS scenario, CAST(capital AS DOUBLE) AS capital, {r('u * k * pow(capital / 1e6, 1.5)')} AS impact_cost, {r('g * capital / 1e6 - u * k * pow(capital / 1e6, 1.5) - v * capital / 1e6 * 2.0 / 1e4')} AS net_pnl, (SELECT count(*) FROM ok WHERE q / adv * (capital / 1e6) > 0.1) AS breach_rows FROM o JOIN c ON true JOIN m ON true", with_panel=False)
def _(spark, sf_dir):
    f = costs.capacity_frame(valid_trades(spark, sf_dir), capital=[1e6, 4e6, 1.6e7], base_capital=1e6, scenarios=[{"impact_coefficient": 0.5, "linear_bps": 2.0}, {"impact_coefficient": 1.0, "linear_bps": 2.0}])
    return f.select("scenario", "capital", "impact_cost", "net_pnl", "breach_rows")


@query("break_even_net_pnl", f"WITH {TR} SELECT {r('sum(gross_pnl) / sum(v) * 1e4')} AS break_even_bps FROM ok", with_panel=False)
def _(spark, sf_dir):
    s = costs.trade_sums(valid_trades(spark, sf_dir))
    return s.select((F.col("gross") / F.col("notional") * 1e4).alias("break_even_bps"))


# Regimes, inference, options


def _series(spark, sf_dir) -> DataFrame:
    return monthly(spark, sf_dir).groupBy("time").agg(F.round(F.avg("close"), 4).alias("value"), F.round(F.avg("signal") - F.lit(0.05), 12).alias("outcome"))


SER = "ser AS (SELECT time, round(avg(close), 4) AS value, round(avg(signal) - 0.05::DOUBLE, 12) AS outcome FROM px GROUP BY time)"


def _quantile_sql(frame: str) -> str:
    return f"WITH {SER}, h AS (SELECT time, value, outcome, count(value) OVER w AS history_count, quantile_cont(value, 0.33) OVER w AS lo, quantile_cont(value, 0.67) OVER w AS hi FROM ser WINDOW w AS (ORDER BY time ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING)), g AS (SELECT *, CASE WHEN history_count < 12 THEN 'unknown' WHEN value <= lo THEN 'low' WHEN value >= hi THEN 'high' ELSE 'middle' END AS regime FROM h)"


def _regimes(method: str, window: int | None = None):
    def run(spark, sf_dir):
        f = regime.threshold_frame(_series(spark, sf_dir), method=method, lower=0.33, upper=0.67, min_history=12, window=window)
        return regime.label_frame(f).select("time", "value", "threshold_lower", "threshold_upper", "history_count", "regime")

    return run


_OUT = f" SELECT time, {r('value')} AS value, {r('CASE WHEN history_count >= 12 THEN lo END')} AS threshold_lower, {r('CASE WHEN history_count >= 12 THEN hi END')} AS threshold_upper, history_count, regime FROM g"
query("regime_expanding", _quantile_sql("UNBOUNDED") + _OUT)(_regimes("expanding"))
query("regime_rolling", _quantile_sql("24") + _OUT)(_regimes("rolling", 24))


@query("regime_summary", _quantile_sql("UNBOUNDED") + f", c AS (SELECT *, sum(outcome) OVER (PARTITION BY regime ORDER BY time ROWS UNBOUNDED PRECEDING) AS cum, lag(outcome) OVER (PARTITION BY regime ORDER BY time) AS prev FROM g), d AS (SELECT *, cum - greatest(0.0, max(cum) OVER (PARTITION BY regime ORDER BY time ROWS UNBOUNDED PRECEDING)) AS down FROM c), s AS (SELECT regime, count(*) AS valid_count, avg(outcome) AS mean, stddev_samp(outcome) AS std, sum(outcome) AS total, sum(abs(outcome)) AS absolute_total, min(down) AS max_drawdown FROM d GROUP BY regime) SELECT regime, valid_count, {r('mean', 9)} AS mean, {r('std', 9)} AS std, {r('total', 9)} AS total, {r('max_drawdown', 9)} AS max_drawdown, {r('absolute_total / sum(absolute_total) OVER ()', 9)} AS absolute_share, {r('sum(total) OVER () - total', 9)} AS leave_one_out_total FROM s", places=9)
def _(spark, sf_dir):
    f = regime.label_frame(regime.threshold_frame(_series(spark, sf_dir), method="expanding", lower=0.33, upper=0.67, min_history=12))
    return regime.analysis_frame(f).select("regime", "valid_count", "mean", "std", "total", "max_drawdown", "absolute_share", "leave_one_out_total")


def _p_values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("trial_id"), (F.pow((F.col("p_partkey") * 37 % 997 + 1) / 1000.0, F.lit(3.0))).alias("p_value"))


PV = "pv AS (SELECT p_partkey AS trial_id, pow((p_partkey * 37 % 997 + 1) / 1000.0, 3.0) AS p_value FROM part), k AS (SELECT *, row_number() OVER (ORDER BY p_value, trial_id) AS i, count(*) OVER () AS m FROM pv)"


def _adjust(method: str):
    def run(spark, sf_dir):
        return infer.adjusted_frame(_p_values(spark, sf_dir), method=method).select("trial_id", "adjusted_p_value")

    return run


_UP = "OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
query("multiple_testing_bonferroni", f"WITH {PV} SELECT trial_id, {r('least(1.0, p_value * m)')} AS adjusted_p_value FROM k", with_panel=False)(_adjust("bonferroni"))
query("multiple_testing_holm", f"WITH {PV} SELECT trial_id, {r('least(1.0, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))')} AS adjusted_p_value FROM k", with_panel=False)(_adjust("holm"))
query("multiple_testing_bh", f"WITH {PV} SELECT trial_id, {r(f'least(1.0, min(p_value * m / i) {_UP})')} AS adjusted_p_value FROM k", with_panel=False)(_adjust("bh"))
query("multiple_testing_by", f"WITH {PV}, h AS (SELECT *, sum(1.0 / i) OVER () AS c FROM k) SELECT trial_id, {r(f'least(1.0, min(p_value * m * c / i) {_UP})')} AS adjusted_p_value FROM h", with_panel=False)(_adjust("by"))


@query("sharpe_moments", f"WITH z AS (SELECT horizon, count(*) AS n, avg(y) AS m, stddev_samp(y) AS s, stddev_pop(y) AS p FROM panel GROUP BY horizon) SELECT horizon, any_value(n) AS n, {r('any_value(m)')} AS mean, {r('any_value(s)')} AS std, {r('avg(pow((y - m) / p, 3))')} AS skewness, {r('avg(pow((y - m) / p, 4))')} AS kurtosis FROM panel JOIN z USING (horizon) GROUP BY horizon")
def _(spark, sf_dir):
    return infer.moment_frame(panel(spark, sf_dir), "y", ["horizon"])


def _chain(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.lit(date(2024, 1, 2)).alias("time"), k.alias("instrument"), F.col("p_brand").alias("underlying"), F.date_add(F.lit(date(2024, 1, 2)), (30 + k % 700).cast("int")).alias("expiration"), (F.col("p_retailprice") * (0.8 + (k % 5) * 0.1)).alias("strike"), F.when(k % 2 == 0, "call").otherwise("put").alias("option_type"), (F.col("p_size") * 1.0).alias("bid"), (F.col("p_size") * 1.1).alias("ask"), F.col("p_retailprice").alias("underlying_price"), F.lit(0.04).alias("rate"), F.lit(0.01).alias("dividend"), ((k % 101) / 100.0).alias("delta"), (0.2 + (k % 17) / 100.0).alias("iv"), (0.2 + (k % 13) / 100.0).alias("expected_iv"))


CH = "ch AS (SELECT p_partkey AS instrument, p_brand AS underlying, p_partkey % 700 + 30 AS days, p_retailprice * (0.8::DOUBLE + (p_partkey % 5) * 0.1::DOUBLE) AS strike, p_size * 1.0 AS bid, p_size * 1.1 AS ask, p_retailprice AS s, (p_partkey % 101) / 100.0 AS delta, (p_partkey % 17) / 100.0 - (p_partkey % 13) / 100.0 AS res FROM part)"


@query("option_coordinates", f"WITH {CH}, f AS (SELECT *, days / 365.25 AS t, s * exp(0.03 * days / 365.25) AS fwd FROM ch) SELECT instrument, {r('(bid + ask) / 2')} AS mid, {r('t')} AS time_to_expiry, {r('fwd')} AS forward, {r('ln(strike / fwd)')} AS log_moneyness FROM f", with_panel=False)
def _(spark, sf_dir):
    return options.coordinate_frame(_chain(spark, sf_dir)).select("instrument", "mid", "time_to_expiry", "forward", "log_moneyness")


@query("option_delta_buckets", f"WITH {CH} SELECT CASE WHEN delta < 0.25 THEN '[0,0.25)' WHEN delta < 0.5 THEN '[0.25,0.5)' ELSE '[0.5,1]' END AS delta_bucket, count(*) AS n FROM ch GROUP BY 1", with_panel=False)
def _(spark, sf_dir):
    return options.delta_bucket_frame(_chain(spark, sf_dir), (0.0, 0.25, 0.5, 1.0)).groupBy("delta_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("option_residuals", f"WITH {CH} SELECT underlying, count(res) AS n, {r('avg(res)', 9)} AS mean_residual, {r('median(res)', 9)} AS median_residual, {r('sqrt(avg(res * res))', 9)} AS rmse FROM ch GROUP BY underlying", with_panel=False, places=9)
def _(spark, sf_dir):
    f = options.residual_frame(_chain(spark, sf_dir), by=["underlying"])
    return f.select("underlying", "n", "mean_residual", "median_residual", "rmse")


def rank_panel(spark, sf_dir) -> DataFrame:
    df = monthly(spark, sf_dir)
    return df.select("time", "instrument", average_rank("signal", ["time"]).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("time")).alias("n"))


query("average_ranks", f"SELECT time, instrument, {r(rank('signal', 'time'))} AS rank, count(*) OVER (PARTITION BY time) AS n FROM px")(rank_panel)


# Queries on evidence register themselves here.
from panelwright.plans import evidence  # noqa: E402, F401
