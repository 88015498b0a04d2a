"""Queries of regimes (R), memory of prices, and the time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import regime as reg
from ruleloom.plans.registry import over, query, rounded, s_full, s_lag, s_ratio, s_select
from ruleloom.sources import bars as src
from ruleloom.sources.bars import ORDER_BARS_SQL as BARS
from ruleloom.sources.bars import order_bars

#: The ratio of close to its 9-bar mean: a stand-in for the EMA ratio that SQL can express without recursion.
RATIO = f"x AS (SELECT *, {s_ratio('close', s_full('close', 9, 'avg'))} AS v FROM bars)"
CODE = "CASE WHEN v IS NOT NULL THEN (v > 0.975)::INT + (v > 0.99)::INT + (v > 1.01)::INT + (v > 1.025)::INT END"
LABEL = "CASE c WHEN 0 THEN 'STRONG_BEAR' WHEN 1 THEN 'BEAR' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN 'BULL' WHEN 4 THEN 'STRONG_BULL' END"
REGIME = f"{RATIO}, y AS (SELECT *, {CODE} AS c FROM x), z AS (SELECT *, {LABEL} AS regime FROM y)"
RUNS = f"""{REGIME}, u AS (SELECT *, CASE WHEN rn = 0 OR regime IS DISTINCT FROM {s_lag('regime')} THEN 1 ELSE 0 END AS b FROM z),
v AS (SELECT *, sum(b) OVER (PARTITION BY ticker ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM u),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, run ORDER BY rn) AS run_len FROM v)"""


def with_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.functions.windows import full, ratio

    return order_bars(spark, sf_dir).withColumn("v", ratio(F.col("close"), full(F.col("close"), 9, F.avg)))


def with_regime(spark: SparkSession, sf_dir: str, stable: int = 3) -> DataFrame:
    df = with_ratio(spark, sf_dir).withColumn("c", reg.bucket(F.col("v"), reg.THRESHOLDS)).withColumn("regime", reg.label(F.col("c")))
    return reg.with_stability(df, stable)


def long_rn(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.col("rn").cast("long"))


@query(
    "r1_ema_ratio_regime",
    f"""WITH RECURSIVE {BARS}, e AS (SELECT n.*, n.close AS a, n.close AS b FROM bars n WHERE rn = 0 UNION ALL
 SELECT n.*, 0.8 * p.a + 0.2 * n.close, {1 - 2 / 26!r} * p.b + {2 / 26!r} * n.close FROM e p JOIN bars n ON n.ticker = p.ticker AND n.rn = p.rn + 1),
x AS (SELECT ticker, rn, round_even(a, 5) / nullif(round_even(b, 5), 0) AS v FROM e)
SELECT ticker, rn::BIGINT AS rn, round(v, 6) + 0.0::DOUBLE AS ema_ratio, ({CODE})::INTEGER AS regime_code FROM x""",
)
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reg.with_ema_ratio(order_bars(spark, sf_dir)).withColumn("regime_code", reg.bucket(F.col("ema_ratio"), reg.THRESHOLDS))
    return rounded(long_rn(df.select("ticker", "rn", "ema_ratio", "regime_code")))


@query("r2_bucketise", f"WITH {BARS}, {REGIME} SELECT ticker, rn::BIGINT AS rn, c::INTEGER AS code, regime FROM z")
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rn(with_regime(spark, sf_dir).select("ticker", "rn", F.col("c").alias("code"), "regime"))


@query(
    "r3_balanced_thresholds",
    f"""WITH {BARS}, {RATIO}, q AS (SELECT ticker, quantile_cont(v, [0.1, 0.3, 0.7, 0.9]) AS q FROM x GROUP BY ticker)
SELECT x.ticker, x.rn::BIGINT AS rn, CASE WHEN v IS NOT NULL THEN (v > q[1])::INT + (v > q[2])::INT + (v > q[3])::INT + (v > q[4])::INT END::INTEGER AS code FROM x JOIN q USING (ticker)""",
)
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_ratio(spark, sf_dir)
    df = df.join(reg.balanced_thresholds(df, "v"), "ticker")
    return long_rn(df.select("ticker", "rn", reg.bucket(F.col("v"), [F.get("thresholds", i) for i in range(4)]).alias("code")))


_EXP = "OVER (PARTITION BY ticker ORDER BY rn ROWS UNBOUNDED PRECEDING)"


@query(
    "r4_expanding_thresholds",
    f"""WITH {BARS}, {RATIO}, q AS (SELECT *, count(v) {_EXP} AS n, quantile_cont(v, 0.1) {_EXP} AS q1, quantile_cont(v, 0.3) {_EXP} AS q2, quantile_cont(v, 0.7) {_EXP} AS q3, quantile_cont(v, 0.9) {_EXP} AS q4 FROM x),
t AS (SELECT *, CASE WHEN n >= 200 THEN q1 ELSE 0.975 END AS t1, CASE WHEN n >= 200 THEN q2 ELSE 0.99 END AS t2, CASE WHEN n >= 200 THEN q3 ELSE 1.01 END AS t3, CASE WHEN n >= 200 THEN q4 ELSE 1.025 END AS t4 FROM q)
SELECT ticker, rn::BIGINT AS rn, CASE WHEN v IS NOT NULL THEN (v > t1)::INT + (v > t2)::INT + (v > t3)::INT + (v > t4)::INT END::INTEGER AS code FROM t""",
)
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rn(reg.with_expanding_code(with_ratio(spark, sf_dir).select("ticker", "rn", "v"), "v", "code").select("ticker", "rn", "code"))


@query("r5_stability", f"WITH {BARS}, {RUNS} SELECT ticker, rn::BIGINT AS rn, regime, regime IS NOT NULL AND run_len >= 3 AS regime_stable FROM k")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rn(with_regime(spark, sf_dir).select("ticker", "rn", "regime", "regime_stable"))


@query(
    "r6_distribution",
    f"""WITH {BARS}, {REGIME}, s AS (SELECT DISTINCT ticker, unnest(['STRONG_BEAR', 'BEAR', 'NEUTRAL', 'BULL', 'STRONG_BULL']) AS regime FROM bars),
g AS (SELECT s.ticker, s.regime, count(z.regime) AS n FROM s LEFT JOIN z ON z.ticker = s.ticker AND z.regime = s.regime GROUP BY 1, 2)
SELECT ticker, regime, n::BIGINT AS n, round(n / sum(n) OVER (PARTITION BY ticker), 4) AS share FROM g""",
)
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.distribution(with_regime(spark, sf_dir))


@query(
    "r7_regime_lookup",
    f"""WITH {BARS}, {RUNS}, t AS (SELECT ticker, open_dt, regime, run_len >= 3 AND regime IS NOT NULL AS regime_stable FROM k)
SELECT o.o_orderkey, t.regime, t.regime_stable FROM orders o LEFT JOIN t ON t.ticker = o.o_orderpriority AND t.open_dt = o.o_orderdate""",
)
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the regime of their ticker's day, by an equi-join on the lookup table."""
    lookup = reg.regime_table(with_regime(spark, sf_dir))
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("open_dt"))
    return orders.join(lookup, ["ticker", "open_dt"], "left").select("o_orderkey", "regime", "regime_stable")


_D = f"p AS (SELECT *, ln(close) AS p FROM bars), d AS (SELECT *, {s_lag('p')} AS b, p - {s_lag('p')} AS d FROM p)"


@query(
    "r9_derived_ema_windows",
    f"""WITH {BARS}, {_D}, w AS (SELECT ticker, rn, CASE WHEN count(d) {over(99)} >= 99 THEN regr_slope(d, b) {over(99)} END AS s FROM d),
h AS (SELECT ticker, -ln(2) / ln(1 + s) AS h FROM w WHERE rn >= 99 AND (rn - 99) % 20 = 0 AND s < 0 AND s > -1),
m AS (SELECT ticker, median(h) AS m, count(*) AS n FROM h WHERE h <= 100 GROUP BY ticker),
q AS (SELECT *, greatest(round(m)::INT, 2) AS l, greatest(round(m * 0.36)::INT, 1) AS s FROM m)
SELECT t.ticker, CASE WHEN n >= 3 AND s < l THEN s ELSE 9 END::INTEGER AS short, CASE WHEN n >= 3 AND s < l THEN l ELSE 25 END::INTEGER AS long FROM (SELECT DISTINCT ticker FROM bars) t JOIN q USING (ticker)""",
)
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.derive_ema_windows(order_bars(spark, sf_dir), window=100, stride=20)


@query("r10_hurst")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.hurst(order_bars(spark, sf_dir)))


@query("r11_ou_half_life", f"WITH {BARS}, {_D}, g AS (SELECT ticker, regr_slope(d, b) AS s, count(p) AS n FROM d GROUP BY ticker) SELECT ticker, round(s, 6) AS slope, round(CASE WHEN s < 0 AND s > -1 AND -ln(2) / ln(1 + s) <= n THEN -ln(2) / ln(1 + s) END, 6) AS half_life FROM g")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.ou_half_life(order_bars(spark, sf_dir)))


@query(
    "r12_rolling_half_life",
    f"""WITH {BARS}, {_D}, w AS (SELECT ticker, rn, CASE WHEN count(d) {over(99)} >= 99 THEN regr_slope(d, b) {over(99)} END AS s FROM d), h AS (SELECT *, CASE WHEN s < 0 AND s > -1 THEN -ln(2) / ln(1 + s) END AS h FROM w)
SELECT ticker, rn::BIGINT AS rn, round(CASE WHEN h <= 100 THEN h END, 5) AS half_life FROM h WHERE rn >= 99 AND (rn - 99) % 20 = 0""",
)
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_rn(reg.rolling_half_life(order_bars(spark, sf_dir), 100, 20)), 5)


@query(
    "r13_variance_ratio",
    f"""WITH {BARS}, {_D}, w AS (SELECT ticker, d, {s_full('d', 2, 'sum')} AS s2, {s_full('d', 5, 'sum')} AS s5, {s_full('d', 10, 'sum')} AS s10 FROM d),
g AS (SELECT ticker, var_samp(d) AS v, var_samp(s2) AS v2, var_samp(s5) AS v5, var_samp(s10) AS v10 FROM w GROUP BY ticker)
SELECT ticker, 2::INTEGER AS lag, round(v2 / (2 * v), 6) AS ratio FROM g UNION ALL SELECT ticker, 5, round(v5 / (5 * v), 6) FROM g UNION ALL SELECT ticker, 10, round(v10 / (10 * v), 6) FROM g""",
)
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.variance_ratio(order_bars(spark, sf_dir), (2, 5, 10)))


@query("r14_rolling_hurst")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(long_rn(reg.rolling_hurst(order_bars(spark, sf_dir), 256, 64)))


@query(
    "p2_regime_transitions",
    f"""WITH {BARS}, {RUNS}, n AS (SELECT *, lag(regime) {over()} AS f, lag(run_len) {over()} AS l FROM k WHERE regime IS NOT NULL)
SELECT ticker, rn::BIGINT AS rn, open_dt, f AS regime_from, regime AS regime_to, l::INTEGER AS bars_before FROM n WHERE f IS NOT NULL AND regime <> f""",
)
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_rn(reg.transitions(with_regime(spark, sf_dir)))


@query("p3_regime_time_share", f"WITH {BARS}, {REGIME} SELECT ticker, regime, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ticker), 6) AS share FROM z WHERE regime IS NOT NULL GROUP BY ticker, regime")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = with_regime(spark, sf_dir).where("regime is not null").groupBy("ticker", "regime").agg(F.count("*").alias("n"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("ticker"))))


@query("z4_bar_hours", f"WITH {BARS}, d AS (SELECT ticker, (epoch(open_dt) - epoch({s_lag('open_dt')})) / 3600.0::DOUBLE AS h FROM bars) SELECT ticker, median(h) AS bar_hours FROM d GROUP BY ticker")
def z4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bar_hours(order_bars(spark, sf_dir))


@query("io7_timestamp_units", "SELECT event_id, ts AS from_s, ts AS from_ms, ts AS from_us FROM (SELECT event_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS ts FROM events)")
def io7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    return e.select("event_id", src.to_time(F.col("s"), "s").alias("from_s"), src.to_time(F.col("s") * 1000, "ms").alias("from_ms"), src.to_time(F.col("s") * 1000000, "us").alias("from_us"))


@query("io8_epoch_unit", "SELECT * FROM (VALUES ('s', 's'), ('ms', 'ms'), ('us', 'us'), ('ns', 'ns')) t(scaled, found)")
def io8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    found = [(u, src.epoch_unit(e.withColumn("x", F.col("s") * f), "x")) for u, f in (("s", 1.0), ("ms", 1e3), ("us", 1e6), ("ns", 1e9))]
    return spark.createDataFrame(found, "scaled string, found string")


@query(
    "m28_return_autocorrelation",
    f"WITH {BARS}, r AS (SELECT *, close / nullif({s_lag('close')}, 0) - 1 AS r FROM bars), l AS (SELECT *, "
    + ", ".join(f"{s_lag('r', k)} AS l{k}" for k in (1, 2, 3, 6, 12, 24))
    + " FROM r) "
    + " UNION ALL ".join(f"SELECT ticker, {k}::INTEGER AS lag, round(corr(r, l{k}), 6) AS acf FROM l GROUP BY ticker" for k in (1, 2, 3, 6, 12, 24)),
)
def m28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.acf(order_bars(spark, sf_dir)))


del s_select
