"""Queries of data quality (Q), the registry (J, D), views (P), performance (V), redundancy (X) and configuration (Z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import backtest as bt
from ruleloom.operators import gate as gt
from ruleloom.operators import performance as pe
from ruleloom.operators import quality as qa
from ruleloom.operators import registry as rg
from ruleloom.plans.q_backtest import _PF, KEYS, LONG, backtest, ledger_sql
from ruleloom.plans.q_events import EVENTS_SQL, fixed_activations, fixed_events, kpi
from ruleloom.plans.registry import query, rounded, s_lag
from ruleloom.sources.bars import ORDER_BARS_SQL as BARS
from ruleloom.sources.bars import order_bars, table

# --- quality -----------------------------------------------------------------------------------------

_P = ("open", "high", "low", "close")


@query("q2_schema_counts", f"WITH {BARS} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS rows, sum(({c} IS NULL)::INT)::BIGINT AS nulls, sum(coalesce({c} <= 0, false)::INT)::BIGINT AS not_positive, sum(coalesce(isinf({c}), false)::INT)::BIGINT AS infinite FROM bars" for c in _P))
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.schema_counts(order_bars(spark, sf_dir))


_MAG = f"WITH {BARS}, v AS (" + " UNION ALL ".join(f"SELECT {c} AS v FROM bars" for c in _P) + "), g AS (SELECT floor(log10(v))::INTEGER AS magnitude, count(*) AS n FROM v WHERE v > 0 GROUP BY 1)"


@query("q3_magnitudes", f"{_MAG} SELECT magnitude, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share FROM g")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.magnitudes(order_bars(spark, sf_dir)))


@query("q3_mixed_scale", f"{_MAG}, s AS (SELECT *, n / sum(n) OVER () AS s FROM g) SELECT count(*)::BIGINT AS occupied, (max(magnitude) - min(magnitude))::INTEGER AS span, count(*) >= 2 AND max(magnitude) - min(magnitude) >= 2 AS mixed FROM s WHERE s >= 0.005")
def q3b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.scale_is_mixed(qa.magnitudes(order_bars(spark, sf_dir)))


@query(
    "q4_ohlc_violations",
    f"WITH {BARS} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS \"check\", coalesce(sum(coalesce({c}, false)::INT), 0)::BIGINT AS violations FROM bars"
        for k, c in {
            "high_below_low": "high < low",
            "high_not_max": "high < greatest(open, high, low, close)",
            "low_not_min": "low > least(open, high, low, close)",
            "close_outside": "close > high OR close < low",
            "open_outside": "open > high OR open < low",
            "wide_bar": "least(open, high, low, close) > 0 AND greatest(open, high, low, close) / least(open, high, low, close) > 2",
        }.items()
    ),
)
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.ohlc_violations(order_bars(spark, sf_dir))


_RET = f"r AS (SELECT ticker, rn, close / nullif({s_lag('close')}, 0) - 1 AS r FROM bars), x AS (SELECT * FROM r WHERE r IS NOT NULL), m AS (SELECT ticker, median(r) AS med FROM x GROUP BY 1), d AS (SELECT x.ticker, median(abs(r - med)) AS mad FROM x JOIN m USING (ticker) GROUP BY 1)"


@query("q5_return_outliers", f"WITH {BARS}, {_RET} SELECT x.ticker, count(*)::BIGINT AS n, round(any_value(med), 6) + 0.0::DOUBLE AS median, round(any_value(mad), 6) AS mad, sum((abs(r - med) / (1.4826 * mad) > 8)::INT)::BIGINT AS robust_outliers, sum((abs(r) > 0.5)::INT)::BIGINT AS extreme_moves FROM x JOIN m USING (ticker) JOIN d USING (ticker) GROUP BY 1")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.return_outliers(order_bars(spark, sf_dir)))


@query("q5_worst_moves", f"WITH {BARS}, r AS (SELECT *, {s_lag('close')} AS before, close / nullif({s_lag('close')}, 0) - 1 AS r FROM bars), w AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY abs(r) DESC, rn) AS place FROM r WHERE r IS NOT NULL AND r <> 0) SELECT ticker, place::INTEGER AS place, rn::BIGINT AS rn, open_dt, before, close, round(r, 6) AS r FROM w WHERE place <= 5")
def q5b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(qa.worst_moves(order_bars(spark, sf_dir)).withColumn("rn", F.col("rn").cast("long")))


@query(
    "q6_time_continuity",
    """WITH e AS (SELECT event_type AS ticker, event_id, date_trunc('minute', ts) AS open_dt FROM events), d AS (SELECT *, epoch(open_dt) - lag(epoch(open_dt)) OVER (PARTITION BY ticker ORDER BY event_id) AS s, row_number() OVER (PARTITION BY ticker, open_dt ORDER BY event_id) > 1 AS dup FROM e),
k AS (SELECT ticker, s, count(*) AS k FROM d WHERE s > 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY k DESC, s) AS r FROM k), m AS (SELECT ticker, s AS modal FROM o WHERE r = 1)
SELECT d.ticker, sum(dup::INT)::BIGINT AS duplicates, sum(coalesce(s < 0, false)::INT)::BIGINT AS out_of_order, any_value(modal)::DOUBLE AS modal_s, sum(coalesce(s > modal, false)::INT)::BIGINT AS above_modal, sum(coalesce(s > greatest(3 * modal, modal + 172800), false)::INT)::BIGINT AS suspicious FROM d LEFT JOIN m USING (ticker) GROUP BY 1""",
)
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("open_dt"))
    return qa.time_continuity(e, "event_id")


@query("q7_overview", f"WITH {BARS} SELECT ticker, count(*)::BIGINT AS rows, min(open_dt) AS first_dt, max(open_dt) AS last_dt, date_diff('day', min(open_dt), max(open_dt))::INTEGER AS days FROM bars GROUP BY 1")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.overview(order_bars(spark, sf_dir))


# --- registry ----------------------------------------------------------------------------------------

_RULES = f"{EVENTS_SQL}, {ledger_sql([LONG])}, ru AS (SELECT ticker || '/' || event_id AS rule_id, l.fdt AS dt, net AS gain FROM l)"


def rule_gains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trades and gains of the rules of all tickers; a rule is an event on a ticker."""
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    ledger = ledger.withColumn("rule_id", F.concat_ws("/", "ticker", "event_id"))
    return ledger, gains_of(ledger)


def gains_of(ledger: DataFrame) -> DataFrame:
    return ledger.select("rule_id", F.col("fill_dt").alias("dt"), F.col("net_pct_gain").alias("gain"))


_J1 = "dd AS (SELECT DISTINCT rule_id, dt FROM ru), nn AS (SELECT rule_id, count(*) AS n FROM dd GROUP BY 1), mm AS (SELECT x.rule_id AS a, y.rule_id AS b, count(*) AS s FROM dd x JOIN dd y ON x.dt = y.dt AND x.rule_id < y.rule_id GROUP BY 1, 2), jc AS (SELECT a AS rule_a, b AS rule_b, s / (p.n + q.n - s) AS jaccard FROM mm JOIN nn p ON mm.a = p.rule_id JOIN nn q ON mm.b = q.rule_id)"


@query("j1_jaccard_by_date", f"WITH {_RULES}, {_J1} SELECT rule_a, rule_b, round(jaccard, 6) AS jaccard FROM jc")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.jaccard_by_date(rule_gains(spark, sf_dir)[1]))


@query(
    "j2_gain_correlation",
    f"""WITH {_RULES}, gg AS (SELECT rule_id, dt, sum(round(gain, 9)) AS g FROM ru GROUP BY 1, 2), id AS (SELECT DISTINCT rule_id FROM gg), pp AS (SELECT p.rule_id AS ra, q.rule_id AS rb FROM id p JOIN id q ON p.rule_id < q.rule_id),
al AS (SELECT ra, rb, dt, sum(CASE WHEN rule_id = ra THEN g ELSE 0 END) AS ga, sum(CASE WHEN rule_id = rb THEN g ELSE 0 END) AS gb FROM pp JOIN gg ON rule_id IN (ra, rb) GROUP BY 1, 2, 3), nz AS (SELECT * FROM al WHERE ga <> 0 OR gb <> 0),
rk AS (SELECT ra, rb, rank() OVER (PARTITION BY ra, rb ORDER BY ga) + (count(*) OVER (PARTITION BY ra, rb, ga) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY ra, rb ORDER BY gb) + (count(*) OVER (PARTITION BY ra, rb, gb) - 1) / 2.0::DOUBLE AS y FROM nz)
SELECT ra AS rule_a, rb AS rule_b, count(*)::BIGINT AS n, round(CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(corr(x, y), 0) END, 5) + 0.0::DOUBLE AS spearman FROM rk GROUP BY 1, 2""",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rule_gains(spark, sf_dir)[1].withColumn("gain", F.round("gain", 9))
    return rounded(rg.gain_correlation(g), 5)


@query("j3_correlation_maxima", f"WITH {_RULES}, {_J1} SELECT rule_id, round(max(jaccard), 6) AS jaccard FROM (SELECT rule_a AS rule_id, jaccard FROM jc UNION ALL SELECT rule_b, jaccard FROM jc) GROUP BY 1")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.maxima(rg.jaccard_by_date(rule_gains(spark, sf_dir)[1]), "jaccard"))


@query(
    "j4_duplicates",
    f"""WITH {_RULES}, {_J1}, pf AS (SELECT ticker || '/' || event_id AS rule_id, round({_PF}, 9) AS pf FROM l GROUP BY 1), bo AS (SELECT rule_a AS rule_id, rule_b AS other FROM jc WHERE jaccard > 0.1 UNION ALL SELECT rule_b, rule_a FROM jc WHERE jaccard > 0.1),
dm AS (SELECT bo.rule_id, other, q.pf AS o, row_number() OVER (PARTITION BY bo.rule_id ORDER BY q.pf, other) AS r FROM bo JOIN pf p ON p.rule_id = bo.rule_id JOIN pf q ON q.rule_id = other WHERE q.pf > p.pf) SELECT pf.rule_id, other AS duplicate_of FROM pf LEFT JOIN dm ON dm.rule_id = pf.rule_id AND r = 1""",
)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, gains = rule_gains(spark, sf_dir)
    factors = ledger.groupBy("rule_id").agg(F.round(bt.profit_factor(), 9).alias("pf"))
    return rg.mark_duplicates(factors, rg.jaccard_by_date(gains), 0.1)


_CROSS = f"{EVENTS_SQL}, {ledger_sql([LONG])}, pf AS (SELECT ticker, event_id, {_PF} AS pf FROM l GROUP BY 1, 2), cr AS (SELECT x.event_id, x.ticker, x.pf, x.pf >= greatest(1.5, 0.8 * h.pf) AS passed FROM pf x JOIN pf h ON h.event_id = x.event_id AND h.ticker = '1-URGENT' WHERE x.ticker <> '1-URGENT')"


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    s = ledger.groupBy(*KEYS).agg(bt.profit_factor().alias("profit_factor"))
    return rg.cross_ticker(s, s.where("ticker = '1-URGENT'"))


@query("j5_cross_ticker", f"WITH {_CROSS} SELECT event_id, ticker, round(pf, 5) AS profit_factor, passed FROM cr")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(crossed(spark, sf_dir), 5)


@query(
    "j6_recalibrated_threshold",
    f"""WITH {EVENTS_SQL}, x AS (SELECT ticker, (close - close_sma_20) / nullif(close_sma_20, 0) AS x FROM k), q AS (SELECT avg((x <= -0.1)::INT) AS q FROM x WHERE ticker = '1-URGENT' AND x IS NOT NULL), s AS (SELECT list_sort(list(x)) AS v, count(x) AS n FROM x WHERE ticker = '5-LOW' AND x IS NOT NULL),
p AS (SELECT v, q * (n - 1) AS z FROM s, q) SELECT round(v[floor(z)::INT + 1] + (z - floor(z)) * (v[ceil(z)::INT + 1] - v[floor(z)::INT + 1]), 6) AS threshold FROM p""",
)
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = kpi(order_bars(spark, sf_dir))
    e = rg.recalibrate(fixed_events()[0], bars.where("ticker = '1-URGENT'"), bars.where("ticker = '5-LOW'"))
    return rounded(spark.createDataFrame([(float(e.components[0].threshold),)], "threshold double"))


@query("j7_genericity", f"WITH {_CROSS}, g AS (SELECT event_id, sum(passed::INT) AS p, count(*) AS n FROM cr GROUP BY 1) SELECT event_id, p::BIGINT AS n_passed, n::BIGINT AS n_tickers, CASE WHEN p / n >= 1 THEN 'GENERIC' WHEN p / n >= 2 / 3 THEN 'PARTIAL' WHEN p > 0 THEN 'SPECIFIC' ELSE 'ISOLATED' END AS genericity FROM g")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.genericity_of(crossed(spark, sf_dir))


_T = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("j10_flat_table", f"WITH {_CROSS} SELECT event_id, " + ", ".join(f"round(max(pf) FILTER (ticker = '{t}'), 5) AS \"{t}\"" for t in _T) + " FROM cr GROUP BY 1")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rg.flat_table(crossed(spark, sf_dir), list(_T)), 5)


@query("j8_ingested_monthly_gains", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, ok AS (SELECT ticker, event_id FROM l GROUP BY 1, 2 HAVING {_PF} >= 1.5) SELECT l.ticker, l.event_id, (year(fdt) * 12 + month(fdt))::INTEGER AS month, round(sum(net), 5) + 0.0::DOUBLE AS gain, count(*)::BIGINT AS n FROM l SEMI JOIN ok USING (ticker, event_id) GROUP BY 1, 2, 3")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    v = ledger.groupBy(*KEYS).agg(bt.profit_factor().alias("pf")).withColumn("verdict", F.when(F.col("pf") >= 1.5, "EDGE").otherwise("NON-EDGE"))
    return rounded(rg.ingest(v, ledger, *KEYS), 5)


_FOLD = f"{EVENTS_SQL}, {ledger_sql([LONG])}, fo AS (SELECT ticker, event_id, year(fdt) AS y, least({_PF}, 10) AS pf FROM l GROUP BY 1, 2, 3)"


@query("d2_fold_stability", f"WITH {_FOLD} SELECT ticker, event_id, count(*)::BIGINT AS folds, round(avg(pf) - coalesce(stddev_samp(pf), 0), 5) + 0.0::DOUBLE AS score FROM fo GROUP BY 1, 2")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    folds = ledger.groupBy(*KEYS, F.year("fill_dt").alias("y")).agg(bt.profit_factor().alias("pf"))
    return rounded(rg.fold_stability(folds, *KEYS), 5)


@query("d1_promotion_gate", f"WITH {_CROSS}, g AS (SELECT event_id, sum(passed::INT) AS p FROM cr GROUP BY 1) SELECT event_id, p > 0 AS promoted FROM g")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rg.genericity_of(crossed(spark, sf_dir)).withColumn("duplicate_of", F.lit(None).cast("string")).withColumn("verdict", F.lit("EDGE"))
    return rg.promotion_gate(g).select("event_id", "promoted")


# --- views -------------------------------------------------------------------------------------------


@query("p1_conversion_funnel", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])} SELECT 'bars' AS stage, count(*)::BIGINT AS n FROM bars UNION ALL SELECT 'activations', count(*) FROM a UNION ALL SELECT 'trades', count(*) FROM l")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rg.conversion_funnel({"bars": bars, "activations": a, "trades": backtest(spark, sf_dir, [LONG])[1]})


@query("p4_dead_candidates", f"WITH {EVENTS_SQL}, ca AS (SELECT * FROM (VALUES " + ", ".join(f"('{e.event_id}')" for e in fixed_events()) + ", ('E-NONE')) v(event_id)) SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM a) THEN 'actionable' ELSE 'dead' END AS status FROM ca")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = fixed_activations(spark, sf_dir)
    every = spark.createDataFrame([(e.event_id,) for e in fixed_events()] + [("E-NONE",)], "event_id string")
    return rg.dead_candidates(every, a.select("event_id").distinct().withColumn("direction", F.lit("long")))


@query("p6_discard_reasons", f"WITH {EVENTS_SQL}, s AS (SELECT ticker, event_id, count(*) AS n FROM a GROUP BY 1, 2), r AS (SELECT ticker, 'few' AS reason FROM s WHERE n < 300 UNION ALL SELECT ticker, 'many' FROM s WHERE n > 100 UNION ALL SELECT ticker, NULL FROM s WHERE NOT (n < 300 OR n > 100)) SELECT ticker, reason, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = fixed_activations(spark, sf_dir)
    n = a.groupBy("ticker", "event_id").agg(F.count("*").alias("n"))
    return rg.reasons_by(n.withColumn("reasons", F.array_compact(F.array(F.when(F.col("n") < 300, "few"), F.when(F.col("n") > 100, "many")))), "ticker")


@query(
    "p8_duplicate_clusters",
    f"""WITH {_RULES}, {_J1}, pf AS (SELECT ticker || '/' || event_id AS rule_id, round({_PF}, 9) AS pf FROM l GROUP BY 1), bo AS (SELECT rule_a AS rule_id, rule_b AS other FROM jc WHERE jaccard > 0.1 UNION ALL SELECT rule_b, rule_a FROM jc WHERE jaccard > 0.1),
dm AS (SELECT bo.rule_id, other, row_number() OVER (PARTITION BY bo.rule_id ORDER BY q.pf, other) AS r FROM bo JOIN pf p ON p.rule_id = bo.rule_id JOIN pf q ON q.rule_id = other WHERE q.pf > p.pf) SELECT other AS dominant, list_sort(list(rule_id)) AS members FROM dm WHERE r = 1 GROUP BY 1""",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.duplicate_clusters(j4(spark, sf_dir))


@query(
    "x4_redundancy",
    f"""WITH {EVENTS_SQL}, n AS (SELECT ticker, event_id, count(*) AS n FROM a GROUP BY 1, 2), p AS (SELECT x.ticker, x.event_id AS a, y.event_id AS b, count(*) AS s FROM a x JOIN a y ON x.ticker = y.ticker AND x.rn = y.rn AND x.event_id < y.event_id GROUP BY 1, 2, 3)
SELECT p.a, p.b, round(sum(s) / (sum(x.n) + sum(y.n) - sum(s)), 6) AS jaccard FROM p JOIN n x ON x.ticker = p.ticker AND x.event_id = p.a JOIN n y ON y.ticker = p.ticker AND y.event_id = p.b GROUP BY 1, 2""",
)
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = fixed_activations(spark, sf_dir)
    j = gt.overlaps(a).groupBy("a", "b").agg((F.sum("shared") / (F.sum("na") + F.sum("nb") - F.sum("shared"))).alias("jaccard"))
    return rounded(j)


# --- performance -------------------------------------------------------------------------------------

_L = f"{EVENTS_SQL}, {ledger_sql([LONG])}"
_EQ = "OVER (PARTITION BY ticker, event_id ORDER BY xdt, s ROWS UNBOUNDED PRECEDING)"


@query("v1_equity_and_drawdown", f"WITH {_L}, e AS (SELECT ticker, event_id, s, xdt, sum(net) {_EQ} AS eq FROM l) SELECT ticker, event_id, s::BIGINT AS signal_rn, xdt AS exit_dt, round(eq, 5) + 0.0::DOUBLE AS equity, round(eq - greatest(max(eq) {_EQ}, 0), 5) + 0.0::DOUBLE AS drawdown FROM e")
def v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.equity(backtest(spark, sf_dir, [LONG])[1], *KEYS).withColumn("signal_rn", F.col("signal_rn").cast("long")), 5)


@query("v1_monthly", f"WITH {_L} SELECT ticker, event_id, date_trunc('month', fdt)::DATE AS month, count(*)::BIGINT AS n, round(sum(net), 5) + 0.0::DOUBLE AS gain FROM l GROUP BY 1, 2, 3")
def v1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.monthly(backtest(spark, sf_dir, [LONG])[1], *KEYS), 5)


_R90 = "OVER (PARTITION BY ticker, event_id ORDER BY epoch_us(xdt) RANGE BETWEEN 7775999999999 PRECEDING AND CURRENT ROW)"


@query("v2_rolling_expectancy", f"WITH {_L} SELECT ticker, event_id, s::BIGINT AS signal_rn, xdt AS exit_dt, round(CASE WHEN count(*) {_R90} >= 5 THEN avg(net) {_R90} END, 6) + 0.0::DOUBLE AS expectancy FROM l")
def v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.rolling_expectancy(backtest(spark, sf_dir, [LONG])[1], *KEYS).withColumn("signal_rn", F.col("signal_rn").cast("long")))


@query("v3_histogram", f"WITH {_L} SELECT ticker, event_id, least(greatest(floor((net + 0.5) / 1.0 * 20) + 1, 0), 21)::INTEGER AS bin, count(*)::BIGINT AS n FROM l GROUP BY 1, 2, 3")
def v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pe.histogram(backtest(spark, sf_dir, [LONG])[1], *KEYS)


@query(
    "v3_kernel_density",
    f"""WITH {_L}, s AS (SELECT ticker, event_id, count(*) AS n, stddev_samp(net) AS sd, quantile_cont(net, 0.75) - quantile_cont(net, 0.25) AS iq FROM l GROUP BY 1, 2),
b AS (SELECT *, 0.9 * CASE WHEN least(sd, iq / 1.34) > 0 THEN least(sd, iq / 1.34) ELSE sd END * pow(n, -0.2) AS h FROM s) SELECT l.ticker, l.event_id, t.x::DOUBLE AS x, round(sum(exp(-0.5 * pow((t.x - net) / b.h, 2))) / (any_value(b.n) * any_value(b.h) * 2.5066282746310002), 4) AS density
FROM l JOIN b USING (ticker, event_id), (VALUES (-0.25::DOUBLE), (0.125), (0.375)) t(x) WHERE b.h > 1e-9 GROUP BY 1, 2, 3""",
)
def v3b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pe.kernel_density(backtest(spark, sf_dir, [LONG])[1], *KEYS, grid=(-0.25, 0.125, 0.375)), 4)


@query("v5_return_distribution", f"WITH {EVENTS_SQL}, r AS (SELECT ticker, rn, lead(close, 1) OVER (PARTITION BY ticker ORDER BY rn) / close - 1 AS r FROM bars), b AS (SELECT ticker, avg(r) AS bm, stddev_pop(r) AS bs FROM r WHERE r IS NOT NULL GROUP BY 1) SELECT a.ticker, event_id, round(avg(r), 6) + 0.0::DOUBLE AS event_mean, round(stddev_pop(r), 5) AS event_sd, round(any_value(bm), 6) AS base_mean, round(any_value(bs), 5) AS base_sd FROM a JOIN r USING (ticker, rn) JOIN b USING (ticker) WHERE r IS NOT NULL GROUP BY 1, 2")
def v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    r = pe.return_distribution(a, bars)
    return rounded(r.withColumn("event_sd", F.round("event_sd", 5)).withColumn("base_sd", F.round("base_sd", 5)))


@query("z3_poisson_windows", "SELECT * FROM (VALUES (10, 0.5::DOUBLE, " + str(gt.poisson_window(10, 0.5)) + "), (10, 2.0, " + str(gt.poisson_window(10, 2.0)) + ")) t(floor, rate, months)")
def z3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(10, r, gt.poisson_window(10, r)) for r in (0.5, 2.0)], "floor int, rate double, months int")
