"""Queries of what a session chains: selection spans, entries, registries, settings, and the small helpers of each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.windows import with_rn
from ruleloom.operators import alpha as al
from ruleloom.operators import backtest as bt
from ruleloom.operators import compose as co
from ruleloom.operators import events as ev
from ruleloom.operators import features as ft
from ruleloom.operators import gate as gt
from ruleloom.operators import regime as reg
from ruleloom.operators import registry as rg
from ruleloom.plans import settings
from ruleloom.plans.q_alpha import _TARGETS, study, target
from ruleloom.plans.q_alpha import HIT as _HIT
from ruleloom.plans.q_alpha import _LIFT
from ruleloom.plans.q_backtest import _PF, _WALK, GRID, KEYS, LONG, MARKET, SHORT, backtest, ledger_sql
from ruleloom.plans.q_events import _MET, BASE5, EVENTS_SQL, fixed_activations, fixed_events, kpi
from ruleloom.plans.q_regime import RUNS, with_regime
from ruleloom.plans.registry import query, rounded
from ruleloom.sources.bars import ORDER_BARS_SQL as BARS
from ruleloom.sources.bars import order_bars, table

# --- discovery on the selection span -----------------------------------------------------------------

#: The walk with one more window, from the first train bar to the last one; its number is odd, so that no cell is chosen in it.
_SPAN = _WALK.replace("FROM wf)", "FROM wf UNION ALL SELECT 1001, min(from_dt), max(to_dt) FROM wf WHERE part = 'train')", 1)
_LAST = "lc AS (SELECT ticker, event_id, arg_max(cell, wn) AS cell FROM be GROUP BY 1, 2), sl AS (SELECT l.* FROM l JOIN lc ON lc.ticker = l.ticker AND lc.event_id = l.event_id AND lc.cell = l.cell WHERE l.win = 1001)"


@query(
    "b27_selection_span",
    f"""WITH {_SPAN}, {_LAST}, ii AS (SELECT ticker, event_id, any_value(cell) AS cell, count(*) AS n, {_PF} AS pf, avg(net) AS ex FROM sl GROUP BY 1, 2), oo AS (SELECT ticker, event_id, count(*) AS n, {_PF} AS pf FROM te GROUP BY 1, 2),
ww AS (SELECT ticker, event_id, win, sum(net) AS g FROM te GROUP BY 1, 2, 3), cs AS (SELECT ticker, event_id, sum((g > 0)::INT) / (SELECT count(*) FROM wf WHERE part = 'test') AS consistency FROM ww GROUP BY 1, 2)
SELECT lc.ticker, lc.event_id, lc.cell::BIGINT AS cell, coalesce(ii.n, 0)::BIGINT AS total_trades, round(coalesce(ii.pf, 0), 5) AS profit_factor, round(ii.ex, 6) + 0.0::DOUBLE AS expectancy, coalesce(oo.n, 0)::BIGINT AS oos_trades, round(coalesce(oo.pf, 0), 5) AS oos_pf, round(coalesce(consistency, 0), 6) AS consistency
FROM lc LEFT JOIN ii USING (ticker, event_id) LEFT JOIN oo USING (ticker, event_id) LEFT JOIN cs USING (ticker, event_id)""",
)
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    v = bt.discover(bars, a, GRID, min_train=24)[0]
    return rounded(v.select(*KEYS, "cell", "total_trades", F.round("profit_factor", 5).alias("profit_factor"), "expectancy", "oos_trades", F.round("oos_pf", 5).alias("oos_pf"), "consistency"))


_EFF = "po AS (SELECT ticker, event_id, count(*) AS n, sum(e - f + 1) AS pos, avg(net) AS m, stddev_samp(net) AS sd, avg(e - f) AS hold FROM l GROUP BY 1, 2), oc AS (SELECT ticker, event_id, count(DISTINCT b) AS occ FROM (SELECT ticker, event_id, unnest(range(f, e + 1)) AS b FROM l) GROUP BY 1, 2), ef AS (SELECT po.*, greatest(n / (pos / occ), 2) AS eff FROM po JOIN oc USING (ticker, event_id))"


@query(
    "b18_b20_effective_validation",
    f"""WITH {EVENTS_SQL}, {ledger_sql([LONG])}, {_EFF}, st AS (SELECT median(epoch_us(open_dt) - epoch_us(p)) AS us FROM (SELECT open_dt, lag(open_dt) OVER (PARTITION BY ticker ORDER BY rn) AS p FROM bars)),
sh AS (SELECT *, CASE WHEN sd > 1e-12 THEN m / sd * sqrt(greatest(365.25 * 86400e6 / us / greatest(hold, 1), 1)) END AS s, CASE WHEN floor(eff) > 1 THEN 1 - 0.5772156649 * ln(8) / ln(floor(eff)) END AS le FROM ef, st)
SELECT ticker, event_id, n::BIGINT AS trades, round(eff, 5) AS n_effective, round(CASE WHEN sd > 1e-12 THEN m / (sd / sqrt(eff)) END, 5) + 0.0::DOUBLE AS t, round(s, 4) + 0.0::DOUBLE AS sharpe, round(CASE WHEN floor(eff) <= exp(1) THEN s WHEN le > 0 THEN s * sqrt(le) END, 4) + 0.0::DOUBLE AS dsr FROM sh""",
)
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, _ = backtest(spark, sf_dir, [LONG])
    v = bt.validation(ledger, 8, bt.bars_per_year(bars), *KEYS)
    return rounded(v.select(*KEYS, "trades", F.round("n_effective", 5).alias("n_effective"), F.round("t", 5).alias("t"), F.round("sharpe", 4).alias("sharpe"), F.round("dsr", 4).alias("dsr")))


def _point(cell: int) -> str:
    return f"p{cell} AS (SELECT sg.ticker, sg.event_id, count(*) AS ts FROM sg WHERE cell = {cell} GROUP BY 1, 2), g{cell} AS (SELECT ticker, event_id, count(*) AS n, avg(net) AS m, stddev_samp(net) AS sd, sum(net) AS g FROM l WHERE cell = {cell} GROUP BY 1, 2), o{cell} AS (SELECT p{cell}.ticker, p{cell}.event_id, coalesce(n, 0) / ts AS fill, g, CASE WHEN n >= 2 AND sd > 1e-9 * greatest(abs(m), 1) THEN m / sd * sqrt(n / 5.0::DOUBLE) END AS sh FROM p{cell} LEFT JOIN g{cell} USING (ticker, event_id))"


@query(
    "b26_limit_adoption",
    f"""WITH {EVENTS_SQL}, {ledger_sql([MARKET, LONG])}, {_point(0)}, {_point(1)}, j AS (SELECT ticker, event_id, CASE WHEN NOT coalesce(o1.fill >= 0.4, false) THEN 'fill' WHEN NOT coalesce(o1.sh >= o0.sh, false) THEN 'sharpe' WHEN NOT coalesce(o1.g >= CASE WHEN o0.g > 0 THEN o0.g * 0.5 ELSE o0.g END, false) THEN 'net_gain' END AS failed FROM o0 LEFT JOIN o1 USING (ticker, event_id))
SELECT ticker, event_id, failed IS NULL AS adopted, failed FROM j""",
)
def b26(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, counts = backtest(spark, sf_dir, [MARKET, LONG])
    point = lambda i: bt.opportunity(ledger.where(F.col("cell") == i), counts.where(F.col("cell") == i), 5.0, *KEYS)
    return bt.adopt_limit(point(0), point(1), *KEYS, least_fill=0.4)


@query(
    "b29_seeded_grid",
    f"""WITH {_TARGETS}, c AS (SELECT ticker, event_id, h, CASE WHEN adv > 0 THEN 'long' ELSE 'short' END AS direction, round(greatest(0.005, coalesce(tp, 0.005)), 4) AS tp FROM tg LEFT JOIN tp USING (ticker, event_id) WHERE route IS NOT NULL),
x AS (SELECT * FROM (VALUES (0, 0.75::DOUBLE, 0.5::DOUBLE), (1, 0.75, 1.0), (2, 0.75, 1.5), (3, 1.0, 0.5), (4, 1.0, 1.0), (5, 1.0, 1.5), (6, 1.25, 0.5), (7, 1.25, 1.0), (8, 1.25, 1.5)) v(cell, sx, hx))
SELECT ticker, event_id, cell::BIGINT AS cell, direction, round(tp * sx, 6) AS sell, greatest(1, round(h * hx))::INTEGER AS horizon FROM c, x""",
)
def b29(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, s = study(spark, sf_dir)
    promoted = al.promoted(al.derive_target(s, a, bars))
    return bt.seeded(promoted, MARKET).select(*KEYS, "cell", "direction", "sell", "horizon")


@query("b11_grid_frame", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{p.direction}', {p.drop!r}::DOUBLE, {p.sell!r}::DOUBLE, {p.horizon}::BIGINT)" for i, p in enumerate(GRID)) + ") v(cell, direction, \"drop\", sell, horizon)")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.cells(spark, GRID).select(F.col("cell").cast("long").alias("cell"), "direction", "drop", "sell", F.col("horizon").cast("long").alias("horizon"))


@query("b15_pooled_ledgers", f"WITH {EVENTS_SQL}, {ledger_sql([LONG, SHORT, MARKET])} SELECT cell::BIGINT AS cell, count(*)::BIGINT AS n, round(sum(net), 5) + 0.0::DOUBLE AS gain FROM l GROUP BY 1")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    one = lambda i, p: bt.run(bars, a, bt.cells(spark, [p]))[0].withColumn("cell", F.lit(i).cast("long"))
    every = one(0, LONG).unionByName(one(1, SHORT)).unionByName(one(2, MARKET))
    return rounded(every.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.sum("net_pct_gain"), 5).alias("gain")))


# --- registry and views ------------------------------------------------------------------------------

_V = f"{EVENTS_SQL}, {ledger_sql([LONG])}, q AS (SELECT ticker, event_id, {_PF} AS pf, count(*) AS n FROM l GROUP BY 1, 2), v AS (SELECT *, CASE WHEN pf >= 3 THEN 'EDGE' WHEN pf >= 1.5 THEN 'PARTIAL-EDGE' ELSE 'NON-EDGE' END AS verdict FROM q)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each rule by its profit factor alone, so that SQL can follow."""
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    g = ledger.groupBy(*KEYS).agg(bt.profit_factor().alias("profit_factor"), F.count("*").alias("n"))
    pf = F.col("profit_factor")
    return g.withColumn("verdict", F.when(pf >= 3, "EDGE").when(pf >= 1.5, "PARTIAL-EDGE").otherwise("NON-EDGE"))


@query("j9_evidence_grade", f"WITH {_V} SELECT ticker, event_id, CASE verdict WHEN 'EDGE' THEN CASE WHEN n / 100 >= 1.5 THEN 'A' ELSE 'B+' END WHEN 'PARTIAL-EDGE' THEN 'B' ELSE 'C' END AS grade FROM v")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = judged(spark, sf_dir)
    return v.select(*KEYS, rg.evidence_grade(F.col("verdict"), F.col("profit_factor"), F.col("n") / 100).alias("grade"))


@query("j9_regime_type", f"WITH {_V}, m AS (SELECT ticker, event_id, year(fdt) * 12 + month(fdt) AS m, count(*) AS n FROM l GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY ticker, event_id) AS p FROM m), g AS (SELECT ticker, event_id, CASE WHEN count(*) <= 1 THEN 1 ELSE 1 + sum(p * ln(p + 1e-12)) / ln(count(*)) END AS dep FROM p GROUP BY 1, 2) SELECT ticker, event_id, CASE WHEN pf < 1 THEN 'conditional' WHEN dep > 0.3 THEN 'specific' ELSE 'agnostic' END AS regime_type FROM v JOIN g USING (ticker, event_id)")
def j9b(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    v = judged(spark, sf_dir).join(bt.dependency(ledger, *KEYS), list(KEYS))
    avoid = F.when(F.col("profit_factor") < 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return v.select(*KEYS, rg.regime_type(F.col("dependency"), avoid).alias("regime_type"))


@query("p7_diagnostics_vs_verdict", f"WITH {_V}, d AS (SELECT ticker, event_id, verdict, unnest(CASE WHEN n < 100 AND pf < 2 THEN ['few', 'weak'] WHEN n < 100 THEN ['few'] WHEN pf < 2 THEN ['weak'] ELSE [NULL] END) AS diagnostic FROM v) SELECT ticker, event_id, 'B' AS grade, diagnostic, verdict FROM d")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = judged(spark, sf_dir)
    noted = F.array_compact(F.array(F.when(F.col("n") < 100, "few"), F.when(F.col("profit_factor") < 2, "weak")))
    return rg.diagnostics_vs_verdict(v.select(*KEYS, F.lit("B").alias("grade"), noted.alias("diagnostics")), v)


@query("p7_lottery_only_winners", f"WITH {_V}, r AS (SELECT ticker, event_id, n < 100 AS few FROM v WHERE verdict = 'PARTIAL-EDGE') SELECT ticker, event_id, (1 + few::INT)::INTEGER AS n_reasons, NOT few AS lottery_only FROM r")
def p7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.lit(bt.ROTATION_REASON), F.when(F.col("n") < 100, "few")))
    return rg.lottery_only(judged(spark, sf_dir).withColumn("reasons", reasons), bt.ROTATION_REASON)


@query("j11_registry", f"WITH {_V}, kr AS (SELECT ticker || '/' || event_id AS rule_id, * FROM v WHERE verdict <> 'NON-EDGE'), ru AS (SELECT DISTINCT ticker || '/' || event_id AS rule_id, l.fdt AS dt FROM l WHERE ticker || '/' || event_id IN (SELECT rule_id FROM kr)), nn AS (SELECT rule_id, count(*) AS n FROM ru GROUP BY 1), mm AS (SELECT x.rule_id AS a, y.rule_id AS b, count(*) AS s FROM ru x JOIN ru y ON x.dt = y.dt AND x.rule_id <> y.rule_id GROUP BY 1, 2), bo AS (SELECT a, b FROM mm JOIN nn p ON p.rule_id = a JOIN nn q ON q.rule_id = b WHERE s / (p.n + q.n - s) > 0.1), dm AS (SELECT DISTINCT a FROM bo JOIN kr x ON x.rule_id = a JOIN kr y ON y.rule_id = b WHERE y.pf > x.pf), hm AS (SELECT event_id, pf AS h FROM q WHERE ticker = '1-URGENT'), cr AS (SELECT q.event_id, sum((pf >= greatest(1.5, 0.8 * h))::INT) AS p FROM q JOIN hm USING (event_id) WHERE ticker <> '1-URGENT' GROUP BY 1) SELECT kr.ticker, kr.event_id, CASE verdict WHEN 'EDGE' THEN 'B+' ELSE 'B' END AS grade, dm.a IS NOT NULL AS duplicate, dm.a IS NULL AND coalesce(p > 0, true) AS promoted FROM kr LEFT JOIN dm ON dm.a = kr.rule_id LEFT JOIN cr USING (event_id)")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    v = judged(spark, sf_dir).withColumn("dsr", F.lit(0.0)).withColumn("dependency", F.lit(0.0))
    found = rg.build_registry(v, ledger, rg.cross_ticker(v, v.where("ticker = '1-URGENT'")), duplicate_from=0.1)["rules"]
    return found.select(*KEYS, "grade", F.col("duplicate_of").isNotNull().alias("duplicate"), "promoted")


@query("d3_monitoring_manifest", f"WITH {_V} SELECT ticker, event_id, verdict, CASE WHEN verdict = 'EDGE' THEN ticker || '_' || event_id || '.json' END AS path FROM v")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = judged(spark, sf_dir)
    written = v.where("verdict = 'EDGE'").select(*KEYS, F.concat(F.concat_ws("_", *KEYS), F.lit(".json")).alias("path"))
    return rg.monitoring_manifest(v, written).select(*KEYS, "verdict", "path")


# --- events and gates --------------------------------------------------------------------------------


@query("g2_episode_starts_of_all", f"WITH {EVENTS_SQL}, q AS (SELECT *, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM a) SELECT ticker, event_id, rn::BIGINT AS rn FROM q WHERE q IS NULL OR rn - q - 1 > 2")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.with_episodes(fixed_activations(spark, sf_dir)[1], 2).where("starts").select("ticker", "event_id", F.col("rn").cast("long").alias("rn"))


_FAIL = "CASE WHEN episode_tpm < 0.5 THEN 'rate' WHEN n_episodes < 10 THEN 'episodes' WHEN episode_dispersion > lim THEN 'episode dispersion' END"


@query("g11_fail_reasons", f"WITH {EVENTS_SQL}, {_MET} SELECT ticker, event_id, {_FAIL} AS fail_reason FROM h")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.gate(a, bars).select("ticker", "event_id", "fail_reason")


@query("g14_gated_activations", f"WITH {EVENTS_SQL}, {_MET}, ok AS (SELECT ticker, event_id FROM h WHERE {_FAIL} IS NULL) SELECT ticker, event_id, count(*)::BIGINT AS n FROM a SEMI JOIN ok USING (ticker, event_id) GROUP BY 1, 2")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    kept = gt.gate(a, bars).where("passed").select("ticker", "event_id")
    return a.join(kept, ["ticker", "event_id"], "left_semi").groupBy("ticker", "event_id").agg(F.count("*").alias("n"))


@query("p5_observed_survival", f"WITH {EVENTS_SQL}, {_MET} SELECT ticker, count(*)::BIGINT AS n, sum(({_FAIL} IS NULL)::INT)::BIGINT AS n_passed FROM h GROUP BY 1")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.survival(gt.gate(a, bars)).select("ticker", "n", "n_passed")


@query("a6_a7_monthly_episodes", f"WITH {EVENTS_SQL}, q AS (SELECT *, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM a), mo AS (SELECT DISTINCT ticker, year(open_dt) * 12 + month(open_dt) AS month FROM bars), c AS (SELECT ticker, event_id, year(open_dt) * 12 + month(open_dt) AS month, count(*) AS b, sum((q IS NULL OR rn - q - 1 > 1)::INT) AS e FROM q GROUP BY 1, 2, 3) SELECT x.ticker, x.event_id, mo.month::INTEGER AS month, coalesce(b, 0)::BIGINT AS bars, coalesce(e, 0)::BIGINT AS episodes FROM (SELECT DISTINCT ticker, event_id FROM a) x JOIN mo USING (ticker) LEFT JOIN c USING (ticker, event_id, month)")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.monthly_counts(a, bars)


@query("a8_composed_expression", "SELECT 'EVT-SPREAD_CLOSE_SMA20-AND-0009' AS event_id, 'spread_close_sma20 < -0.1 AND pos_close_range20 < 0.2' AS expression, 2 AS components")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = co.composed(fixed_events(), "E-SPREAD", "E-RANGE", 9)
    return spark.createDataFrame([(e.event_id, e.text(), len(e.components))], "event_id string, expression string, components int")


_TEXTS = {
    "E-SPREAD": "spread_close_sma20 < -0.1", "E-CROSS": "spread_close_sma20 crosses < -0.05", "E-ZHIGH": "zscore(spread_close_sma20, 48) > 1", "E-RANGE": "pos_close_range20 < 0.2",
    "E-VOLUME": "ratio_volume_sma20 > 1.2", "E-DELTA": "delta(spread_close_sma20, 1) > 0.2", "E-AND": "pos_close_range20 < 0.3 AND ratio_volume_sma20 > 1",
}


@query("e7_expressions", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _TEXTS.items()) + ") v(event_id, expression)")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e.event_id, e.text()) for e in fixed_events()], "event_id string, expression string")


@query("e12_dominant_windows", "SELECT * FROM (VALUES ('E-SPREAD', 20), ('E-CROSS', 20), ('E-ZHIGH', 48), ('E-RANGE', 20), ('E-VOLUME', 20), ('E-DELTA', 20), ('E-AND', 20)) v(event_id, size)")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e.event_id, e.dominant_window()) for e in fixed_events()], "event_id string, size int")


@query("x5_pointwise", "SELECT * FROM (VALUES ('E-SPREAD', true), ('E-CROSS', false), ('E-ZHIGH', false), ('E-RANGE', true), ('E-VOLUME', true), ('E-DELTA', false), ('E-AND', true)) v(event_id, pointwise)")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e.event_id, ev.is_pointwise(e)) for e in fixed_events()], "event_id string, pointwise boolean")


@query("x2_partition_thresholds", f"WITH {EVENTS_SQL}, p AS (SELECT body FROM k JOIN a ON a.ticker = k.ticker AND a.rn = k.rn WHERE event_id = 'E-SPREAD' AND body IS NOT NULL), q AS (SELECT quantile_cont(body, [0.03, 0.05, 0.08, 0.1, 0.15, 0.85, 0.9, 0.92, 0.95, 0.97]) AS q, count(*) AS n FROM p) SELECT n::BIGINT AS n, i::INTEGER AS i, round(q[i + 1], 6) + 0.0::DOUBLE AS threshold FROM q, range(10) t(i)")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    on = bars.join(a.where("event_id = 'E-SPREAD'").select("ticker", "rn"), ["ticker", "rn"], "left_semi")
    n, low, high = ev.thresholds(on, {"x": F.col("body")})["x"]
    return rounded(spark.createDataFrame([(n, i, q) for i, q in enumerate(low + high)], "n long, i int, threshold double"))


@query("x3_holdout_concat", f"WITH {BARS}, s AS (SELECT ticker, open_dt, close, 0 AS o FROM bars WHERE rn < 1200 UNION ALL SELECT ticker, open_dt, close + 1, 1 FROM bars WHERE rn >= 1100), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, open_dt ORDER BY o) AS r FROM s) SELECT ticker, open_dt, round(close, 6) AS close FROM r WHERE r = 1")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.plans.session import holdout

    b = order_bars(spark, sf_dir)
    return rounded(holdout(b.where("rn < 1200"), b.where("rn >= 1100").withColumn("close", F.col("close") + 1)).select("ticker", "open_dt", "close"))


# --- event study -------------------------------------------------------------------------------------


@query("n7_hand_off", f"WITH {EVENTS_SQL}, {_HIT}, {_LIFT}, r AS (SELECT ticker, event_id, row_number() OVER (PARTITION BY ticker ORDER BY pe / pb DESC, event_id) AS place FROM lf JOIN ba USING (ticker) WHERE pb > 0 AND pb < 1) SELECT a.ticker, a.event_id, count(*)::BIGINT AS n FROM a JOIN r USING (ticker, event_id) WHERE place <= 2 GROUP BY 1, 2")
def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    bars, a = fixed_activations(spark, sf_dir)
    ranked = al.lift_score(a, target(bars)).withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("lift"), "event_id")))
    return al.hand_off(ranked, a, 2).groupBy("ticker", "event_id").agg(F.count("*").alias("n"))


@query("n3_tippett", "WITH d AS (SELECT * FROM (VALUES (5.0::DOUBLE, 1.0::DOUBLE), (4.0, 2.0), (3.0, 3.0), (2.0, 4.0), (1.0, 4.5)) v(a, b)), p AS (SELECT least((1 + (SELECT count(*) FROM d y WHERE y.a >= x.a)) / 6, (1 + (SELECT count(*) FROM d y WHERE y.b >= x.b)) / 6) AS m FROM d x) SELECT round((1 + sum((m <= 0.34)::INT)) / 6, 6) AS p FROM p")
def n3(spark: SparkSession, sf_dir: str) -> DataFrame:
    null = {"a": [5.0, 4.0, 3.0, 2.0, 1.0], "b": [1.0, 2.0, 3.0, 4.0, 4.5]}
    return rounded(spark.createDataFrame([(al.tippett({"a": 0.34, "b": 0.5}, null),)], "p double"))


@query("m31_stable_regimes", f"WITH {BARS}, {RUNS} SELECT ticker, rn::BIGINT AS rn, CASE WHEN run_len >= 3 AND regime IS NOT NULL THEN regime END AS regime FROM k")
def m31(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = with_regime(spark, sf_dir)
    return b.select("ticker", F.col("rn").cast("long").alias("rn"), F.when(F.col("regime_stable"), F.col("regime")).alias("regime"))


@query("m32_rolling_ic_windows", "SELECT * FROM (VALUES (24.0::DOUBLE, 60), (1.0, 1440), (4.0, 360), (168.0, 9), (2000.0, 2)) v(bar_hours, bars)")
def m32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(h, al.rolling_ic_window(h)) for h in (24.0, 1.0, 4.0, 168.0, 2000.0)], "bar_hours double, bars int")


# --- features, time axis, settings -------------------------------------------------------------------


@query("f14_safe_arithmetic", f"WITH {BASE5} SELECT ticker, rn::BIGINT AS rn, round(close / nullif(close_sma_20, 0), 6) AS ratio, round((close - close_sma_20) / nullif(close_sma_20, 0), 6) + 0.0::DOUBLE AS spread, round((close - close_min_20) / nullif(close_max_20 - close_min_20, 0), 6) AS position FROM k")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [ft.Feature("ratio", "ratio", ("close", "close_sma_20")), ft.Feature("spread", "spread", ("close", "close_sma_20")), ft.Feature("position", "position", ("close", "close_min_20", "close_max_20"))]
    out = ft.add_features(kpi(order_bars(spark, sf_dir)), made)
    return rounded(out.select("ticker", F.col("rn").cast("long").alias("rn"), "ratio", "spread", "position"))


@query("f15_normalised_difference", f"WITH {BASE5}, s AS (SELECT stddev_samp(close_sma_05 - close_sma_20) AS s FROM k) SELECT ticker, rn::BIGINT AS rn, round((close_sma_05 - close_sma_20) / s, 5) + 0.0::DOUBLE AS x FROM k, s")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kpi(order_bars(spark, sf_dir))
    frozen = ft.freeze(b, [ft.Feature("x", "diffnorm", ("close_sma_05", "close_sma_20"))])
    return rounded(ft.add_features(b, frozen).select("ticker", F.col("rn").cast("long").alias("rn"), F.round("x", 5).alias("x")))


@query("t5_catalogue", "SELECT * FROM (VALUES ('plain', 11), ('scaled', 10), ('lagged', 1)) v(feature, transforms)")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [ft.Feature("plain", "identity", ("close",)), ft.Feature("scaled", "identity", ("close",), scale_free=False), ft.Feature("lagged", "ratio", ("close", "open"), lag=1, identity_only=True)]
    return spark.createDataFrame([(f.name, len(ft.catalogue(f))) for f in made], "feature string, transforms int")


@query("r8_chronological_order", "SELECT o_orderpriority AS ticker, o_orderdate AS open_dt, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS rn FROM (SELECT DISTINCT o_orderpriority, o_orderdate FROM orders)")
def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").alias("open_dt")).distinct()
    return with_rn(days).withColumn("rn", F.col("rn").cast("long"))


_FRAMES = ("15m", "1h", "4h", "1d", "1w")


@query("r16_timeframes", "SELECT * FROM (VALUES ('15m', 0.25::DOUBLE, 672), ('1h', 1.0, 168), ('4h', 4.0, 42), ('1d', 24.0, 7), ('1w', 168.0, 1)) v(timeframe, hours, bars_of_a_week)")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, reg.timeframe_hours(t), reg.hours_to_bars(168.0, t)) for t in _FRAMES], "timeframe string, hours double, bars_of_a_week int")


@query("z4b_timeframe_classes", "SELECT * FROM (VALUES ('15m', 15, 'fast', 2880.0::DOUBLE), ('1h', 60, 'intraday', 720.0), ('4h', 240, 'intraday', 180.0), ('1d', 1440, 'daily', 30.0), ('1w', 10080, 'daily', 4.285714)) v(timeframe, minutes, class, bars_per_month)")
def z4b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, settings.timeframe_minutes(t), settings.timeframe_class(t), settings.bars_per_month(t)) for t in _FRAMES]
    return rounded(spark.createDataFrame(rows, "timeframe string, minutes int, class string, bars_per_month double"))


@query("z5_presets", "SELECT * FROM (VALUES ('sniper', '1d', 0.3::DOUBLE, 1.05::DOUBLE, 10, 1.0::DOUBLE), ('balanced', '1d', 1.0, 1.3, 10, 2.0), ('sweep', '1d', 0.3, 1.6, 5, 2.5), ('burst', '1d', 1.5, 3.0, 10, 5.0), ('sniper', '1h', 7.2, 1.05, 10, 0.45), ('balanced', '1h', 24.0, 1.3, 10, 0.9), ('sweep', '1h', 7.2, 1.6, 5, 1.12), ('burst', '1h', 36.0, 3.0, 10, 2.25)) v(preset, timeframe, min_tpm, margin, min_episodes, max_dispersion)")
def z5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, t, g.min_tpm, g.margin, g.min_episodes, g.max_dispersion) for t in ("1d", "1h") for n in settings.PRESETS for g in [settings.preset(n, t).gate]]
    return rounded(spark.createDataFrame(rows, "preset string, timeframe string, min_tpm double, margin double, min_episodes int, max_dispersion double"))


@query("z2_resolved_settings", "SELECT * FROM (VALUES ('1d', 10, 1, 2), ('4h', 24, 2, 3), ('1h', 24, 6, 12), ('15m', 50, 24, 48)) v(timeframe, target_h, delay, stable_window)")
def z2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = [settings.resolve(settings.SessionConfig(timeframe=t, n_bars=10**6), strict=False).config for t in ("1d", "4h", "1h", "15m")]
    return spark.createDataFrame([(c.timeframe, c.target_h, c.delay, c.stable_window) for c in done], "timeframe string, target_h int, delay int, stable_window int")


@query("r15_window_suggestion")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reg.suggest_ema_windows(order_bars(spark, sf_dir), "1d", window_hours=99 * 24.0, stride_hours=20 * 24.0))
