"""Queries of composition (A), the event study (M) and null calibration (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import stats as st
from ruleloom.functions.windows import ratio
from ruleloom.operators import alpha as al
from ruleloom.operators import compose as co
from ruleloom.operators import gate as gt
from ruleloom.plans.q_events import BASE5, EVENTS_SQL, fixed_activations, fixed_events, kpi
from ruleloom.plans.registry import over, query, rounded, s_full
from ruleloom.sources.bars import ORDER_BARS_SQL, order_bars

H = (1, 3, 5, 10)
FWD = "f AS (" + " UNION ALL ".join(f"SELECT ticker, rn, open_dt, {h} AS h, lead(close, {h}) {over()} / close - 1 AS fwd, ln(lead(close, {h}) {over()} / close) AS logfwd FROM bars" for h in H) + ")"
HIT = f"t AS (SELECT ticker, rn, CASE WHEN count(close) {over(0, lead=5)} >= 5 THEN max(close) {over(0, lead=5)} / close - 1 >= 0.3 END AS hit, lead(close, 5) {over()} / close - 1 AS fwd FROM bars)"


def target(bars: DataFrame, h: int = 5, pct: float = 0.3) -> DataFrame:
    from ruleloom.functions.windows import lead

    return bars.select("ticker", "rn", al.binary_target(h, pct).alias("hit"), (lead(F.col("close"), h) / F.col("close") - 1).alias("fwd"))


# --- composition -------------------------------------------------------------------------------------

_SLOTS = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{e.event_id}', '{'|'.join(e.components[0].slot)}')" for i, e in enumerate(fixed_events()[:-1])) + ") v(idx, event_id, slot))"
_N = "n AS (SELECT event_id, count(*) AS n FROM a GROUP BY 1)"


def pooled(spark: SparkSession, sf_dir: str, top: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars, a = fixed_activations(spark, sf_dir)
    singles = fixed_events()[:-1]
    return bars, a, co.pool(co.event_table(spark, singles), a, top)


@query("a1_pool_top_k", f"WITH {EVENTS_SQL}, {_SLOTS}, {_N}, r AS (SELECT e.event_id, e.slot, n, row_number() OVER (PARTITION BY slot ORDER BY n DESC, idx) AS r FROM e JOIN n USING (event_id)) SELECT event_id, slot, n::BIGINT AS n_active FROM r WHERE r <= 1")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir)[2].select("event_id", "slot", "n_active")


@query("a2_valid_pairs", f"WITH {EVENTS_SQL}, {_SLOTS}, {_N}, r AS (SELECT e.*, row_number() OVER (PARTITION BY slot ORDER BY n DESC, idx) AS r FROM e JOIN n USING (event_id)) SELECT x.idx::BIGINT AS ia, y.idx::BIGINT AS ib, x.event_id AS a, y.event_id AS b FROM r x JOIN r y ON x.idx < y.idx AND x.slot <> y.slot AND x.r <= 3 AND y.r <= 3")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.candidate_pairs(pooled(spark, sf_dir, 3)[2])


_PAIRS = f"""{_SLOTS}, {_N}, r AS (SELECT e.*, row_number() OVER (PARTITION BY slot ORDER BY n DESC, idx) AS r FROM e JOIN n USING (event_id)),
pr AS (SELECT x.event_id AS a, y.event_id AS b FROM r x JOIN r y ON x.idx < y.idx AND x.slot <> y.slot AND x.r <= 1 AND y.r <= 1)"""
_MET = "m AS (SELECT x.ticker, pr.a || '&' || pr.b AS event_id, pr.a, pr.b, x.rn, x.open_dt FROM pr JOIN a x ON x.event_id = pr.a JOIN a y ON y.event_id = pr.b AND y.ticker = x.ticker AND y.rn = x.rn)"


@query("a5_and_pairs", f"WITH {EVENTS_SQL}, {_PAIRS}, {_MET} SELECT ticker, event_id, rn::BIGINT AS rn FROM m")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, p = pooled(spark, sf_dir)
    return co.pair_activations(a, co.candidate_pairs(p)).select("ticker", "event_id", F.col("rn").cast("long").alias("rn"))


@query(
    "a5_composed_and_gated",
    f"""WITH {EVENTS_SQL}, {_PAIRS}, {_MET}, mo AS (SELECT DISTINCT ticker, year(open_dt) * 12 + month(open_dt) AS month FROM bars), nm AS (SELECT ticker, count(*) AS months FROM mo GROUP BY 1),
s AS (SELECT ticker, event_id, n AS m FROM (SELECT ticker, event_id, count(*) AS n FROM a GROUP BY 1, 2)),
v AS (SELECT m.ticker, m.event_id, m.a, m.b, count(*) AS n FROM m GROUP BY 1, 2, 3, 4), w AS (SELECT v.*, x.m AS na, y.m AS nb FROM v JOIN nm USING (ticker) JOIN s x ON x.ticker = v.ticker AND x.event_id = v.a JOIN s y ON y.ticker = v.ticker AND y.event_id = v.b WHERE v.n >= greatest(1, floor(0.5 * months))),
q AS (SELECT m.*, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM m SEMI JOIN w USING (ticker, event_id)),
c AS (SELECT ticker, event_id, year(open_dt) * 12 + month(open_dt) AS month, sum((q IS NULL OR rn - q - 1 > 1)::INT) AS ep FROM q GROUP BY 1, 2, 3),
g AS (SELECT w.ticker, w.event_id, sum(coalesce(ep, 0)) AS ne, avg(coalesce(ep, 0)) AS et, var_samp(coalesce(ep, 0)) / nullif(avg(coalesce(ep, 0)), 0) AS ed, count(*) AS k FROM w JOIN mo USING (ticker) LEFT JOIN c USING (ticker, event_id, month) GROUP BY 1, 2)
SELECT w.ticker, w.event_id, w.n::BIGINT AS n, round(w.n / (na + nb - w.n), 6) AS jaccard, ne::BIGINT AS n_episodes, round(et, 6) AS episode_tpm,
NOT (et < 0.5 OR ne < 10 OR coalesce(ed > pow(1 - 2 / (9.0::DOUBLE * (k - 1)) + {gt.Z95!r} * sqrt(2 / (9.0::DOUBLE * (k - 1))), 3) * 1.3, false)) AS passed FROM w JOIN g USING (ticker, event_id)""",
)
def a5b(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, p = pooled(spark, sf_dir)
    out = co.compose_pairs(a, bars, co.candidate_pairs(p))
    return rounded(out.select("ticker", "event_id", "n", "jaccard", "n_episodes", "episode_tpm", "passed"))


@query("a3_a4_stratified_order")
def a34(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = co.candidate_pairs(pooled(spark, sf_dir, 3)[2]).withColumn("stratum", F.col("ia") % 2)
    return p.withColumn("place", co.stratified_rank("stratum", co.pair_order(p))).select("stratum", "place", "a", "b")


_MO = "mo AS (SELECT DISTINCT ticker, year(open_dt) * 12 + month(open_dt) AS month FROM bars), nm AS (SELECT ticker, count(*) AS months FROM mo GROUP BY 1)"


@query(
    "a5_triples",
    f"""WITH {EVENTS_SQL}, {_PAIRS}, {_MO}, tr AS (SELECT DISTINCT list_sort([pr.a, pr.b, z.event_id]) AS ms FROM pr JOIN e x ON x.event_id = pr.a JOIN e y ON y.event_id = pr.b JOIN e z ON z.slot <> x.slot AND z.slot <> y.slot),
m AS (SELECT x.ticker, array_to_string(ms, '&') AS event_id, x.rn, x.open_dt FROM tr JOIN a x ON x.event_id = ms[1] JOIN a y ON y.event_id = ms[2] AND y.ticker = x.ticker AND y.rn = x.rn JOIN a z ON z.event_id = ms[3] AND z.ticker = x.ticker AND z.rn = x.rn),
w AS (SELECT ticker, event_id, count(*) AS n FROM m JOIN nm USING (ticker) GROUP BY 1, 2 HAVING count(*) >= greatest(1, floor(0.5 * any_value(months)))),
q AS (SELECT m.*, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM m SEMI JOIN w USING (ticker, event_id)),
c AS (SELECT ticker, event_id, year(open_dt) * 12 + month(open_dt) AS month, sum((q IS NULL OR rn - q - 1 > 1)::INT) AS ep FROM q GROUP BY 1, 2, 3),
g AS (SELECT w.ticker, w.event_id, any_value(w.n) AS n, sum(coalesce(ep, 0)) AS ne, avg(coalesce(ep, 0)) AS et, var_samp(coalesce(ep, 0)) / nullif(avg(coalesce(ep, 0)), 0) AS ed, count(*) AS k FROM w JOIN mo USING (ticker) LEFT JOIN c USING (ticker, event_id, month) GROUP BY 1, 2)
SELECT ticker, event_id, n::BIGINT AS n_activations, ne::BIGINT AS n_episodes, round(et, 6) AS episode_tpm,
NOT (et < 0.5 OR ne < 10 OR coalesce(ed > pow(1 - 2 / (9.0::DOUBLE * (k - 1)) + {gt.Z95!r} * sqrt(2 / (9.0::DOUBLE * (k - 1))), 3) * 1.3, false)) AS passed FROM g""",
)
def a5c(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, p = pooled(spark, sf_dir)
    return rounded(co.triples(fixed_events()[:-1], a, bars, co.candidate_pairs(p)).select("ticker", "event_id", "n_activations", "n_episodes", "episode_tpm", "passed"))


@query("a10_grade_guided_pairs")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = fixed_activations(spark, sf_dir)
    singles = fixed_events()[:-1]
    grades = {e.event_id: "ABCD"[i % 4] for i, e in enumerate(singles)}
    return co.grade_pairs(co.pool(co.event_table(spark, singles, grades), a, 3))


# --- event study -------------------------------------------------------------------------------------


@query("m1_forward_returns", f"WITH {ORDER_BARS_SQL}, {FWD} SELECT ticker, rn::BIGINT AS rn, h::INTEGER AS h, round(fwd, 6) + 0.0::DOUBLE AS fwd, round(logfwd, 6) + 0.0::DOUBLE AS logfwd FROM f")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.forward(order_bars(spark, sf_dir), H).drop("open_dt").withColumn("rn", F.col("rn").cast("long")))


@query("m2_purge_mask", f"WITH {ORDER_BARS_SQL}, {FWD} SELECT ticker, h::INTEGER AS h, count(fwd)::BIGINT AS n FROM f WHERE NOT (rn >= 1000 - least(h, 4) AND rn < 1000) GROUP BY 1, 2")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.forward(order_bars(spark, sf_dir), H, split=1000, purge=4).groupBy("ticker", "h").agg(F.count("fwd").alias("n"))


@query("m3_binary_target", f"WITH {ORDER_BARS_SQL}, {HIT}, s AS (SELECT ticker, rn, CASE WHEN count(close) {over(0, lead=5)} >= 5 THEN min(close) {over(0, lead=5)} / close - 1 <= -0.3 END AS short FROM bars) SELECT t.ticker, t.rn::BIGINT AS rn, hit AS long_hit, short AS short_hit FROM t JOIN s USING (ticker, rn)")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = order_bars(spark, sf_dir)
    return b.select("ticker", "rn", al.binary_target(5, 0.3).alias("long_hit"), al.binary_target(5, 0.3, short=True).alias("short_hit")).withColumn("rn", F.col("rn").cast("long"))


@query(
    "m4_projected_target",
    f"WITH {ORDER_BARS_SQL}, x AS (SELECT *, ln(close) AS p FROM bars), y AS (SELECT *, {s_full('p', 6, 'avg')} AS m FROM x), z AS (SELECT *, (m - lag(m, 6) {over()}) / 6 AS s FROM y) SELECT ticker, rn::BIGINT AS rn, CASE WHEN lead(p, 3) {over()} IS NOT NULL AND s IS NOT NULL THEN greatest("
    + ", ".join(f"lead(p, {i}) {over()} - p - {i} * s" for i in (1, 2, 3))
    + ") >= ln(1.3) END AS hit FROM z",
)
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_bars(spark, sf_dir).select("ticker", "rn", al.projected_target(3, 0.3).alias("hit")).withColumn("rn", F.col("rn").cast("long"))


_EXC = f"{EVENTS_SQL}, {FWD}, ba AS (SELECT ticker, h, avg(logfwd) AS base FROM f WHERE logfwd IS NOT NULL GROUP BY 1, 2), ex AS (SELECT a.ticker, a.event_id, f.h, count(*) AS n, avg(logfwd) AS mu FROM a JOIN f USING (ticker, rn) WHERE logfwd IS NOT NULL GROUP BY 1, 2, 3), d AS (SELECT ex.*, base, mu - base AS delta FROM ex JOIN ba USING (ticker, h))"


@query("m6_conditional_excess", f"WITH {_EXC} SELECT ticker, event_id, h::INTEGER AS h, n::BIGINT AS n, round(mu, 6) + 0.0::DOUBLE AS mu, round(base, 6) + 0.0::DOUBLE AS base, round(delta, 6) + 0.0::DOUBLE AS delta FROM d")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.excess(a, al.forward(bars, H)))


#: All circular shifts as a join of a ticker's active bars with all its bars: the distance of the two is the shift.
_ROT = f"""{EVENTS_SQL}, {FWD}, g AS (SELECT ticker, rn, h, logfwd FROM f WHERE h IN (1, 5)), nb AS (SELECT ticker, count(*) AS bars FROM bars GROUP BY 1),
ba AS (SELECT ticker, h, avg(logfwd) AS base FROM g WHERE logfwd IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT a.ticker, a.event_id, g.h, (g.rn - a.rn + nb.bars) % nb.bars AS o, sum(logfwd) / nullif(count(logfwd), 0) AS mu, count(logfwd) AS n FROM a JOIN nb USING (ticker) JOIN g ON g.ticker = a.ticker GROUP BY 1, 2, 3, 4),
de AS (SELECT sh.*, mu - base AS d FROM sh JOIN ba USING (ticker, h)), re AS (SELECT ticker, event_id, h, n, d AS delta FROM de WHERE o = 0),
nu AS (SELECT de.ticker, de.event_id, de.h, stddev_pop(d) AS sd, count(d) AS k, sum((abs(d) >= abs(delta) - 1e-15)::INT) AS ge FROM de JOIN re USING (ticker, event_id, h) WHERE o > 0 AND d IS NOT NULL GROUP BY 1, 2, 3),
ms AS (SELECT ticker, event_id, h, re.n, delta, delta / nullif(sd, 0) AS z, (1 + ge) / (1 + k) AS p FROM re JOIN nu USING (ticker, event_id, h))"""
_BH = """r AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY p) AS i, count(*) OVER (PARTITION BY ticker, event_id) AS m FROM ms WHERE z IS NOT NULL),
l AS (SELECT *, coalesce(i <= max(CASE WHEN p <= i / m * 0.1 THEN i END) OVER (PARTITION BY ticker, event_id), false) AS significant FROM r)"""


def rotation_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All activations and returns, over every bar of each ticker."""
    bars, a = fixed_activations(spark, sf_dir)
    return a, al.forward(bars, (1, 5))


@query("m7_rotation_null", f"WITH {_ROT} SELECT ticker, event_id, h::INTEGER AS h, n::BIGINT AS n, round(delta, 6) + 0.0::DOUBLE AS delta, round(z, 5) + 0.0::DOUBLE AS z, round(p, 6) AS p FROM ms")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(al.rotation_null(*rotation_inputs(spark, sf_dir)).withColumn("z", F.round("z", 5))))


@query(
    "m8_horizon_choice",
    f"""WITH {_ROT}, {_BH}, c AS (SELECT *, NOT max(significant::INT) OVER (PARTITION BY ticker, event_id)::BOOLEAN AS weak FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY abs(z) DESC, h) AS place FROM c WHERE significant OR weak)
SELECT ticker, event_id, h::INTEGER AS h, n::BIGINT AS n, round(delta, 6) + 0.0::DOUBLE AS delta, round(z, 5) + 0.0::DOUBLE AS z, round(p, 6) AS p, weak FROM o WHERE place = 1""",
)
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.choose_horizon(al.rotation_null(*rotation_inputs(spark, sf_dir))).withColumn("z", F.round("z", 5)))


_PER = "OVER (PARTITION BY ticker, event_id ORDER BY h)"
_ELBOW = f"""el AS (SELECT *, (coalesce(lead(h) {_PER}, h) - coalesce(lag(h) {_PER}, h)) / 2.0::DOUBLE * delta / h AS area, delta - coalesce(lag(delta) {_PER}, 0) AS step, coalesce(lag(h) {_PER}, h) AS before FROM d),
eb AS (SELECT ticker, event_id, min(CASE WHEN step * CASE WHEN s >= 0 THEN 1 ELSE -1 END <= 0 THEN before END) AS stop, max(h) AS last FROM (SELECT *, sum(area) OVER (PARTITION BY ticker, event_id) AS s FROM el) GROUP BY 1, 2)"""


#: Per event: the integral of the excess per bar over all shifts, the rank correlation of rate and horizon, and what follows.
_DERIVE = f"""{_ROT.replace("h IN (1, 5)", "h IN (1, 3, 5, 10)")}, {_BH},
tw AS (SELECT * FROM (VALUES (1, 1.0::DOUBLE), (3, 2.0), (5, 3.5), (10, 2.5)) v(h, w)),
au AS (SELECT ticker, event_id, o, sum(w * d / h) AS auc FROM de JOIN tw USING (h) GROUP BY 1, 2, 3 HAVING count(d) = 4),
ap AS (SELECT n.ticker, n.event_id, any_value(r.auc) AS auc, (1 + sum((abs(n.auc) >= abs(r.auc) - 1e-15)::INT)) / (1 + count(*)) AS p_auc FROM au n JOIN au r ON r.ticker = n.ticker AND r.event_id = n.event_id AND r.o = 0 WHERE n.o > 0 GROUP BY 1, 2),
rt AS (SELECT ticker, event_id, h, CASE WHEN auc >= 0 THEN 1 ELSE -1 END * delta / h AS rate, p_auc FROM re JOIN ap USING (ticker, event_id)),
rk AS (SELECT *, rank() OVER (PARTITION BY ticker, event_id ORDER BY h) AS x, rank() OVER (PARTITION BY ticker, event_id ORDER BY rate) AS y FROM rt),
na AS (SELECT ticker, event_id, any_value(p_auc) AS p, corr(x, y) AS rho FROM rk GROUP BY 1, 2)"""
_H4 = (1, 3, 5, 10)


def study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars, a = fixed_activations(spark, sf_dir)
    return bars, a, al.rotation_study(a, al.forward(bars, _H4))


@query("m9_auc_significance", f"WITH {_DERIVE} SELECT ticker, event_id, round(auc, 6) + 0.0::DOUBLE AS auc, round(p_auc, 6) AS p_auc FROM ap")
def m9b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(study(spark, sf_dir)[2].select("ticker", "event_id", "auc", "p_auc").distinct())


@query("m10_nature", f"WITH {_DERIVE} SELECT ticker, event_id, CASE WHEN p < 0.1 THEN round(rho, 6) + 0.0::DOUBLE END AS rho, CASE WHEN p >= 0.1 THEN 'not significant' WHEN rho > 0.5 THEN 'momentum' WHEN rho < -0.5 THEN 'mean reversion' ELSE 'idiosyncratic' END AS nature FROM na")
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(al.nature(study(spark, sf_dir)[2]))


_TARGETS = f"""{_DERIVE}, us AS (SELECT *, max(significant::INT) OVER (PARTITION BY ticker, event_id) = 0 AS weak FROM l WHERE n >= 2),
ch AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY abs(z) DESC, h) AS place FROM us WHERE significant OR weak), d AS (SELECT ticker, event_id, h, delta FROM re), {_ELBOW},
bo AS (SELECT ticker, event_id, max(h) AS last_h FROM ms WHERE z IS NOT NULL GROUP BY 1, 2),
dv AS (SELECT c.ticker, c.event_id, c.h AS zh, c.delta, c.weak, ap.auc, p_auc, p_auc < 0.1 AS clear, coalesce(stop, last) AS eh, stop IS NULL AS rising, last_h FROM ch c LEFT JOIN ap USING (ticker, event_id) LEFT JOIN eb USING (ticker, event_id) LEFT JOIN bo USING (ticker, event_id) WHERE place = 1),
dt AS (SELECT dv.*, x.delta AS ed, CASE WHEN NOT weak THEN CASE WHEN clear THEN 'both' ELSE 'z_score' END WHEN clear THEN 'auc' END AS route FROM dv LEFT JOIN re x ON x.ticker = dv.ticker AND x.event_id = dv.event_id AND x.h = eh),
tg AS (SELECT ticker, event_id, CASE WHEN route = 'auc' THEN eh ELSE zh END AS h, route, CASE WHEN route = 'auc' THEN ed ELSE delta END AS adv, weak, p_auc, CASE WHEN route = 'auc' THEN rising ELSE zh = last_h END AS edge FROM dt),
fv AS (SELECT tg.ticker, tg.event_id, a.rn, CASE WHEN any_value(adv) > 0 THEN max(y.close) / any_value(x.close) - 1 ELSE 1 - min(y.close) / any_value(x.close) END AS mfe FROM tg JOIN a ON a.ticker = tg.ticker AND a.event_id = tg.event_id JOIN bars x ON x.ticker = a.ticker AND x.rn = a.rn JOIN bars y ON y.ticker = a.ticker AND y.rn > a.rn AND y.rn <= a.rn + tg.h WHERE route IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= any_value(tg.h)),
tp AS (SELECT ticker, event_id, greatest(quantile_cont(mfe, 0.5), 0.005) AS tp FROM fv WHERE mfe > 0 GROUP BY 1, 2)"""


@query(
    "m8b_m11_derived_targets",
    f"""WITH {_TARGETS} SELECT ticker, event_id, h::INTEGER AS h, CASE WHEN route IS NULL THEN 'undetermined' WHEN adv > 0 THEN 'long' ELSE 'short' END AS direction, route, CASE WHEN route IS NOT NULL THEN round(adv, 6) + 0.0::DOUBLE END AS advantage,
weak, CASE WHEN route IS NOT NULL THEN edge END AS at_boundary, CASE WHEN route IS NOT NULL THEN round(coalesce(tp, 0.005), 6) END AS take_profit FROM tg LEFT JOIN tp USING (ticker, event_id)""",
)
def m8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, s = study(spark, sf_dir)
    return rounded(al.derive_target(s, a, bars).select("ticker", "event_id", "h", "direction", "route", "advantage", "weak", "at_boundary", "take_profit"))


@query("m14_fixed_target", f"WITH {_TARGETS}, sg AS (SELECT ticker, event_id, significant FROM l WHERE h = 5) SELECT ticker, event_id, 5 AS h, 0.1::DOUBLE AS take_profit, 'long' AS direction, NOT coalesce(significant, false) AS weak, tg.h::INTEGER AS derived_h FROM tg LEFT JOIN sg USING (ticker, event_id)")
def m14(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a, s = study(spark, sf_dir)
    return al.fixed_target(al.derive_target(s, a, bars), s, 5, 0.1, "long").select("ticker", "event_id", "h", "take_profit", "direction", "weak", "derived_h")


@query("m5_enriched_horizons", "SELECT * FROM (VALUES ('E-SPREAD', 20), ('E-SPREAD', 40), ('E-CROSS', 20), ('E-CROSS', 40), ('E-ZHIGH', 24), ('E-ZHIGH', 48), ('E-ZHIGH', 96), ('E-RANGE', 20), ('E-RANGE', 40), ('E-VOLUME', 20), ('E-VOLUME', 40), ('E-DELTA', 20), ('E-DELTA', 40), ('E-AND', 20), ('E-AND', 40)) v(event_id, h)")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = {e.event_id: e.dominant_window() for e in fixed_events()}
    more = al.enriched_horizons(windows, _H4, 2000)
    return spark.createDataFrame([(e, h) for e, hs in more.items() for h in hs], "event_id string, h int")


@query("m9_auc", f"WITH {_EXC} SELECT ticker, event_id, round(sum(CASE h WHEN 1 THEN 1.0 WHEN 3 THEN 2.0 WHEN 5 THEN 3.5 ELSE 2.5 END::DOUBLE * delta / h), 6) + 0.0::DOUBLE AS auc FROM d GROUP BY 1, 2")
def m9(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.auc(al.excess(a, al.forward(bars, H)), H))


@query("m12_elbow_horizon", f"WITH {_EXC}, {_ELBOW} SELECT ticker, event_id, coalesce(stop, last)::INTEGER AS h_elbow, CASE WHEN stop IS NULL THEN 'rising' ELSE 'plateau' END AS edge FROM eb")
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return al.elbow(al.excess(a, al.forward(bars, H)))


@query("m13_take_profit", f"WITH {EVENTS_SQL}, x AS (SELECT ticker, rn, CASE WHEN count(close) {over(0, lead=5)} >= 5 THEN max(close) {over(0, lead=5)} / close - 1 END AS mfe FROM bars) SELECT ticker, event_id, count(*)::BIGINT AS n, round(greatest(quantile_cont(mfe, 0.5), 0.005), 6) AS take_profit FROM a JOIN x USING (ticker, rn) WHERE mfe > 0 GROUP BY 1, 2")
def m13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.take_profit(a, bars, 5))


_X = "x AS (SELECT ticker, rn, close / nullif(close_sma_20, 0) AS x FROM k)"


@query(
    "m16_spearman_ic",
    f"""WITH {BASE5}, {FWD}, {_X}, j AS (SELECT x.ticker, x.x, f.fwd FROM x JOIN f USING (ticker, rn) WHERE h = 5 AND x IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY x) + (count(*) OVER (PARTITION BY ticker, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY ticker ORDER BY fwd) + (count(*) OVER (PARTITION BY ticker, fwd) - 1) / 2.0::DOUBLE AS b FROM j)
SELECT ticker, count(*)::BIGINT AS n, round(corr(a, b), 6) AS ic FROM r GROUP BY 1""",
)
def m16(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kpi(order_bars(spark, sf_dir))
    x = b.select("ticker", "rn", ratio(F.col("close"), F.col("close_sma_20")).alias("x"))
    return rounded(al.information_coefficient(x, al.forward(b, (5,)), 5).select("ticker", "n", "ic"))


@query("m17_rolling_ic")
def m17(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = kpi(order_bars(spark, sf_dir))
    x = b.select("ticker", "rn", ratio(F.col("close"), F.col("close_sma_20")).alias("x"))
    return rounded(al.rolling_ic_stability(x, al.forward(b, (5,)), 5, 120))


_ST = f"""{EVENTS_SQL}, {HIT}, u AS (SELECT * FROM t WHERE fwd IS NOT NULL AND hit IS NOT NULL), w AS (SELECT e.event_id, u.*, a.rn IS NOT NULL AS on_ FROM (SELECT DISTINCT ticker, event_id FROM a) e JOIN u USING (ticker) LEFT JOIN a USING (ticker, event_id, rn)),
g AS (SELECT ticker, event_id, count(*) FILTER (on_) AS n, avg(hit::INT) FILTER (on_) AS wr, avg(hit::INT) AS br, avg(fwd) FILTER (on_) AS m1, avg(fwd) FILTER (NOT on_) AS m0, var_samp(fwd) FILTER (on_) AS v1, var_samp(fwd) FILTER (NOT on_) AS v0, count(*) FILTER (NOT on_) AS n0 FROM w GROUP BY 1, 2)"""


@query("m18_m20_event_stats", f"WITH {_ST} SELECT ticker, event_id, n::BIGINT AS n, round(wr, 6) AS win_rate, round(br, 6) AS base_rate, round(wr - br, 6) + 0.0::DOUBLE AS lift, round(m1, 6) AS mean, round(m0, 6) AS mean_rest, round((m1 - m0) / sqrt((v1 + v0) / 2), 5) + 0.0::DOUBLE AS cohens_d FROM g")
def m18(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    s = al.event_stats(a, target(bars)).drop("t", "df")
    return rounded(s.withColumn("cohens_d", F.round("cohens_d", 5)))


@query("m29_m30_summary", f"WITH {_ST} SELECT ticker, event_id, round(wr - br, 6) + 0.0::DOUBLE AS lift FROM g WHERE wr - br >= 0.02")
def m29(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    rows = al.event_stats(a, target(bars)).withColumn("direction", F.lit("long")).withColumn("composite", F.col("lift"))
    return rounded(al.promoted(al.summary(rows), 0.02).select("ticker", "event_id", "lift"))


@query("m19_two_sample_t", f"WITH {_ST} SELECT ticker, event_id, round((m1 - m0) / sqrt(((n - 1) * v1 + (n0 - 1) * v0) / (n + n0 - 2) * (1.0::DOUBLE / n + 1.0::DOUBLE / n0)), 4) + 0.0::DOUBLE AS t, (n + n0 - 2)::DOUBLE AS df FROM g")
def m19(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.event_stats(a, target(bars)).select("ticker", "event_id", "t", "df"), 4)


@query("m21_benjamini_hochberg", f"WITH {_ROT}, {_BH} SELECT ticker, event_id, h::INTEGER AS h, round(p, 6) AS p, significant FROM l")
def m21(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = al.rotation_null(*rotation_inputs(spark, sf_dir)).where("z is not null").select("ticker", "event_id", "h", "p")
    return rounded(st.benjamini_hochberg(r, "p", 0.1, "ticker", "event_id"))


#: The upper tail of Student's t by Simpson's rule over 400 steps from 0.
_TAIL = """0.5 - sign(t) * (SELECT sum(CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 400, 2) / df, -(df + 1) / 2)) FROM range(401) x(i))
  * abs(t) / 1200 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())"""


@query("m22_m23_p_values", f"WITH {_ST}, q AS (SELECT ticker, event_id, (m1 - m0) / sqrt(((n - 1) * v1 + (n0 - 1) * v0) / (n + n0 - 2) * (1.0::DOUBLE / n + 1.0::DOUBLE / n0)) AS t, (n + n0 - 2)::DOUBLE AS df FROM g) SELECT ticker, event_id, round(t, 5) + 0.0::DOUBLE AS t, df, round({_TAIL}, 6) + 0.0::DOUBLE AS p_greater FROM q")
def m22(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.with_p(al.event_stats(a, target(bars))).select("ticker", "event_id", F.round("t", 5).alias("t"), "df", "p_greater"))


@query(
    "m24_regime_sensitivity",
    f"""WITH {EVENTS_SQL}, {HIT}, rg AS (SELECT ticker, rn, CASE WHEN close > close_sma_20 THEN 'UP' WHEN close <= close_sma_20 THEN 'DOWN' END AS regime FROM k)
SELECT a.ticker, a.event_id, regime, count(*)::BIGINT AS n, round(avg(hit::INT), 6) AS win_rate, round(avg(fwd), 6) AS mean FROM a JOIN t USING (ticker, rn) JOIN rg USING (ticker, rn) WHERE regime IS NOT NULL AND fwd IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
)
def m24(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    regimes = bars.withColumn("regime", F.when(F.col("close") > F.col("close_sma_20"), "UP").when(F.col("close") <= F.col("close_sma_20"), "DOWN"))
    return rounded(al.regime_sensitivity(a, target(bars), regimes))


@query("m25_out_of_sample", f"WITH {EVENTS_SQL}, {FWD} SELECT a.ticker, a.event_id, count(*)::BIGINT AS n, round(avg(logfwd), 6) + 0.0::DOUBLE AS mean, round(avg(logfwd) / nullif(stddev_samp(logfwd) / sqrt(count(*)), 0), 5) + 0.0::DOUBLE AS t FROM a JOIN f USING (ticker, rn) WHERE h = 5 AND rn >= 1200 AND logfwd IS NOT NULL GROUP BY 1, 2")
def m25(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    o = al.out_of_sample(a, al.forward(bars, (5,)), 1200, 5)
    return rounded(o.select("ticker", "event_id", "n", "mean", F.round("t", 5).alias("t")))


@query(
    "m26_score_and_grade",
    f"""WITH {_ST}, s AS (SELECT ticker, event_id, (0.25 * least(greatest((wr - br) / 0.30, 0), 1) + 0.15 * least(greatest((m1 - m0) / sqrt((v1 + v0) / 2) / 0.80, -1), 1)) / 0.85 AS c FROM g), q AS (SELECT ticker, event_id, least(greatest(c, 0), 1) AS c FROM s)
SELECT ticker, event_id, round(c, 4) + 0.0::DOUBLE AS composite, CASE WHEN c >= 0.75 THEN 'A' WHEN c >= 0.5 THEN 'B' WHEN c >= 0.25 THEN 'C' ELSE 'D' END AS grade FROM q""",
)
def m26(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    none = F.lit(None).cast("double")
    c = al.composite(none, F.col("lift"), F.col("cohens_d"), none, none, weak=F.lit(False), confirmed=F.lit(False))
    return rounded(al.event_stats(a, target(bars)).withColumn("composite", c).withColumn("grade", al.grade(F.col("composite"))).select("ticker", "event_id", "composite", "grade"), 4)


# --- calibration and lift ----------------------------------------------------------------------------


@query("n1_search_null", f"WITH {_ROT}, sd AS (SELECT ticker, event_id, h, stddev_pop(d) AS sd FROM de WHERE o > 0 AND d IS NOT NULL GROUP BY 1, 2, 3), z AS (SELECT de.ticker, o, max(abs(d / sd)) AS z FROM de JOIN sd USING (ticker, event_id, h) WHERE n >= 2 AND d IS NOT NULL AND sd > 0 GROUP BY 1, 2), r AS (SELECT ticker, z AS re FROM z WHERE o = 0) SELECT z.ticker, count(*)::BIGINT AS offsets, round(any_value(re), 5) AS real, round((1 + sum((z >= re)::INT)) / (1 + count(*)), 6) AS p, round(quantile_cont(z, 0.95), 5) AS bar FROM z JOIN r USING (ticker) WHERE o > 0 GROUP BY 1")
def n1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = al.search_null(*rotation_inputs(spark, sf_dir))
    return rounded(out.withColumn("real", F.round("real", 5)).withColumn("bar", F.round("bar", 5)))


@query("n2_sampled_rotations", f"WITH {ORDER_BARS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars), d AS (SELECT * FROM (VALUES (0, 17), (1, 101), (2, 333)) t(draw, k)) SELECT n.ticker, draw::INTEGER AS draw, n.rn::BIGINT AS rn, b.close FROM n, d JOIN bars b ON b.ticker = n.ticker AND b.rn = (n.rn + k) % n.n")
def n2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.rotated(order_bars(spark, sf_dir), [17, 101, 333]).select("ticker", "draw", F.col("rn").cast("long").alias("rn"), "close")


_LIFT = "ba AS (SELECT ticker, avg(hit::INT) AS pb FROM t WHERE hit IS NOT NULL GROUP BY 1), lf AS (SELECT a.ticker, a.event_id, count(*) AS n, avg(hit::INT) AS pe FROM a JOIN t USING (ticker, rn) WHERE hit IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)"


@query("n4_lift_score", f"WITH {EVENTS_SQL}, {HIT}, {_LIFT} SELECT ticker, event_id, n::BIGINT AS n, round(pe, 6) AS p_event, round(pb, 6) AS p_base, round(pe / pb, 6) AS lift, round((pe - pb) / sqrt(pb * (1 - pb) / n), 5) + 0.0::DOUBLE AS z FROM lf JOIN ba USING (ticker) WHERE pb > 0 AND pb < 1")
def n4(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(al.lift_score(a, target(bars)).withColumn("z", F.round("z", 5)))


@query(
    "n5_target_optimizer",
    f"""WITH {EVENTS_SQL}, {HIT}, {_LIFT}, {_PAIRS}, {_MO},
kp AS (SELECT ticker, event_id FROM lf JOIN ba USING (ticker) WHERE pb > 0 AND pb < 1 AND pe / pb >= 1.0),
ax AS (SELECT a.* FROM a SEMI JOIN kp USING (ticker, event_id)),
m AS (SELECT x.ticker, pr.a || '&' || pr.b AS event_id, x.rn, x.open_dt FROM pr JOIN ax x ON x.event_id = pr.a JOIN ax y ON y.event_id = pr.b AND y.ticker = x.ticker AND y.rn = x.rn),
en AS (SELECT ticker, event_id FROM m JOIN nm USING (ticker) GROUP BY 1, 2 HAVING count(*) >= greatest(1, floor(0.5 * any_value(months)))),
al AS (SELECT ticker, event_id, rn, open_dt FROM ax UNION ALL SELECT ticker, event_id, rn, open_dt FROM m SEMI JOIN en USING (ticker, event_id)),
l2 AS (SELECT al.ticker, al.event_id, count(*) AS n, avg(hit::INT) AS pe FROM al JOIN t USING (ticker, rn) WHERE hit IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
sv AS (SELECT ticker, event_id, l2.n, pe, pb, pe / pb AS lift FROM l2 JOIN ba USING (ticker) WHERE pb > 0 AND pb < 1 AND pe / pb >= 1.05),
q AS (SELECT al.*, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM al SEMI JOIN sv USING (ticker, event_id)),
c AS (SELECT ticker, event_id, year(open_dt) * 12 + month(open_dt) AS month, sum((q IS NULL OR rn - q - 1 > 1)::INT) AS ep FROM q GROUP BY 1, 2, 3),
g AS (SELECT sv.ticker, sv.event_id, any_value(sv.n) AS n, any_value(pe) AS pe, any_value(pb) AS pb, any_value(lift) AS lift, sum(coalesce(ep, 0)) AS ne, avg(coalesce(ep, 0)) AS et, var_samp(coalesce(ep, 0)) / nullif(avg(coalesce(ep, 0)), 0) AS ed, count(*) AS k FROM sv JOIN mo USING (ticker) LEFT JOIN c USING (ticker, event_id, month) GROUP BY 1, 2),
ok AS (SELECT * FROM g WHERE NOT (et < 0.5 OR ne < 10 OR coalesce(ed > pow(1 - 2 / (9.0::DOUBLE * (k - 1)) + {gt.Z95!r} * sqrt(2 / (9.0::DOUBLE * (k - 1))), 3) * 1.3, false)))
SELECT ticker, event_id, n::BIGINT AS n, round(pe, 6) AS p_event, round(lift, 6) AS lift, row_number() OVER (PARTITION BY ticker ORDER BY lift DESC, event_id)::INTEGER AS place FROM ok""",
)
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms, lift prune, AND, prune, gate and ranking over the fixed events."""
    bars, a, p = pooled(spark, sf_dir)
    out = al.optimise_target(a, target(bars), bars, co.candidate_pairs(p))
    return rounded(out.select("ticker", "event_id", "n", "p_event", "lift", "place"))


def _lift(where: str) -> str:
    return f"SELECT a.ticker, a.event_id, avg(hit::INT) AS pe, count(*) AS n FROM a JOIN t USING (ticker, rn) WHERE hit IS NOT NULL AND {where} GROUP BY 1, 2 HAVING count(*) >= 10"


@query(
    "n6_out_of_sample_lift",
    f"WITH {EVENTS_SQL}, {HIT}, bi AS (SELECT ticker, avg(hit::INT) AS b FROM t WHERE hit IS NOT NULL AND rn < 1200 GROUP BY 1), bo AS (SELECT ticker, avg(hit::INT) AS b FROM t WHERE hit IS NOT NULL AND rn >= 1200 GROUP BY 1), i AS ({_lift('rn < 1200')}), o AS ({_lift('rn >= 1200')}) SELECT i.ticker, i.event_id, round(i.pe / bi.b, 6) AS lift, round(o.pe / bo.b, 6) AS lift_oos FROM i JOIN bi USING (ticker) LEFT JOIN o USING (ticker, event_id) LEFT JOIN bo USING (ticker)",
)
def n6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    t = target(bars)
    inner, outer = (al.lift_score(a.where(c), t.where(c)) for c in (F.col("rn") < 1200, F.col("rn") >= 1200))
    return rounded(inner.select("ticker", "event_id", "lift").join(outer.select("ticker", "event_id", F.col("lift").alias("lift_oos")), ["ticker", "event_id"], "left"))
