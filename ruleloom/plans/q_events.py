"""Queries of typing (C), features (F), transforms (T), events (E) and gates (G)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions.windows import full, lag, ratio
from ruleloom.operators import events as ev
from ruleloom.operators import features as ft
from ruleloom.operators import gate as gt
from ruleloom.plans.registry import over, query, rounded, s_full, s_lag, s_ratio
from ruleloom.sources.bars import ORDER_BARS_SQL, TOTAL_BARS_SQL, order_bars, total_bars

#: A small indicator table that SQL builds without recursion.
KPI_SQL = f"""k AS (SELECT *, {s_full('close', 5, 'avg')} AS close_sma_05, {s_full('close', 20, 'avg')} AS close_sma_20, {s_full('volume', 20, 'avg')} AS volume_sma_20,
  {s_full('close', 20, 'min')} AS close_min_20, {s_full('close', 20, 'max')} AS close_max_20, {s_ratio('close', s_lag('close', 3))} - 1 AS close_ret_03, {s_ratio('volume', s_lag('volume', 3))} - 1 AS volume_ret_03,
  {s_full('close', 20, 'avg')} - 2 * {s_full('close', 20, 'stddev_samp')} AS close_bb_lower_20, {s_full('close', 20, 'avg')} + 2 * {s_full('close', 20, 'stddev_samp')} AS close_bb_upper_20,
  {s_ratio('close - open', 'high - low')} AS body, {s_ratio('high - greatest(open, close)', 'high - low')} AS upper_wick FROM bars)"""
BASE = f"{TOTAL_BARS_SQL}, {KPI_SQL}"
BASE5 = f"{ORDER_BARS_SQL}, {KPI_SQL}"


def kpi(bars: DataFrame) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    mean, sd = full(c, 20, F.avg), full(c, 20, F.stddev_samp)
    return bars.select(
        "*",
        full(c, 5, F.avg).alias("close_sma_05"),
        mean.alias("close_sma_20"),
        full(v, 20, F.avg).alias("volume_sma_20"),
        full(c, 20, F.min).alias("close_min_20"),
        full(c, 20, F.max).alias("close_max_20"),
        (ratio(c, lag(c, 3)) - 1).alias("close_ret_03"),
        (ratio(v, lag(v, 3)) - 1).alias("volume_ret_03"),
        (mean - 2 * sd).alias("close_bb_lower_20"),
        (mean + 2 * sd).alias("close_bb_upper_20"),
        ratio(c - F.col("open"), F.col("high") - F.col("low")).alias("body"),
        ratio(F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low")).alias("upper_wick"),
    )


def total_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi(total_bars(spark, sf_dir))


def shape(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rounded(df.select("ticker", F.col("rn").cast("long").alias("rn"), *columns), digits)


# --- typing ------------------------------------------------------------------------------------------

_C = ("close", "volume", "body", "close_ret_03", "close_sma_20")


@query("c1_classify_columns", f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS non_null, count(DISTINCT {c})::BIGINT AS distinct_values FROM k" for c in _C))
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.count_values(total_kpi(spark, sf_dir), list(_C))


@query(
    "c2_scale_free",
    f"WITH {BASE}, l AS ("
    + " UNION ALL ".join(f"SELECT ticker, rn, '{c}' AS col, {c} AS v FROM k WHERE {c} IS NOT NULL" for c in _C)
    + """), i AS (SELECT *, row_number() OVER (PARTITION BY ticker, col ORDER BY rn) - 1 AS i, count(*) OVER (PARTITION BY ticker, col) AS n FROM l),
b AS (SELECT *, greatest(2, least(4, n // 250)) AS blocks FROM i), c AS (SELECT *, least(blocks - 1, i // greatest(1, n // blocks)) AS block FROM b),
g AS (SELECT ticker, col, quantile_cont(v, 0.05) AS g0, quantile_cont(v, 0.95) AS g1, min(n) AS n, min(blocks) AS blocks FROM c GROUP BY 1, 2),
p AS (SELECT ticker, col, block, quantile_cont(v, 0.05) AS b0, quantile_cont(v, 0.95) AS b1 FROM c GROUP BY 1, 2, 3)
SELECT ticker, col AS "column", n::BIGINT AS n, blocks::BIGINT AS blocks, round(min(CASE WHEN g1 = g0 THEN 0 ELSE coalesce(greatest(0, least(b1, g1) - greatest(b0, g0)) / nullif(greatest(b1, g1) - least(b0, g0), 0), 0) END), 6) AS overlap
FROM p JOIN g USING (ticker, col) GROUP BY ticker, col, n, blocks""",
)
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.scale_free_overlap(total_kpi(spark, sf_dir), list(_C))
    return rounded(out.withColumn("n", F.col("n").cast("long")).withColumn("blocks", F.col("blocks").cast("long")))


# --- features ----------------------------------------------------------------------------------------


def _features(name: str, *features: ft.Feature) -> None:
    """A query of some features; SQL renders the same specifications (spreads as sub-queries)."""
    cols = ", ".join(f"round({f.sql() if f.operation != 'diffnorm' else f'({f.sources[0]} - {f.sources[1]}) / (SELECT nullif(stddev_samp({f.sources[0]} - {f.sources[1]}), 0) FROM k)'}, 6) + 0.0::DOUBLE AS \"{f.name}\"" for f in features)

    @query(name, f"WITH {BASE} SELECT ticker, rn::BIGINT AS rn, {cols} FROM k")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = total_kpi(spark, sf_dir)
        return shape(ft.add_features(df, ft.freeze(df, list(features))), *(f.name for f in features))


_F = ft.Feature
_features("f3_same_family_pairs", _F("ratio_close_sma05_sma20", "ratio", ("close_sma_05", "close_sma_20")), _F("diffnorm_close_sma05_sma20", "diffnorm", ("close_sma_05", "close_sma_20")))
_features("f4_price_ma_spread", _F("spread_close_sma05", "spread", ("close", "close_sma_05")), _F("spread_close_sma20", "spread", ("close", "close_sma_20")))
_features("f5_volume_ma_ratio", _F("ratio_volume_sma20", "ratio", ("volume", "volume_sma_20")))
_features("f6_ohlc_lag_cross", *(_F(f"{op}_close_{b}_lag{k}", op, ("close", b), lag=k) for b in ("open", "high", "low") for k in (1, 3) for op in ("ratio", "spread")))
_features("f7_indicator_lag_cross", *(_F(f"ratio_sma20_{b}_lag{k}", "ratio", ("close_sma_20", b), lag=k) for b in ("open", "close") for k in (1, 3)))
_features("f10_price_volume_pairs", _F("ratio_close_volume_ret03", "ratio", ("close_ret_03", "volume_ret_03")), _F("diffnorm_close_volume_ret03", "diffnorm", ("close_ret_03", "volume_ret_03")))
_features("f11_candle_geometry_pairs", _F("ratio_candle_body_upper_wick", "ratio", ("body", "upper_wick")), _F("diffnorm_candle_body_upper_wick", "diffnorm", ("body", "upper_wick")))
_features("f12_percent_b", _F("bb_pct_b_close_20", "position", ("close", "close_bb_lower_20", "close_bb_upper_20")))
_features("f13_range_position", _F("pos_close_range20", "position", ("close", "close_min_20", "close_max_20")))


_MAC = f"""e AS (SELECT n.*, n.close AS f, n.close AS s, 0::DOUBLE AS g FROM bars n WHERE rn = 0 UNION ALL SELECT n.*, {1 - 2 / 13!r} * p.f + {2 / 13!r} * n.close, {1 - 2 / 27!r} * p.s + {2 / 27!r} * n.close,
  0.8 * p.g + 0.2 * (({1 - 2 / 13!r} * p.f + {2 / 13!r} * n.close) - ({1 - 2 / 27!r} * p.s + {2 / 27!r} * n.close)) / n.close FROM e p JOIN bars n ON n.ticker = p.ticker AND n.rn = p.rn + 1),
w AS (SELECT ticker, rn, round_even((f - s) / close, 5) AS m, round_even(g, 5) AS g FROM e)"""


@query("f8_macd_pairs", f"WITH RECURSIVE {TOTAL_BARS_SQL}, {_MAC} SELECT ticker, rn::BIGINT AS rn, round(m / nullif(g, 0), 6) + 0.0::DOUBLE AS ratio_close_macd12_26_signal, round((m - g) / (SELECT stddev_samp(m - g) FROM w), 6) + 0.0::DOUBLE AS diffnorm_close_macd12_26_signal FROM w")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.operators.indicators import build_features

    df = build_features(total_bars(spark, sf_dir), {"macd": {"columns": ["close"], "periods": [12, 26, 9]}})
    plan = ft.freeze(df, [f for f in ft.plan_features({c: ft.Classified(c, ft.CONTINUOUS) for c in df.columns if "macd" in c}, df.columns) if "signal" in f.name and "macd" in f.sources[0]])
    return shape(ft.add_features(df, plan), *(f.name for f in plan))


_ARO = f"h AS (SELECT ticker, rn, {s_full('high', 15, 'list')} AS h, {s_full('low', 15, 'list')} AS l FROM bars), w AS (SELECT ticker, rn, round((list_position(h, list_max(h)) - 1) / 14.0::DOUBLE * 100, 5) AS u, round((list_position(l, list_min(l)) - 1) / 14.0::DOUBLE * 100, 5) AS d FROM h)"


@query("f9_aroon_pairs", f"WITH {TOTAL_BARS_SQL}, {_ARO} SELECT ticker, rn::BIGINT AS rn, round(u / nullif(d, 0), 6) AS ratio_aroon14_up_down, round((u - d) / (SELECT stddev_samp(u - d) FROM w), 6) + 0.0::DOUBLE AS diffnorm_aroon14_up_down FROM w")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ruleloom.operators.indicators import build_features

    df = build_features(total_bars(spark, sf_dir), {"aroon": {"columns": ["close"], "periods": [14]}})
    plan = ft.freeze(df, [f for f in ft.plan_features({c: ft.Classified(c, ft.CONTINUOUS) for c in df.columns if "aroon" in c}, df.columns) if "up_down" in f.name])
    return shape(ft.add_features(df, plan), *(f.name for f in plan))


@query("f1_feature_plan")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of all features of the indicator table, in order."""
    df = total_kpi(spark, sf_dir)
    plan = ft.freeze(df, ft.plan_features(ft.classify(df), df.columns))
    return spark.createDataFrame([(i, f.name, f.operation, list(f.sources), f.lag, f.std) for i, f in enumerate(plan)], "i int, name string, operation string, sources array<string>, lag int, std double")


# --- transforms --------------------------------------------------------------------------------------


def _transforms(name: str, *ts: ft.Transform) -> None:
    sql = ", ".join(f"round({t.sql('x')}, 6) + 0.0::DOUBLE AS {t.tag}" for t in ts)

    @query(name, f"WITH {BASE5}, s AS (SELECT ticker, rn, {s_ratio('close - close_sma_20', 'close_sma_20')} AS x FROM k) SELECT ticker, rn::BIGINT AS rn, {sql} FROM s")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = kpi(order_bars(spark, sf_dir)).withColumn("x", ratio(F.col("close") - F.col("close_sma_20"), F.col("close_sma_20")))
        return rounded(df.select("ticker", "rn", *(t.column(F.col("x")).alias(t.tag) for t in ts)).withColumn("rn", F.col("rn").cast("long")))


_transforms("t1_identity", ft.Transform())
_transforms("t2_rolling_pctrank", *(ft.Transform("pctrank", w) for w in ft.WINDOWS))
_transforms("t3_rolling_zscore", *(ft.Transform("zscore", w) for w in ft.WINDOWS))
_transforms("t4_delta", *(ft.Transform("delta", k) for k in ft.DELTAS))

# --- events ------------------------------------------------------------------------------------------

_X = f"x AS (SELECT *, {s_ratio('close - close_sma_20', 'close_sma_20')} AS x FROM k)"
_SPREAD = _F("spread_close_sma20", "spread", ("close", "close_sma_20"))


@query("e1_tail_thresholds", f"WITH {BASE}, {_X}, q AS (SELECT count(x) AS n, quantile_cont(x, [0.03, 0.05, 0.08, 0.1, 0.15, 0.85, 0.9, 0.92, 0.95, 0.97]) AS q FROM x) SELECT n::BIGINT AS n, i::INTEGER AS i, round(q[i + 1], 6) + 0.0::DOUBLE AS threshold FROM q, range(10) t(i)")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, low, high = ev.thresholds(total_kpi(spark, sf_dir), {"x": _SPREAD.column()})["x"]
    return rounded(spark.createDataFrame([(n, i, q) for i, q in enumerate(low + high)], "n long, i int, threshold double"))


def fixed_events() -> list[ev.Event]:
    """Events with given thresholds, so that SQL needs no measured numbers."""
    z = ft.Transform("zscore", 48)
    pos = _F("pos_close_range20", "position", ("close", "close_min_20", "close_max_20"))
    vol = _F("ratio_volume_sma20", "ratio", ("volume", "volume_sma_20"))
    C = ev.Component
    return [
        ev.Event("E-SPREAD", (C(_SPREAD, threshold=-0.1),)),
        ev.Event("E-CROSS", (C(_SPREAD, kind="crossing", threshold=-0.05),)),
        ev.Event("E-ZHIGH", (C(_SPREAD, z, direction="above", threshold=1.0),)),
        ev.Event("E-RANGE", (C(pos, threshold=0.2),)),
        ev.Event("E-VOLUME", (C(vol, direction="above", threshold=1.2),)),
        ev.Event("E-DELTA", (C(_SPREAD, ft.Transform("delta", 1), direction="above", threshold=0.2),)),
        ev.Event("E-AND", (C(pos, threshold=0.3), C(vol, direction="above", threshold=1.0))),
    ]


def _events_sql(events: list[ev.Event], source: str = "k") -> str:
    return " UNION ALL ".join(f"SELECT ticker, '{e.event_id}' AS event_id, rn, open_dt, active FROM ({e.duckdb(source)})" for e in events)


EVENTS_SQL = f"{BASE5}, ev AS ({_events_sql(fixed_events())}), a AS (SELECT ticker, event_id, rn, open_dt FROM ev WHERE active)"


def fixed_activations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = kpi(order_bars(spark, sf_dir))
    return bars, ev.activations(bars, fixed_events())


def _event(name: str, *ids: str) -> None:
    chosen = [e for e in fixed_events() if e.event_id in ids]
    sql = " UNION ALL ".join(f"SELECT ticker, '{e.event_id}' AS event_id, rn::BIGINT AS rn, active FROM ({e.duckdb('k')})" for e in chosen)

    @query(name, f"WITH {BASE5} {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = kpi(order_bars(spark, sf_dir))
        wide = df.select("ticker", "rn", *(e.column().alias(f"e{i}") for i, e in enumerate(chosen)))
        rows = F.explode(F.array(*(F.struct(F.lit(e.event_id).alias("event_id"), F.col(f"e{i}").alias("active")) for i, e in enumerate(chosen))))
        return wide.select("ticker", F.col("rn").cast("long").alias("rn"), rows.alias("x")).select("ticker", "rn", "x.event_id", "x.active")


_event("e2_zscore_threshold", "E-ZHIGH")
_event("e3_threshold_predicate", "E-SPREAD", "E-RANGE", "E-VOLUME", "E-DELTA")
_event("e4_crossing_predicate", "E-CROSS")
_event("e10_and_replay", "E-AND")


@query("e5_binary_native", f"WITH {BASE5}, b AS (SELECT *, CASE WHEN close > open THEN 1 ELSE 0 END AS up FROM k) SELECT ticker, rn::BIGINT AS rn, up = (SELECT max(up) FROM b) AS active FROM b")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kpi(order_bars(spark, sf_dir)).withColumn("up", F.when(F.col("close") > F.col("open"), 1).otherwise(0))
    e = next(e for e in ev.generate(df, [], {}, binary=["up"]))
    return df.select("ticker", F.col("rn").cast("long").alias("rn"), e.column().alias("active"))


@query("e6_categorical_one_hot", f"WITH {BASE5}, b AS (SELECT *, CASE WHEN close > open THEN 'UP' WHEN close < open THEN 'DOWN' ELSE 'FLAT' END AS c FROM k) SELECT ticker, rn::BIGINT AS rn, c AS class FROM b")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("close") > F.col("open"), "UP").when(F.col("close") < F.col("open"), "DOWN").otherwise("FLAT")
    df = kpi(order_bars(spark, sf_dir)).withColumn("c", c)
    found = ev.generate(df, [], {}, categorical=["c"])
    rows = ev.activations(df, found, keep=())
    names = F.create_map(*(F.lit(x) for e in found for x in (e.event_id, e.components[0].threshold)))
    return rows.select("ticker", F.col("rn").cast("long").alias("rn"), F.element_at(names, F.col("event_id")).alias("class"))


@query("e6b_event_generation", f"WITH {BASE}, {_X}, q AS (SELECT unnest(quantile_cont(x, [0.03, 0.05, 0.08, 0.1, 0.15])) AS t FROM x) SELECT round(t, 6) + 0.0::DOUBLE AS threshold, (SELECT count(*) FROM x WHERE x.x < t)::BIGINT AS n FROM q")
def e6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = total_kpi(spark, sf_dir)
    found = [e for e in ev.generate(df, [_SPREAD], {_SPREAD.name: [ft.Transform()]}) if e.components[0].kind == "threshold" and e.components[0].direction == "below"]
    n = ev.activations(df, found, keep=()).groupBy("event_id").agg(F.count("*").alias("n"))
    t = spark.createDataFrame([(e.event_id, float(e.components[0].threshold)) for e in found], "event_id string, threshold double")
    return rounded(t.join(n, "event_id").select("threshold", "n"))


@query("e11_custom_formula", f"WITH {BASE5} SELECT ticker, rn::BIGINT AS rn, coalesce(close > close_sma_20 AND volume > 2, false) AS active FROM k")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ev.formula_event("CUSTOM", "close > close_sma_20 AND volume > 2")
    return kpi(order_bars(spark, sf_dir)).select("ticker", F.col("rn").cast("long").alias("rn"), e.column().alias("active"))


# --- episodes and gate -------------------------------------------------------------------------------

_EPI = "p AS (SELECT *, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS q FROM a), s AS (SELECT *, q IS NULL OR rn - q - 1 > 1 AS starts FROM p)"


@query("g1_episode_starts", f"WITH {EVENTS_SQL}, {_EPI} SELECT ticker, event_id, rn::BIGINT AS rn, starts FROM s")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.with_episodes(fixed_activations(spark, sf_dir)[1]).select("ticker", "event_id", F.col("rn").cast("long").alias("rn"), "starts")


@query("g3_episode_ids", f"WITH {EVENTS_SQL}, {_EPI} SELECT ticker, event_id, rn::BIGINT AS rn, (sum(starts::INT) OVER (PARTITION BY ticker, event_id ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS episode FROM s")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.with_episodes(fixed_activations(spark, sf_dir)[1]).select("ticker", "event_id", F.col("rn").cast("long").alias("rn"), "episode")


@query(
    "g4_concurrency",
    f"""WITH {EVENTS_SQL}, o AS (SELECT ticker, event_id, unnest(range(rn, rn + 6)) AS bar FROM a), c AS (SELECT ticker, event_id, bar, count(*) AS n FROM o GROUP BY 1, 2, 3),
t AS (SELECT ticker, event_id, count(*) AS trades FROM a GROUP BY 1, 2)
SELECT ticker, event_id, max(n)::BIGINT AS peak, count(*)::BIGINT AS occupied, sum(n)::BIGINT AS position_bars, any_value(trades)::BIGINT AS trades, round(sum(n) / count(*), 6) AS mean_open, round(any_value(trades) / (sum(n) / count(*)), 6) AS effective_trades
FROM c JOIN t USING (ticker, event_id) GROUP BY ticker, event_id""",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fixed_activations(spark, sf_dir)[1].withColumn("fill_rn", F.col("rn")).withColumn("exit_rn", F.col("rn") + 5)
    return rounded(gt.concurrency(a, "ticker", "event_id"))


_MON = f"""{_EPI}, mo AS (SELECT DISTINCT ticker, year(open_dt) * 12 + month(open_dt) AS month FROM bars), c AS (SELECT ticker, event_id, year(open_dt) * 12 + month(open_dt) AS month, count(*) AS bars, sum(starts::INT) AS episodes FROM s GROUP BY 1, 2, 3),
m AS (SELECT e.ticker, e.event_id, mo.month, coalesce(c.bars, 0)::BIGINT AS bars, coalesce(c.episodes, 0)::BIGINT AS episodes FROM (SELECT DISTINCT ticker, event_id FROM a) e JOIN mo USING (ticker) LEFT JOIN c USING (ticker, event_id, month))"""


@query("g5_month_index", f"WITH {ORDER_BARS_SQL}, mo AS (SELECT DISTINCT ticker, year(open_dt) * 12 + month(open_dt) AS month FROM bars) SELECT ticker, month::INTEGER AS month, (dense_rank() OVER (PARTITION BY ticker ORDER BY month) - 1)::INTEGER AS month_index FROM mo")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt.months_of(order_bars(spark, sf_dir))


@query("g6_monthly_counts", f"WITH {EVENTS_SQL}, {_MON} SELECT ticker, event_id, month::INTEGER AS month, bars, episodes FROM m")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.monthly_counts(a, bars)


_MET = f"""{_MON}, r AS (SELECT ticker, event_id, count(*) AS n_months, sum(bars) AS n_activations, sum((bars > 0)::INT) AS n_active_months, max(bars) / sum(bars) AS max_monthly_share, avg(bars) AS mean_tpm, var_samp(bars) / avg(bars) AS dispersion,
  sum(episodes) AS n_episodes, avg(episodes) AS episode_tpm, var_samp(episodes) / nullif(avg(episodes), 0) AS episode_dispersion FROM m GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN episode_dispersion > 0 THEN n_episodes / episode_dispersion ELSE n_episodes END AS n_eff, pow(1 - 2 / (9.0::DOUBLE * (n_months - 1)) + {gt.Z95!r} * sqrt(2 / (9.0::DOUBLE * (n_months - 1))), 3) * 1.3 AS lim FROM r),
h AS (SELECT *, greatest(0, 0.5 - {gt.Z95_TWO_SIDED!r} * sqrt(lim * 0.5 / n_months)) AS tpm_low, 0.5 + {gt.Z95_TWO_SIDED!r} * sqrt(lim * 0.5 / n_months) AS tpm_high FROM g)"""
_MET_OUT = "ticker, event_id, n_months::BIGINT AS n_months, n_activations::BIGINT AS n_activations, n_active_months::BIGINT AS n_active_months, round(max_monthly_share, 6) AS max_monthly_share, round(mean_tpm, 6) AS mean_tpm, round(dispersion, 6) AS dispersion, n_episodes::BIGINT AS n_episodes, round(episode_tpm, 6) AS episode_tpm, round(episode_dispersion, 6) AS episode_dispersion, round(n_eff, 5) AS n_eff"


@query("g7_gate_metrics", f"WITH {EVENTS_SQL}, {_MET} SELECT {_MET_OUT} FROM h")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    out = gt.gate_metrics(a, bars).drop("limit", "tpm_low", "tpm_high")
    return rounded(out.withColumn("n_eff", F.round("n_eff", 5)))


def _gate(name: str, p: gt.GateParams, reason: str) -> None:
    @query(name, f"WITH {EVENTS_SQL}, {_MET}, f AS (SELECT ticker, event_id, {reason} AS fail_reason FROM h) SELECT *, fail_reason IS NULL AS passed FROM f")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars, a = fixed_activations(spark, sf_dir)
        return gt.gate(a, bars, p).select("ticker", "event_id", "fail_reason", "passed")


_gate("g8_gate_decision", gt.GateParams(), "CASE WHEN episode_tpm < 0.5 THEN 'rate' WHEN n_episodes < 10 THEN 'episodes' WHEN episode_dispersion > lim THEN 'episode dispersion' END")
_gate("g8_gate_decision_bar", gt.GateParams(counting="bar"), "CASE WHEN mean_tpm < 0.5 THEN 'rate' WHEN dispersion > 1.5 THEN 'dispersion' END")
_gate("g10_gate_ranged_band", gt.GateParams(mode="ranged"), "CASE WHEN n_episodes = 0 OR episode_tpm < tpm_low OR episode_tpm > tpm_high THEN 'rate' WHEN n_episodes < 10 THEN 'episodes' WHEN episode_dispersion > lim THEN 'episode dispersion' END")


@query("g9_dispersion_limit", f"WITH {EVENTS_SQL}, {_MET} SELECT DISTINCT ticker, n_months::BIGINT AS n_months, round(lim, 6) AS \"limit\", round(tpm_low, 6) AS tpm_low, round(tpm_high, 6) AS tpm_high FROM h")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(gt.gate_metrics(a, bars).select("ticker", "n_months", "limit", "tpm_low", "tpm_high").distinct())


@query("g12_zero_months", f"WITH {EVENTS_SQL}, b AS (SELECT ticker, min(year(open_dt) * 12 + month(open_dt)) AS x, max(year(open_dt) * 12 + month(open_dt)) AS y FROM bars GROUP BY 1), u AS (SELECT ticker, event_id, count(DISTINCT year(open_dt) * 12 + month(open_dt)) AS n FROM a GROUP BY 1, 2) SELECT ticker, event_id, (y - x + 1 - n)::BIGINT AS zero_months FROM u JOIN b USING (ticker)")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.zero_months(a, bars)


@query("g13_event_overlap", f"WITH {EVENTS_SQL}, n AS (SELECT ticker, event_id, count(*) AS n FROM a GROUP BY 1, 2), p AS (SELECT x.ticker, x.event_id AS a, y.event_id AS b, count(*) AS shared FROM a x JOIN a y ON x.ticker = y.ticker AND x.rn = y.rn AND x.event_id < y.event_id GROUP BY 1, 2, 3) SELECT p.ticker, a, b, shared::BIGINT AS shared, x.n::BIGINT AS na, y.n::BIGINT AS nb, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN n x ON x.ticker = p.ticker AND x.event_id = a JOIN n y ON y.ticker = p.ticker AND y.event_id = b")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gt.overlaps(fixed_activations(spark, sf_dir)[1]))


#: The greedy choice as a recursion over the events of a ticker by falling activations; a string lists those that are kept.
_DIVERSE = """n AS (SELECT ticker, event_id, count(*) AS n FROM a GROUP BY 1, 2), o AS (SELECT ticker, event_id, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, event_id) AS r FROM n),
p AS (SELECT x.ticker, x.event_id AS a, y.event_id AS b, count(*) AS s FROM a x JOIN a y ON x.ticker = y.ticker AND x.rn = y.rn AND x.event_id <> y.event_id GROUP BY 1, 2, 3),
near AS (SELECT p.ticker, a, list(b) AS bs FROM p JOIN n x ON x.ticker = p.ticker AND x.event_id = a JOIN n y ON y.ticker = p.ticker AND y.event_id = b WHERE s / (x.n + y.n - s) >= 0.3 GROUP BY 1, 2),
g AS (SELECT ticker, r, [event_id] AS kept FROM o WHERE r = 1 UNION ALL SELECT g.ticker, o.r, CASE WHEN list_has_any(kept, coalesce(bs, [])) THEN kept ELSE list_append(kept, o.event_id) END
  FROM g JOIN o ON o.ticker = g.ticker AND o.r = g.r + 1 LEFT JOIN near ON near.ticker = o.ticker AND near.a = o.event_id)"""


@query("g13_diversity_gate", f"WITH RECURSIVE {EVENTS_SQL}, {_DIVERSE}, w AS (SELECT ticker, arg_max(kept, r) AS kept FROM g GROUP BY 1) SELECT ticker, (i - 1)::INTEGER AS i, kept[i] AS event_id FROM (SELECT ticker, kept, unnest(range(1, len(kept) + 1)) AS i FROM w)")
def g13b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that each ticker keeps, in the order of their choice."""
    return gt.diversity(fixed_activations(spark, sf_dir)[1], 0.3)


@query(
    "g15_survival_report",
    f"""WITH {EVENTS_SQL}, {_MET}, f AS (SELECT *, CASE WHEN episode_tpm < 0.5 THEN 'rate' WHEN n_episodes < 10 THEN 'episodes' WHEN episode_dispersion > lim THEN 'episode dispersion' END AS fr FROM h)
SELECT ticker, count(*)::BIGINT AS n, sum((fr IS NULL)::INT)::BIGINT AS n_passed, round(median(episode_tpm), 6) AS median_episode_tpm, median(n_episodes)::DOUBLE AS median_n_episodes, round(median(episode_dispersion), 6) AS median_episode_dispersion,
round(avg(coalesce(fr = 'rate', false)::INT), 6) AS share_rate, round(avg(coalesce(fr = 'episodes', false)::INT), 6) AS share_episodes, round(avg(coalesce(fr = 'episode dispersion', false)::INT), 6) AS share_episode_dispersion, sum((fr IS NULL)::INT) < 0.15 * count(*) AS low_survival FROM f GROUP BY ticker""",
)
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return rounded(gt.survival(gt.gate(a, bars)))


@query(
    "e6e_event_folds",
    f"""WITH {EVENTS_SQL}, o AS (SELECT ticker, rn, open_dt, least(floor((rn - 1000) * 3 / count(*) OVER (PARTITION BY ticker)), 2)::INT AS fold FROM bars WHERE rn >= 1000),
mo AS (SELECT ticker, fold, count(DISTINCT year(open_dt) * 12 + month(open_dt)) AS months FROM o GROUP BY 1, 2),
h AS (SELECT a.ticker, a.event_id, o.fold, a.rn, lag(a.rn) OVER (PARTITION BY a.ticker, a.event_id, o.fold ORDER BY a.rn) AS q FROM a JOIN o USING (ticker, rn)),
p AS (SELECT ticker, event_id, fold, sum((q IS NULL OR rn - q - 1 > 1)::INT) AS episodes FROM h GROUP BY 1, 2, 3),
e AS (SELECT x.ticker, x.event_id, mo.fold, months, coalesce(episodes, 0) AS episodes FROM (SELECT DISTINCT ticker, event_id FROM a) x JOIN mo USING (ticker) LEFT JOIN p USING (ticker, event_id, fold)),
g AS (SELECT ticker, event_id, sum((0.5 * months >= 3)::INT) AS testable, sum((0.5 * months >= 3 AND episodes >= 0.5 * months)::INT) AS passed_folds FROM e GROUP BY 1, 2)
SELECT ticker, event_id, testable::BIGINT AS testable, passed_folds::BIGINT AS passed_folds, CASE WHEN testable = 0 THEN 'indeterminate' WHEN passed_folds >= 0.6 * testable THEN 'passed' ELSE 'failed' END AS verdict FROM g""",
)
def e6e(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return gt.fold_validation(a, bars, 1000)


del lru_cache, over
