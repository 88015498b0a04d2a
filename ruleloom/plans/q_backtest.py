"""Queries of backtests, grids, walk-forward and verdicts (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import stats as st
from ruleloom.operators import backtest as bt
from ruleloom.operators import gate as gt
from ruleloom.plans.q_events import EVENTS_SQL, fixed_activations
from ruleloom.plans.registry import query, rounded

LONG = bt.Params(drop=0.2, delay=3, sell=0.3, horizon=6)
SHORT = bt.Params(direction="short", drop=0.2, delay=3, sell=0.2, horizon=6)
MARKET = bt.Params(buy_type="market", sell=0.3, horizon=6, hit_col="high")
GRID = [bt.Params(drop=d, delay=3, sell=s, horizon=h) for d in (0.1, 0.3) for s in (0.2, 0.4) for h in (3, 6)]
KEYS = ("ticker", "event_id")


def grid_sql(params: list[bt.Params]) -> str:
    rows = ", ".join(f"({i}, '{p.direction}', '{p.buy_type}', {p.drop!r}::DOUBLE, {p.delay}, {p.sell!r}::DOUBLE, {p.horizon}, {p.fee!r}::DOUBLE, '{p.hit_col}')" for i, p in enumerate(params))
    return f"gr AS (SELECT * FROM (VALUES {rows}) v(cell, direction, buy_type, dr, delay, sell, h, fee, hit_col))"


def ledger_sql(params: list[bt.Params], windows: str = "") -> str:
    """The ledger as common table expressions ending in ``l``, from ``a`` and ``bars``; by loops over joined bars."""
    w, wk = (", wi.win", ", win") if windows else ("", "")
    join = " JOIN wi ON n.open_dt >= wi.f AND n.open_dt < wi.t" if windows else ""
    return f"""{grid_sql(params)}{', ' + windows if windows else ''}, la AS (SELECT ticker, max(rn) AS last FROM bars GROUP BY 1),
lg AS (SELECT *, lag(rn) OVER (PARTITION BY ticker, event_id ORDER BY rn) AS pv FROM a), ep AS (SELECT *, sum((pv IS NULL OR rn - pv > 2)::INT) OVER (PARTITION BY ticker, event_id ORDER BY rn ROWS UNBOUNDED PRECEDING) - 1 AS episode FROM lg),
sg AS (SELECT ep.ticker, ep.event_id, ep.rn AS s, ep.episode, gr.*{w}, CASE WHEN buy_type = 'market' THEN n.open WHEN direction = 'short' THEN c.close * (1 + dr) ELSE c.close * (1 - dr) END AS bp
  FROM ep JOIN bars c ON c.ticker = ep.ticker AND c.rn = ep.rn JOIN bars n ON n.ticker = ep.ticker AND n.rn = ep.rn + 1{join}, gr),
fi AS (SELECT sg.ticker, event_id, cell, s{wk}, min(b.rn) AS f FROM sg JOIN bars b ON b.ticker = sg.ticker AND b.rn > s AND b.rn <= s + CASE WHEN buy_type = 'market' THEN 1 ELSE delay END
  AND (buy_type = 'market' OR CASE WHEN direction = 'short' THEN b.high >= bp ELSE b.low <= bp END) GROUP BY ALL),
fl AS (SELECT sg.*, fi.f, CASE WHEN direction = 'short' THEN bp * (1 - sell) ELSE bp * (1 + sell) END AS sp FROM sg JOIN fi USING (ticker, event_id, cell, s{wk}) JOIN la USING (ticker) WHERE fi.f + h <= last),
hi AS (SELECT fl.ticker, event_id, cell, s{wk}, min(b.rn) AS x FROM fl JOIN bars b ON b.ticker = fl.ticker AND b.rn > f AND b.rn <= f + h AND CASE WHEN direction = 'short' THEN CASE hit_col WHEN 'high' THEN b.high ELSE b.close END <= sp ELSE CASE hit_col WHEN 'high' THEN b.high ELSE b.close END >= sp END GROUP BY ALL),
l AS (SELECT fl.*, x, coalesce(x, f + h) AS e, x IS NOT NULL AS hit, CASE WHEN x IS NULL THEN b.close ELSE sp END AS xp, fb.open_dt AS fdt, xb.open_dt AS xdt,
  (CASE WHEN x IS NULL THEN b.close ELSE sp END - bp) / bp * CASE WHEN direction = 'short' THEN -1 ELSE 1 END - 2 * fee AS net
  FROM fl LEFT JOIN hi USING (ticker, event_id, cell, s{wk}) JOIN bars b ON b.ticker = fl.ticker AND b.rn = f + h JOIN bars fb ON fb.ticker = fl.ticker AND fb.rn = f JOIN bars xb ON xb.ticker = fl.ticker AND xb.rn = coalesce(x, f + h))"""


_LEDGER = "ticker, event_id, s::BIGINT AS signal_rn, f::BIGINT AS fill_rn, (f + h)::BIGINT AS target_rn, e::BIGINT AS exit_rn, episode::BIGINT AS episode_id, fdt AS fill_dt, xdt AS exit_dt, direction, round(bp, 4) AS buy_price, round(sp, 4) AS sell_price, round(xp, 4) AS exit_price, round(net, 6) + 0.0::DOUBLE AS net_pct_gain, hit AS target_hit"


def backtest(spark: SparkSession, sf_dir: str, params: list[bt.Params]) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars, a = fixed_activations(spark, sf_dir)
    ledger, counts = bt.run(bars, a, bt.cells(spark, params))
    return bars, ledger, counts


def _ledger(name: str, p: bt.Params) -> None:
    @query(name, f"WITH {EVENTS_SQL}, {ledger_sql([p])} SELECT {_LEDGER} FROM l")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, ledger, _ = backtest(spark, sf_dir, [p])
        ledger = ledger.drop("cell")
        for c in ("signal_rn", "fill_rn", "target_rn", "exit_rn", "episode_id"):
            ledger = ledger.withColumn(c, F.col(c).cast("long"))
        for c in ("buy_price", "sell_price", "exit_price"):
            ledger = ledger.withColumn(c, F.round(c, 4))
        return rounded(ledger)


_ledger("b1_b4_ledger_long_limit", LONG)
_ledger("b1_b4_ledger_short_limit", SHORT)
_ledger("b1_b4_ledger_market", MARKET)

_PF = "CASE WHEN coalesce(-sum(net) FILTER (net < 0), 0) = 0 THEN CASE WHEN coalesce(sum(net) FILTER (net > 0), 0) > 0 THEN 9999.0::DOUBLE ELSE 0 END ELSE coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) END"
_SUM = f"""ct AS (SELECT ticker, event_id, cell, count(*) AS ts FROM sg GROUP BY 1, 2, 3), sp AS (SELECT ticker, min(year(open_dt) * 12 + month(open_dt)) AS m0, max(year(open_dt) * 12 + month(open_dt)) AS m1 FROM bars GROUP BY 1),
ag AS (SELECT ticker, event_id, cell, count(*) AS n, sum((net > 0)::INT) AS w, sum((net < 0)::INT) AS lo, sum(net) AS tg, avg(net) AS ex, coalesce(stddev_samp(net), 0) AS sd, {_PF} AS pf, max(net) AS be, min(net) AS wo, avg(hit::INT) * 100 AS hr, count(DISTINCT episode) AS ne FROM l GROUP BY 1, 2, 3),
mc AS (SELECT ticker, event_id, cell, year(fdt) * 12 + month(fdt) AS m, count(*) AS k FROM l GROUP BY 1, 2, 3, 4), mm AS (SELECT ticker, event_id, cell, count(*) AS am, sum(k) AS sk, sum(k * k) AS sq FROM mc GROUP BY 1, 2, 3),
su AS (SELECT ct.*, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(lo, 0) AS lo, coalesce(tg, 0) AS tg, ex, coalesce(sd, 0) AS sd, coalesce(pf, 0) AS pf, be, wo, hr, coalesce(ne, 0) AS ne, coalesce(am, 0) AS am, m1 - m0 + 1 AS nm, coalesce(sk, 0) / (m1 - m0 + 1) AS mu, sqrt(greatest(coalesce(sq, 0) / (m1 - m0 + 1) - pow(coalesce(sk, 0) / (m1 - m0 + 1), 2), 0)) AS sg
  FROM ct JOIN sp USING (ticker) LEFT JOIN ag USING (ticker, event_id, cell) LEFT JOIN mm USING (ticker, event_id, cell)),
sc AS (SELECT *, CASE WHEN mu > 0 THEN least(1, 1 / greatest(sg * sg / mu, 1)) ELSE 0 END AS cn FROM su)"""


@query(
    "b5_summary",
    f"""WITH {EVENTS_SQL}, {ledger_sql([LONG])}, {_SUM} SELECT ticker, event_id, ts::BIGINT AS total_signals, n::BIGINT AS total_trades, round(n / ts, 6) AS fill_rate, round(w / nullif(n, 0), 6) AS win_rate, w::BIGINT AS winning_trades, lo::BIGINT AS losing_trades, round(tg, 5) + 0.0::DOUBLE AS total_net_gain,
round(ex, 6) + 0.0::DOUBLE AS expectancy, round(sd, 6) AS std_net_gain, round(pf, 5) AS profit_factor, round(be, 6) AS best_trade, round(wo, 6) AS worst_trade, round(hr, 4) AS target_hit_rate_pct, nm::BIGINT AS n_months, am::BIGINT AS active_months, (nm - am)::BIGINT AS zero_months, round(mu, 6) AS tpm_mu, round(sg, 5) AS tpm_sigma, round(cn, 5) AS c_norm,
round(greatest(pf / (1 + exp(-0.05 * (n - greatest(10, nm * 2.0)))), 0), 5) AS pf_score, round(pf * cn, 5) AS pf_score_tpm, ne::BIGINT AS n_episodes FROM sc""",
)
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, counts = backtest(spark, sf_dir, [LONG])
    s = bt.summarise(ledger, counts, bt.span_months(bars), keys=(*KEYS, "cell"))
    s = s.select(*KEYS, "total_signals", "total_trades", "fill_rate", "win_rate", "winning_trades", "losing_trades", F.round("total_net_gain", 5).alias("total_net_gain"), "expectancy", "std_net_gain", F.round("profit_factor", 5).alias("profit_factor"), "best_trade", "worst_trade", F.round("target_hit_rate_pct", 4).alias("target_hit_rate_pct"), F.col("n_months").cast("long").alias("n_months"), "active_months", F.col("zero_months").cast("long").alias("zero_months"), "tpm_mu", F.round("tpm_sigma", 5).alias("tpm_sigma"), F.round("c_norm", 5).alias("c_norm"), F.round("pf_score", 5).alias("pf_score"), F.round("pf_score_tpm", 5).alias("pf_score_tpm"), "n_episodes")
    return rounded(s)


@query("b6_month_span", f"WITH {EVENTS_SQL} SELECT ticker, min(year(open_dt) * 12 + month(open_dt))::INTEGER AS first_month, max(year(open_dt) * 12 + month(open_dt))::INTEGER AS last_month FROM bars GROUP BY 1")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.span_months(fixed_activations(spark, sf_dir)[0])


@query("b9_grid", f"WITH {EVENTS_SQL}, {ledger_sql(GRID)} SELECT ticker, event_id, cell::BIGINT AS cell, count(*)::BIGINT AS n, round(sum(net), 5) + 0.0::DOUBLE AS gain, round({_PF}, 5) AS profit_factor FROM l GROUP BY 1, 2, 3")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, GRID)
    return rounded(ledger.groupBy(*KEYS, "cell").agg(F.count("*").alias("n"), F.round(F.sum("net_pct_gain"), 5).alias("gain"), F.round(bt.profit_factor(), 5).alias("profit_factor")))


_BEST = "row_number() OVER (PARTITION BY ticker, event_id ORDER BY (coalesce(pf >= 2 AND w / nullif(n, 0) >= 0.55 AND mu >= 2 AND pf * cn >= 0.3 AND n / ts >= 0.4, false)) DESC, round(pf * cn, 9) DESC, cell) AS r"


@query("b10_grid_selection", f"WITH {EVENTS_SQL}, {ledger_sql(GRID)}, {_SUM}, o AS (SELECT *, {_BEST} FROM sc) SELECT ticker, event_id, cell::BIGINT AS cell, round(pf * cn, 5) AS score FROM o WHERE r = 1")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, counts = backtest(spark, sf_dir, GRID)
    s = bt.summarise(ledger, counts, bt.span_months(bars), keys=(*KEYS, "cell")).withColumn("pf_score_tpm", F.round("pf_score_tpm", 9))
    return rounded(bt.select_best(s, *KEYS).select(*KEYS, "cell", F.round("pf_score_tpm", 5).alias("score")))


def windows_sql(grid: list[bt.Params], n_splits: int = 4, min_train: int = 24) -> str:
    """The train and test windows as ``wf`` (window, part, from_dt, to_dt), from ``bars``."""
    purge = max(p.horizon for p in grid) + max(p.delay for p in grid) + 1
    at = lambda m: f"make_timestamp((f + {m}) // 12, (f + {m}) % 12 + 1, 1, 0, 0, 0)"
    return f"""sn AS (SELECT min(year(open_dt) * 12 + month(open_dt) - 1) AS f, max(year(open_dt) * 12 + month(open_dt)) - min(year(open_dt) * 12 + month(open_dt) - 1) AS total FROM bars),
sd AS (SELECT median(epoch_us(open_dt) - epoch_us(p)) AS us FROM (SELECT open_dt, lag(open_dt) OVER (PARTITION BY ticker ORDER BY rn) AS p FROM bars)),
ws AS (SELECT i, f, {min_train} + i * greatest((total - {min_train}) // {n_splits}, 1) AS a, CASE WHEN i = {n_splits - 1} THEN total ELSE least({min_train} + (i + 1) * greatest((total - {min_train}) // {n_splits}, 1), total) END AS b, total FROM sn, range({n_splits}) t(i)),
wf AS (SELECT i::INTEGER AS wn, 'train' AS part, {at(0)} AS from_dt, greatest({at(0)}, {at('a')} - to_microseconds({purge} * us::BIGINT)) AS to_dt FROM ws, sd WHERE a < total AND b > a
  UNION ALL SELECT i::INTEGER, 'test', {at('a')}, {at('b')} FROM ws WHERE a < total AND b > a)"""


@query("b12_walk_forward_splits", f"WITH {EVENTS_SQL}, {windows_sql(GRID)} SELECT wn AS \"window\", part, from_dt, to_dt FROM wf")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _ = fixed_activations(spark, sf_dir)
    return bt.walk_windows(bars, GRID, n_splits=4, min_train=24)


#: Ledgers of all cells over train (even ``win``) and test windows (odd), the best cell of each train window, and its test trades.
_WALK = f"""{EVENTS_SQL}, {windows_sql(GRID)}, {ledger_sql(GRID, "wi AS (SELECT wn * 2 + (part = 'test')::INT AS win, from_dt AS f, to_dt AS t FROM wf)")},
ct AS (SELECT ticker, event_id, cell, win, count(*) AS ts FROM sg WHERE win % 2 = 0 GROUP BY 1, 2, 3, 4),
sp AS (SELECT wn * 2 AS win, year(from_dt) * 12 + month(from_dt) AS m0, year(to_dt - INTERVAL 1 MICROSECOND) * 12 + month(to_dt - INTERVAL 1 MICROSECOND) AS m1 FROM wf WHERE part = 'train'),
ag AS (SELECT ticker, event_id, cell, win, count(*) AS n, sum((net > 0)::INT) AS w, {_PF} AS pf FROM l GROUP BY 1, 2, 3, 4),
mc AS (SELECT ticker, event_id, cell, l.win, year(fdt) * 12 + month(fdt) AS m, count(*) AS k FROM l JOIN sp ON sp.win = l.win AND year(fdt) * 12 + month(fdt) BETWEEN m0 AND m1 GROUP BY 1, 2, 3, 4, 5),
mm AS (SELECT ticker, event_id, cell, win, sum(k) AS sk, sum(k * k) AS sq FROM mc GROUP BY 1, 2, 3, 4),
su AS (SELECT ct.*, coalesce(n, 0) AS n, coalesce(w, 0) AS w, coalesce(pf, 0) AS pf, coalesce(sk, 0) / greatest(1, m1 - m0 + 1) AS mu, coalesce(sq, 0) / greatest(1, m1 - m0 + 1) - pow(coalesce(sk, 0) / greatest(1, m1 - m0 + 1), 2) AS va
  FROM ct JOIN sp USING (win) LEFT JOIN ag USING (ticker, event_id, cell, win) LEFT JOIN mm USING (ticker, event_id, cell, win)),
sc AS (SELECT *, CASE WHEN mu > 0 THEN least(1, 1 / greatest(greatest(va, 0) / mu, 1)) ELSE 0 END AS cn FROM su),
o AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id, win ORDER BY (coalesce(pf >= 2 AND w / nullif(n, 0) >= 0.55 AND mu >= 2 AND pf * cn >= 0.3 AND n / ts >= 0.4, false)) DESC, round(pf * cn, 9) DESC, cell) AS place FROM sc),
be AS (SELECT ticker, event_id, win // 2 AS wn, cell FROM o WHERE place = 1),
te AS (SELECT l.* FROM l JOIN be ON be.ticker = l.ticker AND be.event_id = l.event_id AND be.cell = l.cell AND l.win = be.wn * 2 + 1)"""


@query("b14_walk_forward", f"WITH {_WALK}, b AS (SELECT ticker, event_id, count(*) AS windows FROM be GROUP BY 1, 2), t AS (SELECT ticker, event_id, count(*) AS oos_trades, round({_PF}, 5) AS oos_pf FROM te GROUP BY 1, 2) SELECT ticker, event_id, windows::BIGINT AS windows, oos_trades::BIGINT AS oos_trades, oos_pf FROM b LEFT JOIN t USING (ticker, event_id)")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    best, oos = bt.walk_forward(bars, a, GRID, min_train=24)
    pooled = oos.groupBy(*KEYS).agg(F.count("*").alias("oos_trades"), F.round(bt.profit_factor(), 5).alias("oos_pf"))
    return rounded(best.groupBy(*KEYS).agg(F.count("*").alias("windows")).join(pooled, list(KEYS), "left"))


@query("b13_train_choices", f"WITH {_WALK} SELECT ticker, event_id, wn::INTEGER AS \"window\", cell::BIGINT AS cell FROM be")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    return bt.walk_forward(bars, a, GRID, min_train=24)[0].select(*KEYS, "window", "cell")


@query("b28_consensus_parameters", f"WITH {_WALK}, v AS (SELECT ticker, event_id, cell, count(*) AS votes, max(wn) AS latest FROM be GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY votes DESC, latest DESC) AS place FROM v), lc AS (SELECT ticker, event_id, arg_max(cell, wn) AS last_cell FROM be GROUP BY 1, 2) SELECT ticker, event_id, cell::BIGINT AS consensus_cell, last_cell::BIGINT AS last_cell FROM r JOIN lc USING (ticker, event_id) WHERE place = 1")
def b28(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, a = fixed_activations(spark, sf_dir)
    best = bt.walk_forward(bars, a, GRID, min_train=24)[0]
    both = bt.pick_cell(best, *KEYS, policy="consensus").withColumnRenamed("cell", "consensus_cell").join(bt.pick_cell(best, *KEYS).withColumnRenamed("cell", "last_cell"), list(KEYS))
    return both.select(*KEYS, "consensus_cell", "last_cell")


@query("b16_execution_envelope", f"WITH {EVENTS_SQL}, {ledger_sql([LONG, bt.replace(LONG, hit_col='high')])} SELECT ticker, event_id, hit_col, count(*)::BIGINT AS n, sum(hit::INT)::BIGINT AS hits, round(avg(net), 6) + 0.0::DOUBLE AS expectancy FROM l GROUP BY 1, 2, 3")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG, bt.replace(LONG, hit_col="high")])
    col = F.when(F.col("cell") == 0, "close").otherwise("high").alias("hit_col")
    return rounded(ledger.groupBy(*KEYS, col).agg(F.count("*").alias("n"), F.sum(F.col("target_hit").cast("long")).alias("hits"), F.avg("net_pct_gain").alias("expectancy")))


@query("b17_excursions", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])} SELECT l.ticker, event_id, s::BIGINT AS signal_rn, round(least(min(b.low) / any_value(bp) - 1, 0), 6) + 0.0::DOUBLE AS mae, round(greatest(max(b.high) / any_value(bp) - 1, 0), 6) + 0.0::DOUBLE AS mfe FROM l JOIN bars b ON b.ticker = l.ticker AND b.rn > f AND b.rn <= e GROUP BY 1, 2, 3")
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, _ = backtest(spark, sf_dir, [LONG])
    return rounded(bt.excursions(bars, ledger, *KEYS).drop("net_pct_gain").withColumn("signal_rn", F.col("signal_rn").cast("long")))


@query("b18_validation", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])} SELECT ticker, event_id, count(*)::BIGINT AS n, round(avg(net) / (CASE WHEN stddev_samp(net) > 1e-9 THEN stddev_samp(net) END / sqrt(count(*))), 5) + 0.0::DOUBLE AS t, round(avg(net) / CASE WHEN stddev_samp(net) > 1e-9 THEN stddev_samp(net) END, 6) + 0.0::DOUBLE AS sharpe FROM l GROUP BY 1, 2")
def b18(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    g = ledger.groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("net_pct_gain").alias("m"), F.stddev_samp("net_pct_gain").alias("s"))
    sd = F.when(F.col("s") > 1e-9, F.col("s"))  # equal gains have no spread to measure
    return rounded(g.select(*KEYS, "n", F.round(F.col("m") / (sd / F.sqrt("n")), 5).alias("t"), (F.col("m") / sd).alias("sharpe")))


@query("b19_deflated_sharpe", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, g AS (SELECT ticker, event_id, count(*) AS n, avg(net) / CASE WHEN stddev_samp(net) > 1e-9 THEN stddev_samp(net) END AS sr FROM l GROUP BY 1, 2) SELECT ticker, event_id, round(CASE WHEN n > 1 AND 1 - {st.EULER!r} * ln(8) / ln(n) > 0 THEN sr * sqrt(1 - {st.EULER!r} * ln(8) / ln(n)) END, 6) + 0.0::DOUBLE AS dsr FROM g")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    g = ledger.groupBy(*KEYS).agg(F.count("*").alias("n"), (F.avg("net_pct_gain") / F.when(F.stddev_samp("net_pct_gain") > 1e-9, F.stddev_samp("net_pct_gain"))).alias("sr"))
    inner = 1 - st.EULER * F.log(F.lit(8.0)) / F.nullif(F.log("n"), F.lit(0.0))
    return rounded(g.select(*KEYS, F.when((F.col("n") > 1) & (inner > 0), F.col("sr") * F.sqrt(inner)).alias("dsr")))


@query("b20_stability", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_id ORDER BY f, s) * 2 > count(*) OVER (PARTITION BY ticker, event_id) AS late FROM l), h AS (SELECT ticker, event_id, late, {_PF} AS pf FROM o GROUP BY 1, 2, 3), g AS (SELECT ticker, event_id, max(CASE WHEN NOT late THEN pf END) AS a, max(CASE WHEN late THEN pf END) AS b FROM h GROUP BY 1, 2) SELECT ticker, event_id, round(a, 5) AS pf_early, round(b, 5) AS pf_late, CASE (coalesce(a, 0) < 1)::INT + (coalesce(b, 0) < 1)::INT WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' ELSE 'FAIL' END AS stability FROM g")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    return rounded(bt.stability(ledger, *KEYS), 5)


@query(
    "b21_regime_breakdown",
    f"""WITH {EVENTS_SQL}, {ledger_sql([LONG])}, rg AS (SELECT ticker, open_dt, CASE WHEN close > close_sma_20 THEN 'UP' WHEN close <= close_sma_20 THEN 'DOWN' END AS regime FROM k),
j AS (SELECT l.*, coalesce(rg.regime, 'UNDEFINED') AS regime FROM l LEFT JOIN rg ON rg.ticker = l.ticker AND rg.open_dt = l.fdt), g AS (SELECT ticker, event_id, regime, count(*) AS n, avg((net > 0)::INT) AS wr, {_PF} AS pf, sum(net) AS cg FROM j GROUP BY 1, 2, 3)
SELECT ticker, event_id, regime, n::BIGINT AS n_trades, round(wr, 6) AS win_rate, round(pf, 5) AS profit_factor, round(cg, 5) + 0.0::DOUBLE AS cum_gain, n >= 5 AND pf < 1 AS avoid FROM g""",
)
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, _ = backtest(spark, sf_dir, [LONG])
    rg = bars.withColumn("regime", F.when(F.col("close") > F.col("close_sma_20"), "UP").when(F.col("close") <= F.col("close_sma_20"), "DOWN"))
    r = bt.regime_breakdown(ledger, rg, *KEYS).drop("expectancy")
    return rounded(r.withColumn("profit_factor", F.round("profit_factor", 5)).withColumn("cum_gain", F.round("cum_gain", 5)))


_DEP = "m AS (SELECT ticker, event_id, year(fdt) * 12 + month(fdt) AS m, count(*) AS n FROM l GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY ticker, event_id) AS p FROM m), g AS (SELECT ticker, event_id, count(*) AS k, -sum(p * ln(p + 1e-12)) AS h FROM p GROUP BY 1, 2)"


@query("b22_dependency_score", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, {_DEP} SELECT ticker, event_id, k::BIGINT AS months, round(CASE WHEN k <= 1 THEN 1 ELSE 1 - h / ln(k) END, 6) + 0.0::DOUBLE AS dependency FROM g")
def b22(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ledger, _ = backtest(spark, sf_dir, [LONG])
    return rounded(bt.dependency(ledger, *KEYS))


@query("b23_zero_months", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, s AS (SELECT ticker, max(year(open_dt) * 12 + month(open_dt)) - min(year(open_dt) * 12 + month(open_dt)) + 1 AS nm FROM bars GROUP BY 1) SELECT l.ticker, event_id, greatest(any_value(nm) - count(DISTINCT year(fdt) * 12 + month(fdt)), 0)::BIGINT AS zero_months FROM l JOIN s USING (ticker) GROUP BY 1, 2")
def b23(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, _ = backtest(spark, sf_dir, [LONG])
    return gt.zero_months(ledger.select("ticker", "event_id", F.col("fill_dt").alias("open_dt")), bars).withColumn("zero_months", F.col("zero_months").cast("long"))


@query("b24_early_elimination", f"WITH {EVENTS_SQL}, {ledger_sql([LONG])}, {_SUM} SELECT ticker, event_id, n < greatest(10, floor(nm * 2.0)) AS few, pf < 1 AS losing, coalesce(n / ts < 0.4, false) AS unfilled FROM sc")
def b24(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, counts = backtest(spark, sf_dir, [LONG])
    s = bt.early_elimination(bt.summarise(ledger, counts, bt.span_months(bars), keys=(*KEYS, "cell")))
    has = lambda r: F.array_contains("reasons", r)
    return s.select(*KEYS, has("trades").alias("few"), has("profit factor").alias("losing"), has("fill rate").alias("unfilled"))


@query("b25_verdict")
def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, ledger, counts = backtest(spark, sf_dir, [LONG])
    s = bt.summarise(ledger, counts, bt.span_months(bars), keys=(*KEYS, "cell"))
    g = ledger.groupBy(*KEYS).agg(F.count("*").alias("k"), F.avg("net_pct_gain").alias("m"), F.stddev_samp("net_pct_gain").alias("sd")).withColumn("t", F.col("m") / F.nullif(F.col("sd") / F.sqrt("k"), F.lit(0.0))).withColumn("df", F.col("k") - 1)
    p = st.with_p_greater(g, "t", "df", "p").select(*KEYS, "p", (F.col("m") / F.nullif(F.col("sd"), F.lit(0.0))).alias("dsr"))
    s = s.join(p, list(KEYS), "left").join(bt.stability(ledger, *KEYS).select(*KEYS, "stability"), list(KEYS), "left").join(bt.dependency(ledger, *KEYS).select(*KEYS, "dependency"), list(KEYS), "left").withColumn("oos_pf", F.lit(None).cast("double"))
    return bt.decide(s).select(*KEYS, "verdict", "reasons")
