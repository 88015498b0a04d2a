"""Discovery on the selection span, entries, derived targets, presets and registries on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.operators import alpha, backtest, events, features, registry
from ruleloom.plans import session, settings

GRID = [backtest.Params(buy_type="market", sell=s, horizon=h, fee=0.0005) for s in (0.02, 0.05) for h in (1, 3)]
LOW = events.Event("LOW", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.1),))


def test_the_last_test_window_moves_no_selection_figure(spark, walk):
    """Prices of the last test window are turned upside down; only figures named oos, and verdicts that read them, may move."""
    signals = events.activations(walk, [LOW])
    windows = backtest.walk_windows(walk, GRID, n_splits=3, min_train=8).where("part = 'test'")
    start = windows.agg(F.max("from_dt")).first()[0]
    turned = walk.select("ticker", "rn", "open_dt", "volume", "feat", *(F.when(F.col("open_dt") >= F.lit(start), 200 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")))
    figures = ("cell", "total_trades", "profit_factor", "expectancy", "p", "sharpe", "dsr", "mde", "stability", "dependency", "win_rate", "tpm_mu")
    out = []
    for bars in (walk, turned):
        v, trades, oos = backtest.discover(bars, signals, GRID, n_splits=3, min_train=8)
        assert trades.where(F.col("exit_dt") >= F.lit(start)).count() == 0
        out.append({r.ticker: r for r in v.collect()})
        assert oos.where(F.col("fill_dt") >= F.lit(start)).count() > 0
    for t in ("AAA", "BBB"):
        assert [out[0][t][c] for c in figures] == [out[1][t][c] for c in figures]
        assert out[0][t].oos_pf != out[1][t].oos_pf


def test_validation_counts_overlapping_trades_once(spark):
    rows = [("A", "e", i, i + 1, i + 4, g) for i, g in enumerate([0.02, 0.01, -0.01, 0.03, 0.02, 0.01])]
    ledger = spark.createDataFrame(rows, "ticker string, event_id string, signal_rn long, fill_rn long, exit_rn long, net_pct_gain double")
    r = backtest.validation(ledger, 8, 365.25, "ticker", "event_id").first()
    g = np.array([x[-1] for x in rows])
    open_bars = sum(x[4] - x[3] + 1 for x in rows)
    occupied = len({b for x in rows for b in range(x[3], x[4] + 1)})
    eff = len(rows) / (open_bars / occupied)
    assert r.n_effective == pytest.approx(eff) and r.t == pytest.approx(g.mean() / (g.std(ddof=1) / math.sqrt(eff)))
    sharpe = g.mean() / g.std(ddof=1) * math.sqrt(365.25 / 3)
    assert r.sharpe == pytest.approx(sharpe) and math.floor(eff) == 2 and r.dsr == r.sharpe  # too few to deflate
    apart = ledger.withColumn("fill_rn", F.col("fill_rn") * 10).withColumn("exit_rn", F.col("fill_rn") + 3)
    r = backtest.validation(apart, 8, 365.25, "ticker", "event_id").first()
    assert r.n_effective == 6 and r.dsr == pytest.approx(r.sharpe * math.sqrt(1 - 0.5772156649 * math.log(8) / math.log(6)))
    assert backtest.validation(apart, 100, 365.25, "ticker", "event_id").first().dsr is None  # more trials than the trades can bear


def test_a_grid_is_seeded_from_each_contract(spark):
    contracts = spark.createDataFrame([("A", "x", "short", 4, 0.08), ("B", "y", "undetermined", None, None)], "ticker string, event_id string, direction string, h int, take_profit double")
    rows = backtest.seeded(contracts, backtest.Params(buy_type="market", sell=0.04, horizon=24)).collect()
    a = [r for r in rows if r.ticker == "A"]
    assert len(a) == 9 and {r.direction for r in a} == {"short"} and {r.horizon for r in a} == {2, 4, 6} and {r.sell for r in a} == {0.06, 0.08, 0.1}
    b = [r for r in rows if r.ticker == "B"]
    assert {r.direction for r in b} == {"long"} and {r.horizon for r in b} == {12, 24, 36}


def test_limit_entries_need_fills_sharpe_and_gain(spark):
    point = lambda rows: spark.createDataFrame(rows, "event_id string, fill_rate double, sharpe double, total_net_gain double")
    market = point([("a", 1.0, 1.0, 2.0), ("b", 1.0, 1.0, 2.0), ("c", 1.0, 1.0, 2.0), ("d", 1.0, 1.0, 2.0), ("e", 1.0, -1.0, -2.0), ("f", 1.0, 1.0, 2.0)])
    limit = point([("a", 0.9, 1.5, 1.0), ("b", 0.7, 1.5, 1.0), ("c", 0.9, 0.5, 1.0), ("d", 0.9, 1.5, 0.9), ("e", 0.9, 0.0, -2.5)])
    got = {r.event_id: (r.adopted, r.failed) for r in backtest.adopt_limit(market, limit, "event_id").collect()}
    assert got == {"a": (True, None), "b": (False, "fill"), "c": (False, "sharpe"), "d": (False, "net_gain"), "e": (False, "net_gain"), "f": (False, "fill")}


def test_presets_have_their_numbers():
    g = settings.preset("balanced").gate
    assert (g.min_tpm, g.margin, g.min_episodes, g.max_dispersion) == (1.0, 1.30, 10, 2.0)
    assert settings.preset("balanced", counting="bar").gate.min_tpm == 3.0
    assert settings.preset("sniper", "4h").gate.min_tpm == pytest.approx(0.3 * 6)
    c = settings.preset("sweep", fdr_q=0.2)
    assert (c.gate.min_episodes, c.gate.margin, c.fdr_q, c.criteria["pf"]) == (5, 1.60, 0.2, 1.8)
    with pytest.raises(ValueError):
        settings.preset("bold")
    with pytest.raises(ValueError):
        settings.preset("sniper", speed=3)


def test_enriched_horizons_are_a_union_within_reach():
    assert alpha.enriched_horizons({"a": 20, "b": 0, "c": 5}, (1, 3, 5, 10), 600) == {"a": [20], "c": [2]}
    assert alpha.enriched_horizons({"a": 20}, (1, 3, 5, 10), 2000) == {"a": [20, 40]}


def test_seeds_and_confirmation(spark, walk):
    config = settings.SessionConfig(gate=settings.GateParams(min_tpm=0.5, min_episodes=5), horizons=(1, 2, 3), min_train_months=6)
    twin = events.Event("TWIN", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.101),))
    r = session.run_session(walk, config, manual=[LOW, twin], params=GRID[:2])
    seeds = session.select_seeds(r)
    assert [e.event_id for e in seeds] in (["LOW"], ["TWIN"])  # one of a family
    start = walk.agg(F.percentile_approx(F.col("open_dt").cast("timestamp"), 0.8)).first()[0]
    c = session.confirm(walk, seeds, GRID[:2], start, n_splits=4, min_train=6).collect()
    assert {x.ticker for x in c} == {"AAA", "BBB"} and any(x.confirmed for x in c)
    built = registry.build_registry(r.verdicts, r.ledger, registry.cross_ticker(r.verdicts, r.verdicts.where("ticker = 'AAA'")), duplicate_from=0.7)
    assert {x.grade for x in built["rules"].collect()} <= {"A", "B+", "B"} and built["overlap"].count() >= 1


def test_tickers_of_different_length_have_splits_of_their_own(spark, walk):
    short = walk.where("ticker = 'AAA' or rn < 200")
    config = settings.SessionConfig(gate=settings.GateParams(min_tpm=0.5, min_episodes=3), horizons=(1, 2), min_train_months=3)
    r = session.run_session(short, config, manual=[LOW], params=GRID[:1])
    last = {x.ticker: x.m for x in r.active.groupBy("ticker").agg(F.max("rn").alias("m")).collect()}
    assert last["AAA"] < 420 and last["BBB"] < 140
