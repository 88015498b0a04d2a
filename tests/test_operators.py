"""Operators against plain pandas and numpy, and their invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ruleloom.functions import stats
from ruleloom.operators import alpha, backtest, events, features, gate, indicators, quality, regime, registry
from ruleloom.plans.settings import UNSET, SessionConfig, TimeBudget, preset, resolve, topological


def one(df, ticker="AAA"):
    return df.where(F.col("ticker") == ticker).orderBy("rn").toPandas()


def test_recursive_indicators_do_not_depend_on_chunks(spark, walk):
    wanted = [("ema", "close", (9,)), ("rsi", "close", (5,)), ("adx", "close", (5,))]
    whole, cut = (one(indicators.recursive_features(walk, wanted, chunk_rows=n)) for n in (100_000, 150))
    pd.testing.assert_frame_equal(whole, cut)
    p = one(walk)
    np.testing.assert_allclose(whole["close_ema_09"], p["close"].ewm(span=9, adjust=False).mean().round(5))


def test_build_features_skips_what_it_cannot_build(spark, walk):
    with pytest.warns(UserWarning):
        out = indicators.build_features(walk, {"sma": {"columns": ["close", "gone"], "periods": [3]}, "what": {"columns": ["close"], "periods": [1]}})
    assert "close_sma_03" in out.columns and "gone_sma_03" not in out.columns
    with pytest.raises(ValueError):
        indicators.build_features(walk, {"macd": {"columns": ["close"], "periods": [12, 26]}})
    with pytest.raises(KeyError):
        indicators.lag_features(walk, "gone")
    with pytest.raises(ValueError):
        indicators.lag_features(walk, like="nothing")


def test_hurst_of_noise_is_about_a_half():
    assert abs(regime.dfa_hurst(np.random.default_rng(1).normal(size=8000)) - 0.5) < 0.08
    assert regime.dfa_hurst(np.zeros(5)) is None


def test_episodes_bridge_gaps(spark):
    rows = [("A", "E", r, "2020-01-01") for r in (0, 1, 3, 7, 8, 12)]
    active = spark.createDataFrame(rows, "ticker string, event_id string, rn long, open_dt string")
    for gap, want in ((0, [0, 0, 1, 2, 2, 3]), (1, [0, 0, 0, 1, 1, 2]), (3, [0, 0, 0, 0, 0, 0])):
        assert [r.episode for r in gate.with_episodes(active, gap).orderBy("rn").collect()] == want


def test_ranged_rate_needs_episodes():
    with pytest.raises(ValueError):
        gate.GateParams(mode="ranged", counting="bar")


def test_event_survives_json_and_keeps_its_signal(spark, walk):
    f = features.Feature("ratio_close_open_lag1", "ratio", ("close", "open"), lag=1)
    e = events.Event("E", (events.Component(f, features.Transform("zscore", 48), direction="above", threshold=1.0), events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.5)))
    again = events.Event.from_json(e.to_json())
    a, b = (one(walk.select("ticker", "rn", x.column().alias("on"))) for x in (e, again))
    pd.testing.assert_frame_equal(a, b)
    assert not a["on"].isna().any()  # an AND of several has no nulls


def test_feature_plan_is_unique_and_freezes_spreads(spark, walk):
    df = indicators.build_features(walk, {"sma": {"columns": ["close"], "periods": [5, 20]}, "bollinger": {"columns": ["close"], "periods": [20]}})
    plan = features.freeze(df, features.plan_features(features.classify(df), df.columns))
    names = [f.name for f in plan]
    assert len(names) == len(set(names))
    assert {"ratio_close_sma05_sma20", "diffnorm_close_sma05_sma20", "spread_close_sma05", "bb_pct_b_close_20"} <= set(names)
    assert all(f.std is not None for f in plan if f.operation == "diffnorm")


def test_rotation_null_sees_a_planted_advantage_and_not_its_absence(spark, walk):
    low = events.Event("LOW", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.1),))
    rnd = events.formula_event("RND", "pmod(rn * 7919, 10) = 0")
    active = events.activations(walk, [low, rnd])
    out = {(r.ticker, r.event_id): r for r in alpha.rotation_null(active, alpha.forward(walk, (1,))).collect()}
    assert out["AAA", "LOW"].z > 4 and out["AAA", "LOW"].p < 0.01
    assert abs(out["AAA", "RND"].z) < 3


def test_rotations_equal_a_loop():
    rng = np.random.default_rng(3)
    mask, x = rng.random(40) < 0.2, rng.normal(size=40)
    valid = rng.random(40) < 0.9
    mu, count = alpha.Series(1, np.where(valid, x, np.nan)).under(np.conj(np.fft.rfft(mask.astype(float))))
    for k in range(40):
        hit = np.roll(mask, k) & valid
        assert count[k] == hit.sum()
        if hit.any():
            assert abs(mu[k] - x[hit].mean()) < 1e-12


def loop_backtest(p, on, q):
    """Trades by plain loops."""
    out, n = [], len(p)
    short = q.direction == "short"
    for s in np.flatnonzero(on):
        if s + 1 >= n:
            continue
        if q.buy_type == "market":
            price, fill = p["open"][s + 1], s + 1
        else:
            price = p["close"][s] * (1 + q.drop if short else 1 - q.drop)
            fill = next((i for i in range(s + 1, min(s + q.delay, n - 1) + 1) if (p["high"][i] >= price if short else p["low"][i] <= price)), None)
        if fill is None or fill + q.horizon >= n:
            continue
        goal = price * (1 - q.sell if short else 1 + q.sell)
        hit = next((i for i in range(fill + 1, fill + q.horizon + 1) if (p["close"][i] <= goal if short else p["close"][i] >= goal)), None)
        end = goal if hit is not None else p["close"][fill + q.horizon]
        out.append((s, fill, hit if hit is not None else fill + q.horizon, (end - price) / price * (-1 if short else 1) - 2 * q.fee))
    return out


@pytest.mark.parametrize("q", [backtest.Params(drop=0.005, delay=3, sell=0.02, horizon=8), backtest.Params(direction="short", drop=0.004, delay=2, sell=0.01, horizon=5), backtest.Params(buy_type="market", sell=0.015, horizon=6)])
def test_backtest_equals_a_loop(spark, walk, q):
    e = events.Event("E", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.2),))
    ledger, counts = backtest.run(walk, events.activations(walk, [e]), backtest.cells(spark, [q]))
    got = ledger.where("ticker = 'AAA'").orderBy("signal_rn").collect()
    p = one(walk)
    want = loop_backtest(p, (p["feat"] < 0.2).to_numpy(), q)
    assert [(r.signal_rn, r.fill_rn, r.exit_rn) for r in got] == [w[:3] for w in want]
    np.testing.assert_allclose([r.net_pct_gain for r in got], [w[3] for w in want], atol=1e-12)


def test_splits_cover_the_rest():
    assert backtest.month_splits(0, 24, n_splits=4, min_train=6) == [(0, 6, 6, 10), (0, 10, 10, 14), (0, 14, 14, 18), (0, 18, 18, 24)]
    assert backtest.month_splits(0, 5, min_train=6) == []


def test_statistics():
    assert abs(stats.t_two_sided(2.228, 10) - 0.05) < 1e-3
    assert abs(stats.t_quantile(0.975, 10) - 2.228) < 1e-3
    assert stats.t_two_sided(None, 3) is None
    assert stats.deflated_sharpe(1.0, 10**9, 3) is None
    assert alpha.trapezoid([1, 3, 5, 10]) == [1.0, 2.0, 3.5, 2.5]


def test_benjamini_hochberg_keeps_up_to_the_last_rank(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.04, 0.03, None, 0.9])], "i int, p double")
    assert [r.significant for r in stats.benjamini_hochberg(df, "p", 0.06).orderBy("i").collect()] == [True, True, True, False, False]


def test_quality_finds_planted_faults(spark, walk):
    bad = walk.withColumn("high", F.when(F.col("rn") == 5, F.col("low") * 0.9).otherwise(F.col("high"))).withColumn("close", F.when(F.col("rn") == 9, F.col("close") * 10000).otherwise(F.col("close")))
    rep = quality.quality_report(bad)
    assert rep.worst == "FAIL" and {"high_below_low", "high_not_max"} <= {f.code for f in rep.findings}
    assert quality.quality_report(walk).worst in ("OK", "WARN")
    assert "data quality" in rep.to_text()


def test_recalibration_moves_a_threshold_to_the_same_share(spark, walk):
    e = events.Event("E", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.3),))
    target = walk.withColumn("feat", F.col("feat") * 100)
    t = registry.recalibrate(e, walk, target).components[0].threshold
    assert abs(t - 30) < 0.5


def test_settings():
    done = resolve(SessionConfig(timeframe="1h", n_bars=24 * 365 * 3), strict=False)
    assert done.config.delay == 6 and done.config.target_h == 24 and all(getattr(done.config, k) is not UNSET for k, *_ in [(n,) for n in ("horizons", "rule_fee", "tp_floor")])
    with pytest.raises(ValueError):
        resolve(SessionConfig(timeframe="1d", n_bars=25), strict=True)
    with pytest.raises(ValueError):
        topological([("a", ("b",), None, ""), ("b", ("a",), None, "")])
    b = TimeBudget(100, 0.7, purge=5, embargo=3)
    assert (b.split, b.oos_start, b.purge_slice(2), b.purge_slice(9)) == (70, 73, (68, 70), (65, 70))
    assert preset("burst", "4h").gate.min_tpm > preset("burst").gate.min_tpm


def test_picks_over_windows_and_entries(spark):
    best = spark.createDataFrame([("E", 0, 2), ("E", 1, 2), ("E", 2, 5), ("E", 3, 5), ("F", 0, 1), ("F", 1, 1), ("F", 2, 3)], "event_id string, window int, cell int")
    cell = lambda policy: {r.event_id: r.cell for r in backtest.pick_cell(best, "event_id", policy=policy).collect()}
    assert cell("last") == {"E": 5, "F": 3} and cell("consensus") == {"E": 5, "F": 1}
    m = spark.createDataFrame([("E", 1.0, 0.5, 0.2), ("F", 1.0, 0.5, 0.2), ("G", 1.0, 0.5, 0.2)], "event_id string, fill_rate double, sharpe double, total_net_gain double")
    lim = spark.createDataFrame([("E", 0.9, 0.6, 0.3), ("F", 0.7, 0.9, 0.9)], "event_id string, fill_rate double, sharpe double, total_net_gain double")
    assert {r.event_id: r.adopted for r in backtest.adopt_limit(m, lim, "event_id").collect()} == {"E": True, "F": False, "G": False}
