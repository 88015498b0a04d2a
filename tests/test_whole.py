"""Queries that read every bar, ticker, event and cell, against loops over the whole tables."""

import os

import numpy as np
import pytest

from ruleloom.plans import catalog
from ruleloom.plans.q_events import fixed_activations

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def tables(spark):
    bars, a = fixed_activations(spark, SF)
    return bars.select("ticker", "rn", "close").toPandas(), a.select("ticker", "event_id", "rn").toPandas()


def shifted(bars, a):
    """Means of the returns under every circular shift of every event, by a loop: ``{(ticker, event_id, h): (excess, count)}``."""
    out = {}
    for t, b in bars.sort_values("rn").groupby("ticker"):
        close = b["close"].to_numpy(float)
        for h in (1, 5):
            r = np.full(len(close), np.nan)
            r[:-h] = np.log(close[h:] / close[:-h])
            for e, on in a[a.ticker == t].groupby("event_id"):
                at = np.sort(on["rn"].to_numpy(int))
                got = [r[(at + k) % len(r)] for k in range(len(r))]
                n = np.array([np.isfinite(g).sum() for g in got])
                with np.errstate(invalid="ignore"):
                    out[t, e, h] = np.array([np.nansum(g) for g in got]) / np.where(n, n, np.nan) - np.nanmean(r), n
    return out


def test_rotations_try_every_shift_of_whole_series(spark, tables):
    bars, a = tables
    bars_of = bars.groupby("ticker").size().to_dict()
    loop = shifted(bars, a)
    q = catalog.queries()
    rows = {(r.ticker, r.event_id, r.h): r for r in q["m7_rotation_null"](spark, SF).collect()}
    assert set(rows) == set(loop)
    zs, ps = {}, {}
    for k, (d, n) in loop.items():
        null = d[1:][np.isfinite(d[1:])]
        zs[k], ps[k] = d[0] / null.std(), (1 + (abs(null) >= abs(d[0]) - 1e-15).sum()) / (1 + len(null))
        assert rows[k].n == n[0] and abs(rows[k].delta - d[0]) < 2e-6 and abs(rows[k].z - zs[k]) < 2e-5 and abs(rows[k].p - ps[k]) < 2e-6
    chosen = {(r.ticker, r.event_id): r for r in q["m8_horizon_choice"](spark, SF).collect()}
    assert len(chosen) == len({k[:2] for k in loop})
    for (t, e), r in chosen.items():
        assert abs(r.z - zs[t, e, r.h]) < 2e-5 and abs(r.p - ps[t, e, r.h]) < 2e-6
    assert {(r.ticker, r.event_id, r.h): r.p for r in q["m21_benjamini_hochberg"](spark, SF).collect()} == {k: r.p for k, r in rows.items()}
    assert {r.ticker: r.offsets for r in q["n1_search_null"](spark, SF).collect()} == {t: n - 1 for t, n in bars_of.items()}


def test_reports_cover_every_ticker_event_and_cell(spark, tables):
    from ruleloom.plans.q_backtest import GRID, LONG, backtest
    from ruleloom.operators import backtest as bt

    q = catalog.queries()
    _, ledger, _ = backtest(spark, SF, [LONG])
    days = {}
    for r in ledger.select("ticker", "event_id", "fill_dt").distinct().collect():
        days.setdefault(f"{r.ticker}/{r.event_id}", set()).add(r.fill_dt)
    assert len({k.split("/")[0] for k in days}) == 5
    want = {(x, y): round(len(days[x] & days[y]) / len(days[x] | days[y]), 6) for x in days for y in days if x < y}
    got = {(r.rule_a, r.rule_b): r.jaccard for r in q["j1_jaccard_by_date"](spark, SF).collect()}
    assert set(got) == {k for k, v in want.items() if v} and all(abs(got[k] - want[k]) < 2e-6 for k in got)
    assert {(r.rule_a, r.rule_b) for r in q["j2_gain_correlation"](spark, SF).collect()} == set(want)
    assert {r.rule_id for r in q["j3_correlation_maxima"](spark, SF).collect()} == {x for k in got for x in k}
    duplicates = {r.rule_id: r.duplicate_of for r in q["j4_duplicates"](spark, SF).collect()}
    assert set(duplicates) == set(days)
    assert {m: r.dominant for r in q["p8_duplicate_clusters"](spark, SF).collect() for m in r.members} == {k: v for k, v in duplicates.items() if v}
    assert q["r7_regime_lookup"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    bars, a = fixed_activations(spark, SF)
    active = tables[1]
    on = {k: set(x["rn"]) for k, x in active.groupby(["ticker", "event_id"])}
    kept = {}
    for t, e in sorted(on, key=lambda k: (-len(on[k]), k)):
        if all(len(on[t, e] & on[t, o]) / len(on[t, e] | on[t, o]) < 0.3 for o in kept.get(t, [])):
            kept.setdefault(t, []).append(e)
    assert {(r.ticker, r.i, r.event_id) for r in q["g13_diversity_gate"](spark, SF).collect()} == {(t, i, e) for t, x in kept.items() for i, e in enumerate(x)}
    best, _ = bt.walk_forward(bars, a, GRID, min_train=24)
    windows = {(r.ticker, r.event_id): r.windows for r in q["b14_walk_forward"](spark, SF).collect()}
    assert windows == {(r.ticker, r.event_id): r["count"] for r in best.groupBy("ticker", "event_id").count().collect()}
    assert {e for _, e in windows} == set(active["event_id"])
