"""Recipes rebuild exactly what an event needs."""

from ruleloom.operators import events, features
from ruleloom.operators.indicators import build_features, lag_features
from ruleloom.operators.recipe import Recipe, minimal_recipe, rebuild, refresh, verify


def event():
    F, C = features.Feature, events.Component
    return events.Event("E", (C(F("r", "ratio", ("close_sma_05", "close_ema_09")), direction="above", threshold=1.0), C(F("g", "identity", ("body",)), threshold=0.5), C(F("p", "identity", ("close_sma_05_prev_02",)), direction="above", threshold=90.0)))


def test_recipe_is_minimal_and_verifies(spark, walk):
    r = minimal_recipe(event())
    assert set(r.config) == {"sma", "ema"} and r.geometry and r.lags == [("close_sma_05", 2)] and r.complete
    assert Recipe.from_dict(r.to_dict()) == r
    full = lag_features(rebuild(build_features(walk), Recipe(geometry=True)).join(build_features(walk, {"sma": {"columns": ["close"], "periods": [5]}}).select("ticker", "rn", "close_sma_05"), ["ticker", "rn"]), "close_sma_05", periods=(2,))
    expected = full.select("ticker", "rn", event().column().alias("active"))
    row = verify(event(), r, walk.drop("feat"), expected).first()
    assert row.bars == 1200 and row.differences == 0


def test_unknown_columns_are_named():
    e = events.Event("E", (events.Component(features.Feature("x", "identity", ("mystery",)), threshold=1.0),))
    assert minimal_recipe(e).unknown == ["mystery"]


def test_refresh_gates_on_new_bars(spark, walk):
    e = events.Event("E", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.1),))
    rows = refresh(e, walk).collect()
    assert {r.ticker for r in rows} == {"AAA", "BBB"} and all(r.n_activations > 30 for r in rows)
