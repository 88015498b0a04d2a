"""Recipes: the least indicator configuration that a published event needs, rebuilt on fresh candles and verified.

Column names carry their lineage, so a recipe is read from them; lagged copies
(``_prev_``) are followed to their source.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.windows import with_rn
from ruleloom.operators.events import Event
from ruleloom.operators.features import parse_name
from ruleloom.operators.gate import GateParams, gate
from ruleloom.operators.indicators import build_features, candle_geometry, lag_features, pattern_column

RAW = ("open", "high", "low", "close", "volume")
GEOMETRY = ("body", "upper_wick", "lower_wick", "close_pos", "range_pct", "gap")
#: The configuration entry that makes an indicator.
MAKES = {"bb_mid": "bollinger", "bb_lower": "bollinger", "bb_upper": "bollinger", "bb_width": "bollinger", "natr": "atr", "sk": "stochastic", "sd": "stochastic", "aroon_up": "aroon", "aroon_down": "aroon"}


@dataclass
class Recipe:
    config: dict[str, dict] = field(default_factory=dict)
    lags: list[tuple[str, int]] = field(default_factory=list)
    geometry: bool = False
    patterns: bool = False
    raw: list[str] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return not self.unknown

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, doc: dict) -> Recipe:
        return cls(**doc | {"lags": [tuple(x) for x in doc["lags"]]})


def _add(recipe: Recipe, column: str) -> None:
    if m := re.fullmatch(r"(.+)_prev_(\d+)", column):
        if (m[1], int(m[2])) not in recipe.lags:
            _add(recipe, m[1])
            recipe.lags.append((m[1], int(m[2])))
        return
    if column in RAW:
        if column not in recipe.raw:
            recipe.raw.append(column)
        return
    if column in GEOMETRY:
        recipe.geometry = True
        return
    if column == "pattern":
        recipe.patterns = True
        return
    p = parse_name(column)
    if p is None:
        if column not in recipe.unknown:
            recipe.unknown.append(column)
        return
    kind = "macd" if p.family.startswith("macd") else MAKES.get(p.indicator, p.indicator)
    entry = recipe.config.setdefault(kind, {"columns": [], "periods": []})
    on = p.base or "close"
    if on not in entry["columns"]:
        entry["columns"].append(on)
    if kind == "macd":  # a signal period of nine where only the line is asked for
        triple = [*p.periods, 9][:3]
        if triple not in [entry["periods"][i : i + 3] for i in range(0, len(entry["periods"]), 3)]:
            entry["periods"] += triple
    elif p.periods[0] not in entry["periods"]:
        entry["periods"].append(p.periods[0])


def minimal_recipe(event: Event) -> Recipe:
    """What must be computed from candles so that the event can be evaluated."""
    recipe = Recipe()
    for c in event.components:
        for column in c.feature.sources:
            _add(recipe, column)
    return recipe


def rebuild(candles: DataFrame, recipe: Recipe) -> DataFrame:
    """Candles with just the columns of the recipe."""
    if not recipe.complete:
        raise ValueError(f"no recipe for {recipe.unknown}")
    out = candles if "rn" in candles.columns else with_rn(candles)
    out = build_features(out, recipe.config, add_color=False)
    if recipe.geometry:
        out = out.select("*", *(v.alias(k) for k, v in candle_geometry().items() if k not in out.columns))
    if recipe.patterns and "pattern" not in out.columns:
        out = out.withColumn("pattern", pattern_column())
    for column, k in recipe.lags:
        out = lag_features(out, column, periods=(k,))
    return out


def verify(event: Event, recipe: Recipe, candles: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: bars compared, and bars where the rebuilt signal differs from ``expected`` ``(ticker, rn, active)``."""
    mine = rebuild(candles, recipe).select("ticker", "rn", event.column().alias("mine"))
    both = mine.join(expected.select("ticker", "rn", "active"), ["ticker", "rn"], "full_outer")
    return both.agg(F.count("*").alias("bars"), F.sum((~F.col("mine").eqNullSafe(F.col("active"))).cast("long")).alias("differences"))


def refresh(event: Event, bars: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """The event's gate row on new bars, its threshold as it was."""
    active = bars.withColumn("__on", event.column()).where("__on").select("ticker", F.lit(event.event_id).alias("event_id"), "rn", "open_dt")
    return gate(active, bars, p)
