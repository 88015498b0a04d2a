"""Column typing, feature generation and transforms: driver-side plans over metadata, one projection over bars.

A feature is a :class:`Feature`: how to compute it from columns.  Frozen numbers
(the spread of a normalised difference) are measured once by one aggregate job and
stored in it, so that it gives the same values on any later data.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.windows import lag, ratio, trailing

CONTINUOUS, BINARY, CATEGORICAL = "CONTINUOUS", "BINARY", "CATEGORICAL"
#: Columns that are never classified.
SKIP = ("ticker", "rn", "open_dt", "close_dt", "timestamp", "regime", "regime_code", "regime_stable", "open", "high", "low", "volume")
OHLC = ("open", "high", "low", "close")


# --- typing ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Classified:
    column: str
    kind: str
    scale_free: bool = False


def count_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, non_null, distinct_values)`` in one pass."""
    stats = df.agg(*(F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)), *(F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("non_null"), F.col(f"d_{i}").alias("distinct_values")) for i, c in enumerate(columns)))
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def scale_free_overlap(df: DataFrame, columns: list[str], *, most_blocks: int = 4, block_rows: int = 250) -> DataFrame:
    """``(column, n, blocks, overlap)``: least overlap of a block's 5-95 % range with the whole one.

    The non-null values of a column, in order of ``rn``, are cut into 2 to
    ``most_blocks`` equal consecutive blocks, the last taking the rest.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = df.select("ticker", "rn", each.alias("x")).select("ticker", "rn", "x.column", "x.v").where("v is not null")
    w = Window.partitionBy("ticker", "column")
    long = long.withColumn("i", F.row_number().over(w.orderBy("rn")) - 1).withColumn("n", F.count("*").over(w))
    blocks = F.greatest(F.lit(2), F.least(F.lit(most_blocks), F.expr(f"n div {block_rows}")))
    long = long.withColumn("blocks", blocks).withColumn("block", F.expr("least(blocks - 1, i div greatest(1, n div blocks))"))
    ends = F.array(F.lit(0.05), F.lit(0.95))
    whole = long.groupBy("ticker", "column").agg(F.percentile("v", ends).alias("g"), F.first("n").alias("n"), F.first("blocks").alias("blocks"))
    part = long.groupBy("ticker", "column", "block").agg(F.percentile("v", ends).alias("b"))
    both = part.join(whole, ["ticker", "column"])
    g0, g1, b0, b1 = F.get("g", 0), F.get("g", 1), F.get("b", 0), F.get("b", 1)
    shared, spread = F.greatest(F.lit(0.0), F.least(b1, g1) - F.greatest(b0, g0)), F.greatest(b1, g1) - F.least(b0, g0)
    both = both.withColumn("o", F.when(g1 == g0, 0.0).otherwise(F.coalesce(ratio(shared, spread), F.lit(0.0))))
    return both.groupBy("ticker", "column").agg(F.first("n").alias("n"), F.first("blocks").alias("blocks"), F.min("o").alias("overlap"))


def classify(df: DataFrame, *, threshold: float = 0.5, overrides: dict[str, bool] | None = None, skip: Iterable[str] = SKIP) -> dict[str, Classified]:
    """Kind of every column that varies, and whether continuous ones keep their range over time (for one ticker)."""
    columns = [c for c in df.columns if c not in set(skip)]
    kinds = dict(df.dtypes)
    found: dict[str, Classified] = {}
    if not columns:
        return found
    for r in count_values(df, columns).collect():  # one row per column
        if r.non_null == 0 or r.distinct_values <= 1:
            continue
        numeric = kinds[r.column] in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") or kinds[r.column].startswith("decimal")
        found[r.column] = Classified(r.column, CATEGORICAL if not numeric else BINARY if r.distinct_values == 2 else CONTINUOUS)
    lines = [c for c, k in found.items() if k.kind == CONTINUOUS]
    if lines:
        for r in scale_free_overlap(df, lines).groupBy("column").agg(F.min("overlap").alias("overlap"), F.min("n").alias("n")).collect():
            found[r.column] = replace(found[r.column], scale_free=r.n >= 48 and r.overlap >= threshold)
    for c, v in (overrides or {}).items():
        if c in found:
            found[c] = replace(found[c], scale_free=v)
    return found


# --- names -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Parsed:
    column: str
    base: str
    indicator: str
    periods: tuple[int, ...]
    family: str


_NAME = re.compile(r"^(?P<base>open|high|low|close|volume)_(?P<rest>.+)$")


def parse_name(column: str) -> Parsed | None:
    """What a column name says: base, indicator, periods and the family within which columns are compared."""
    if column in OHLC:
        return Parsed(column, column, "raw", (), "price")
    if column == "volume":
        return Parsed(column, column, "raw", (), "volume")
    if column in ("body", "upper_wick", "lower_wick", "close_pos", "range_pct", "gap"):
        return Parsed(column, "", column, (), "candle_geometry")
    if m := re.fullmatch(r"aroon_(up|down)_(\d+)", column):
        return Parsed(column, "", f"aroon_{m[1]}", (int(m[2]),), f"aroon_{m[1]}")
    m = _NAME.match(column)
    if not m:
        return None
    base, rest = m["base"], m["rest"]
    price = base != "volume"
    if price and (x := re.fullmatch(r"bb_(lower|upper|width|mid)_(\d+)", rest)):
        return Parsed(column, base, f"bb_{x[1]}", (int(x[2]),), "bollinger")
    if not price and (x := re.fullmatch(r"(sma|ema)_(\d+)", rest)):
        return Parsed(column, base, x[1], (int(x[2]),), "volume_ma")
    if price and (x := re.fullmatch(r"macd_(\d+)_(\d+)(?:_(signal|hist)_(\d+))?", rest)):
        periods = tuple(int(v) for v in (x[1], x[2], x[4]) if v)
        return Parsed(column, base, f"macd_{x[3]}" if x[3] else "macd", periods, f"macd_{x[3] or 'line'}")
    if x := re.fullmatch(r"(ema|sma|rsi|dema|tema|wma|hma|mdd|atr|natr|trima|cci|willr|sk|sd|adx|ad)_(\d+)", rest):
        return Parsed(column, base, x[1], (int(x[2]),), x[1])
    if base in ("close", "high", "low") and (x := re.fullmatch(r"(min|max)_(\d+)", rest)):
        return Parsed(column, base, x[1], (int(x[2]),), f"rolling_{x[1]}")
    if base in ("close", "high", "low") and (x := re.fullmatch(r"vol_(\d+)", rest)):
        return Parsed(column, base, "vol", (int(x[1]),), "volatility")
    if base in ("close", "high", "low", "volume") and (x := re.fullmatch(r"ret_(\d+)", rest)):
        return Parsed(column, base, "ret", (int(x[1]),), "return")
    return None


# --- features ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Feature:
    name: str
    operation: str  # identity, ratio, spread, diffnorm, position
    sources: tuple[str, ...]
    lag: int = 0  # of the second source
    std: float | None = None  # of a normalised difference, frozen
    scale_free: bool = True
    identity_only: bool = False

    def column(self) -> Column:
        a = F.col(self.sources[0])
        if self.operation == "identity":
            return a
        b = F.col(self.sources[1])
        b = lag(b, self.lag) if self.lag else b
        if self.operation == "ratio":
            return ratio(a, b)
        if self.operation == "spread":
            return ratio(a - b, b)
        if self.operation == "diffnorm":
            return (a - b) / self.std if self.std else F.lit(None).cast("double")
        return ratio(a - b, F.col(self.sources[2]) - b)

    def sql(self) -> str:
        a, *rest = (f'"{s}"' for s in self.sources)
        if self.operation == "identity":
            return a
        b = f"lag({rest[0]}, {self.lag}) OVER (PARTITION BY ticker ORDER BY rn)" if self.lag else rest[0]
        if self.operation == "ratio":
            return f"({a} / nullif({b}, 0))"
        if self.operation == "spread":
            return f"(({a} - {b}) / nullif({b}, 0))"
        if self.operation == "diffnorm":
            return f"(({a} - {b}) / {self.std!r}::DOUBLE)" if self.std else "NULL::DOUBLE"
        return f"(({a} - {b}) / nullif({rest[1]} - {b}, 0))"


def _pair(tag: str, a: str, b: str) -> list[Feature]:
    return [Feature(f"ratio_{tag}", "ratio", (a, b)), Feature(f"diffnorm_{tag}", "diffnorm", (a, b))]


def _first(p: Parsed) -> int:
    return p.periods[0] if p.periods else 0


def plan_features(classified: dict[str, Classified], columns: Iterable[str], *, cross_lags: tuple[int, ...] = (1, 3, 6, 12), indicator_lags: tuple[int, ...] = (1, 3)) -> list[Feature]:
    """All features that the columns allow, in a fixed order; the first with a name wins."""
    present = set(columns)
    lines = [c for c, k in classified.items() if k.kind == CONTINUOUS]
    parsed = {c: p for c in [*lines, *(o for o in (*OHLC, "volume") if o in present and o not in lines)] if (p := parse_name(c))}
    out = [Feature(c, "identity", (c,), scale_free=True) for c in lines if classified[c].scale_free]

    groups: dict[tuple[str, str], list[Parsed]] = {}
    for p in parsed.values():
        if p.family not in ("bollinger", "rolling_min", "rolling_max", "price", "volume", "candle_geometry", "macd_line", "macd_signal", "macd_hist"):
            groups.setdefault((p.base, p.family), []).append(p)
    for (base, _), members in groups.items():
        for a, b in combinations(sorted(members, key=_first), 2):
            stem = f"{base}_" if base else ""
            out += _pair(f"{stem}{a.indicator}{_first(a):02d}_{b.indicator}{_first(b):02d}", a.column, b.column)
    averages = [p for p in parsed.values() if p.base == "close" and p.family in ("ema", "sma", "wma", "hma", "trima")]
    prices = sorted((p for p in parsed.values() if p.family == "price"), key=lambda p: (p.column not in classified, OHLC.index(p.column)))
    out += [Feature(f"spread_close_{m.indicator}{_first(m):02d}", "spread", (p.column, m.column)) for p in prices for m in averages]
    out += [Feature(f"ratio_volume_{v.indicator}{_first(v):02d}", "ratio", ("volume", v.column)) for v in parsed.values() if v.family == "volume_ma" and "volume" in present]

    ohlc = [c for c in OHLC if c in present]
    for a in ohlc:
        for b in ohlc:
            if a != b:
                for k in cross_lags:
                    out += [Feature(f"{op}_{a}_{b}_lag{k}", op, (a, b), lag=k, identity_only=True) for op in ("ratio", "spread")]
    lines_of = {(p.base, *p.periods[:2]): p for p in parsed.values() if p.family == "macd_line"}
    for p in parsed.values():
        if p.family == "macd_signal" and (line := lines_of.get((p.base, *p.periods[:2]))):
            out += _pair(f"{p.base}_macd{p.periods[0]:02d}_{p.periods[1]:02d}_signal", line.column, p.column)
    returns = {(p.base, _first(p)): p for p in parsed.values() if p.family == "return"}
    for (base, k), p in returns.items():
        if base == "close" and ("volume", k) in returns:
            out += _pair(f"close_volume_ret{k:02d}", p.column, returns["volume", k].column)
    geometry = sorted([p for p in parsed.values() if p.family in ("candle_geometry", "natr")], key=lambda p: p.column)
    for a, b in combinations(geometry, 2):
        if "candle_geometry" in (a.family, b.family):
            out += _pair(f"candle_{a.column}_{b.column}", a.column, b.column)
    down = {_first(p): p for p in parsed.values() if p.family == "aroon_down"}
    for p in parsed.values():
        if p.family == "aroon_up" and _first(p) in down:
            out += _pair(f"aroon{_first(p):02d}_up_down", p.column, down[_first(p)].column)
    for p in parsed.values():
        if p.base in ohlc and p.family in ("ema", "sma", "wma", "hma", "trima", "rolling_min", "rolling_max", "bollinger") and p.indicator != "bb_width":
            for base in ohlc:
                for k in indicator_lags:
                    out.append(Feature(f"ratio_{p.indicator}{_first(p):02d}_{base}_lag{k}", "ratio", (p.column, base), lag=k, identity_only=True))
    ends = {(p.base, p.indicator, _first(p)): p for p in parsed.values() if p.family in ("bollinger", "rolling_min", "rolling_max")}
    for (base, what, k), p in ends.items():
        if what == "bb_lower" and (base, "bb_upper", k) in ends and base in present:
            out.append(Feature(f"bb_pct_b_{base}_{k:02d}", "position", (base, p.column, ends[base, "bb_upper", k].column)))
    for (base, what, k), p in ends.items():
        if what == "min" and (base, "max", k) in ends:
            source = base if base in present else "close"
            if source in present:
                out.append(Feature(f"pos_{base}_range{k:02d}", "position", (source, p.column, ends[base, "max", k].column)))
    unique: dict[str, Feature] = {}
    for f in out:
        unique.setdefault(f.name, f)
    return list(unique.values())


def freeze(df: DataFrame, features: list[Feature]) -> list[Feature]:
    """Measure the spread of every normalised difference, in one job, and store it."""
    pending = [f for f in features if f.operation == "diffnorm" and f.std is None]
    if not pending:
        return features
    row = df.agg(*(F.stddev_samp(F.col(f.sources[0]) - F.col(f.sources[1])).alias(str(i)) for i, f in enumerate(pending))).first()
    std = {f.name: (row[str(i)] or 0.0) for i, f in enumerate(pending)}
    return [replace(f, std=std[f.name]) if f.name in std else f for f in features]


def add_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """All features in one projection."""
    return df.select("*", *(f.column().alias(f.name) for f in features if f.name not in df.columns))


# --- transforms --------------------------------------------------------------------------------------

WINDOWS = (48, 96, 168)
DELTAS = (1, 3, 6, 12)


@dataclass(frozen=True)
class Transform:
    kind: str = "identity"  # identity, pctrank, zscore, delta
    size: int = 0

    @property
    def tag(self) -> str:
        return self.kind if self.kind == "identity" else f"{self.kind}{self.size}"

    def column(self, x: Column) -> Column:
        if self.kind == "identity":
            return x
        if self.kind == "delta":
            return x - lag(x, self.size)
        w, least = trailing(self.size), max(2, self.size // 2)
        if self.kind == "zscore":
            sd = F.stddev_samp(x).over(w)
            return F.when((F.count(x).over(w) >= least) & (sd > 0), (x - F.avg(x).over(w)) / sd)
        # average rank of ties over the number of values; each bar gathers its own window only
        seen = F.collect_list(x).over(w)
        rank = F.size(F.filter(seen, lambda v: v < x)) + (F.size(F.filter(seen, lambda v: v == x)) + 1) / 2
        return F.when(x.isNotNull() & (F.size(seen) >= least), rank / F.size(seen))

    def sql(self, x: str) -> str:
        over = "OVER (PARTITION BY ticker ORDER BY rn"
        if self.kind == "identity":
            return x
        if self.kind == "delta":
            return f"({x} - lag({x}, {self.size}) {over}))"
        w, least = f"{over} ROWS BETWEEN {self.size - 1} PRECEDING AND CURRENT ROW)", max(2, self.size // 2)
        if self.kind == "zscore":
            return f"CASE WHEN count({x}) {w} >= {least} AND stddev_samp({x}) {w} > 0 THEN ({x} - avg({x}) {w}) / stddev_samp({x}) {w} END"
        seen = f"list_filter(list({x}) {w}, lambda v: v IS NOT NULL)"
        return f"CASE WHEN {x} IS NOT NULL AND count({x}) {w} >= {least} THEN (len(list_filter({seen}, lambda v: v < {x})) + (len(list_filter({seen}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len({seen}) END"


def catalogue(feature: Feature, allowed: Iterable[str] | None = None) -> list[Transform]:
    """Transforms of a feature: at most 11; only the plain value for features over lagged prices."""
    out = [Transform()] if feature.scale_free else []
    if not feature.identity_only:
        out += [Transform("pctrank", w) for w in WINDOWS] + [Transform("zscore", w) for w in WINDOWS] + [Transform("delta", k) for k in DELTAS]
    return [t for t in out if allowed is None or t.kind in set(allowed)]
