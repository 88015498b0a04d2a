"""Technical indicators over bars: columns named ``{on}_{indicator}_{period:02d}``.

Every bounded indicator is a window expression, and all of them go into one
projection, so Spark sorts the bars once.  The exponential ones are recursive and
run over Arrow batches of bars per ticker chunk, all in one pass; the halo before
a chunk is long enough for older bars to weigh less than a double can hold.
Values are rounded half-even to five decimals.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.windows import by_bar, full, in_chunks, lag, ratio, trailing

DIGITS = 5


def r5(c: Column) -> Column:
    return F.bround(c, DIGITS)


def name(on: str, kind: str, w: int) -> str:
    return f"{on}_{kind}_{w:02d}"


# --- bounded indicators: (on, period) -> {column name: expression} ----------------------------------


def sma(on: str, w: int) -> dict[str, Column]:
    return {name(on, "sma", w): r5(full(F.col(on), w, F.avg))}


def prev(on: str, w: int) -> dict[str, Column]:
    return {name(on, "prev", w): lag(F.col(on), w)}


def vol(on: str, w: int) -> dict[str, Column]:
    return {name(on, "vol", w): r5(full(ratio(F.col(on), lag(F.col(on))) - 1, w, F.stddev_samp))}


def rolling_min(on: str, w: int) -> dict[str, Column]:
    return {name(on, "min", w): r5(full(F.col(on), w, F.min))}


def rolling_max(on: str, w: int) -> dict[str, Column]:
    return {name(on, "max", w): r5(full(F.col(on), w, F.max))}


def ret(on: str, w: int) -> dict[str, Column]:
    return {name(on, "ret", w): r5(ratio(F.col(on), lag(F.col(on), w)) - 1)}


def bollinger(on: str, w: int) -> dict[str, Column]:
    """Mean and width are not rounded; the width is made of the rounded bands."""
    mid, sd = full(F.col(on), w, F.avg), full(F.col(on), w, F.stddev_samp)
    upper, lower = r5(mid + 2 * sd), r5(mid - 2 * sd)
    return {name(on, "bb_mid", w): mid, name(on, "bb_upper", w): upper, name(on, "bb_lower", w): lower, name(on, "bb_width", w): ratio(upper - lower, mid)}


def max_drawdown(on: str, w: int) -> dict[str, Column]:
    depth = ratio(F.col(on), full(F.col(on), w, F.max)) - 1
    return {name(on, "mdd", w): r5(F.abs(full(depth, w, F.min)))}


def _gather(c: Column, k: int) -> Column:
    """The last ``k`` values, oldest first; null unless all are there."""
    return F.when(F.count(c).over(trailing(k)) >= k, F.collect_list(c).over(trailing(k)))


def cci(on: str, w: int) -> dict[str, Column]:
    typical = (F.col("high") + F.col("low") + F.col(on)) / 3
    values, mean = _gather(typical, w), full(typical, w, F.avg)
    spread = F.aggregate(F.transform(values, lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x) / w
    return {name(on, "cci", w): r5(ratio(typical - mean, 0.015 * spread))}


def williams_r(on: str, w: int) -> dict[str, Column]:
    top, low = full(F.col("high"), w, F.max), full(F.col("low"), w, F.min)
    return {name(on, "willr", w): r5(ratio(top - F.col(on), top - low) * 100)}


def stochastic(on: str, w: int) -> dict[str, Column]:
    top, low = full(F.col("high"), w, F.max), full(F.col("low"), w, F.min)
    k = r5(ratio(F.col(on) - low, top - low) * 100)
    return {name(on, "sk", w): k, name(on, "sd", w): r5(full(k, w, F.avg))}


def wma(on: str, w: int) -> dict[str, Column]:
    values = _gather(F.col(on), w)
    total = F.aggregate(F.zip_with(values, F.sequence(F.lit(1), F.lit(w)), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return {name(on, "wma", w): r5(total / (w * (w + 1) / 2))}


def trima(on: str, w: int) -> dict[str, Column]:
    return {name(on, "trima", w): r5(full(full(F.col(on), w // 2 + 1, F.avg), w - w // 2, F.avg))}


def aroon(on: str, w: int) -> dict[str, Column]:
    """Over ``w + 1`` bars; of equal extremes the oldest counts."""
    high, low = _gather(F.col("high"), w + 1), _gather(F.col("low"), w + 1)
    at = lambda a, extreme: (F.array_position(a, extreme(a)) - 1) / w * 100
    return {f"aroon_up_{w:02d}": r5(at(high, F.array_max)), f"aroon_down_{w:02d}": r5(at(low, F.array_min))}


def williams_ad(on: str, w: int) -> dict[str, Column]:
    line = ratio(F.col("high") - lag(F.col(on)), F.col("high") - F.col("low"))
    return {name(on, "ad", w): r5(full(line, w, F.avg) if w > 1 else line)}


BOUNDED = {"sma": sma, "prev": prev, "vol": vol, "min": rolling_min, "max": rolling_max, "ret": ret, "bollinger": bollinger, "mdd": max_drawdown, "cci": cci, "willr": williams_r, "stochastic": stochastic, "wma": wma, "trima": trima, "aroon": aroon, "ad": williams_ad}


# --- recursive indicators ----------------------------------------------------------------------------


def ewm(x, alpha: float):
    """Exponential mean of a pandas series, seeded by its first value; weights decay across gaps."""
    return x.ewm(alpha=alpha, adjust=False).mean()


def _rsi(pdf, on: str, w: int) -> dict:
    step = pdf[on].diff().fillna(0.0)
    gain, loss = ewm(step.clip(lower=0), 1 / w), ewm(-step.clip(upper=0), 1 / w)
    return {name(on, "rsi", w): (100 - 100 / (1 + gain / (loss + 1e-10))).round(DIGITS)}


def _ema(pdf, on: str, w: int) -> dict:
    return {name(on, "ema", w): ewm(pdf[on], 2 / (w + 1)).round(DIGITS)}


def _true_range(pdf, on: str):
    import pandas as pd

    before = pdf[on].shift(1)
    return pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - before).abs(), (pdf["low"] - before).abs()], axis=1).max(axis=1)


def _atr(pdf, on: str, w: int) -> dict:
    atr = ewm(_true_range(pdf, on), 1 / w)
    return {name(on, "atr", w): atr.round(DIGITS), name(on, "natr", w): (atr / pdf[on].where(pdf[on] != 0)).round(DIGITS)}


def macd_names(on: str, fast: int, slow: int, signal: int) -> list[str]:
    stem = f"{on}_macd_{fast:02d}_{slow:02d}"
    return [stem, f"{stem}_signal_{signal:02d}", f"{stem}_hist_{signal:02d}"]


def _macd(pdf, on: str, fast: int, slow: int, signal: int) -> dict:
    line = (ewm(pdf[on], 2 / (fast + 1)) - ewm(pdf[on], 2 / (slow + 1))) / pdf[on].where(pdf[on] != 0)
    smooth = ewm(line, 2 / (signal + 1))
    return dict(zip(macd_names(on, fast, slow, signal), (x.round(DIGITS) for x in (line, smooth, line - smooth))))


def _adx(pdf, on: str, w: int) -> dict:
    up, down = pdf["high"].diff(), -pdf["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    atr = ewm(_true_range(pdf, on), 1 / w)
    atr = atr.where(atr != 0)
    dp, dm = 100 * ewm(plus, 1 / w) / atr, 100 * ewm(minus, 1 / w) / atr
    total = dp + dm
    dx = 100 * (dp - dm).abs() / total.where(total != 0)
    return {name(on, "adx", w): ewm(dx, 1 / w).round(DIGITS)}


RECURSIVE = {"rsi": _rsi, "ema": _ema, "atr": _atr, "adx": _adx}


def _halo(alpha: float, times: int) -> int:
    """Bars after which the weight of older ones is below 1e-18."""
    return times * math.ceil(math.log(1e-18) / math.log(1 - alpha)) if alpha < 1 else times


def recursive_features(bars: DataFrame, wanted: list[tuple[str, str, tuple[int, ...]]], *, chunk_rows: int = 100_000) -> DataFrame:
    """``(ticker, rn, …)`` for recursive indicators ``(kind, on, periods)``, all in one pass over the bars."""
    import pandas as pd

    columns, halo = [], 0
    for kind, on, p in wanted:
        if kind == "macd":
            columns += macd_names(on, *p)
            halo = max(halo, _halo(2 / (max(p) + 1), 2))
        else:
            columns += {"rsi": [name(on, "rsi", p[0])], "ema": [name(on, "ema", p[0])], "atr": [name(on, "atr", p[0]), name(on, "natr", p[0])], "adx": [name(on, "adx", p[0])]}[kind]
            halo = max(halo, _halo(2 / (p[0] + 1) if kind == "ema" else 1 / p[0], 2 if kind == "adx" else 1))
    needs = sorted({on for _, on, _ in wanted} | ({"high", "low"} if any(k in ("atr", "adx") for k, _, _ in wanted) else set()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"ticker": pdf["ticker"], "rn": pdf["rn"]}
        for kind, on, p in wanted:
            out |= _macd(pdf, on, *p) if kind == "macd" else RECURSIVE[kind](pdf, on, *p)
        frame = pd.DataFrame(out)
        return frame.astype(object).where(frame.notna(), None)

    schema = "ticker string, rn long, " + ", ".join(f"`{c}` double" for c in columns)
    return in_chunks(bars.select("ticker", F.col("rn").cast("long").alias("rn"), *needs), run, schema, halo=halo, rows=chunk_rows)


# --- candles -----------------------------------------------------------------------------------------


def color() -> Column:
    return F.when(F.col("close") > F.col("open"), 1).when(F.col("close") < F.col("open"), -1).otherwise(0)


def candle_geometry(*, gap: bool = True) -> dict[str, Column]:
    o, h, low, c = map(F.col, ("open", "high", "low", "close"))
    span = h - low
    out = {
        "body": ratio(c - o, span),
        "upper_wick": ratio(h - F.greatest(o, c), span),
        "lower_wick": ratio(F.least(o, c) - low, span),
        "close_pos": ratio(c - low, span),
        "range_pct": ratio(span, c),
    }
    if gap:
        out["gap"] = ratio(o, lag(c)) - 1
    return {k: r5(v) for k, v in out.items()}


def patterns() -> dict[str, Column]:
    """Candlestick masks in order of precedence; a mask that cannot be told is false."""
    o, h, low, c = map(F.col, ("open", "high", "low", "close"))
    po, ph, pl, pc = (lag(x) for x in (o, h, low, c))
    qo, qc = lag(o, 2), lag(c, 2)
    top, bottom = F.greatest(o, c), F.least(o, c)
    body, upper, lower = ratio(F.abs(c - o), h - low), ratio(h - top, h - low), ratio(bottom - low, h - low)
    star = ratio(F.abs(pc - po), ph - pl) <= 0.3
    small = (body > 0) & (body <= 0.35)
    found = {
        "MORNING_STAR": (qc < qo) & star & (c > o) & (c >= (qo + qc) / 2),
        "EVENING_STAR": (qc > qo) & star & (c < o) & (c <= (qo + qc) / 2),
        "BULLISH_ENGULFING": (pc < po) & (c > o) & (o <= pc) & (c >= po),
        "BEARISH_ENGULFING": (pc > po) & (c < o) & (o >= pc) & (c <= po),
        "BULLISH_HARAMI": (pc < po) & (c > o) & (c <= po) & (o >= pc),
        "BEARISH_HARAMI": (pc > po) & (c < o) & (o <= pc) & (c >= po),
        "MARUBOZU": body >= 0.9,
        "HAMMER": small & (lower >= 2 * body) & (upper <= 0.15),
        "SHOOTING_STAR": small & (upper >= 2 * body) & (lower <= 0.15),
        "DOJI": body <= 0.1,
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def pattern_column(only: Iterable[str] | None = None) -> Column:
    """Name of the first pattern that fits, or null."""
    masks = patterns()
    chosen = [k for k in masks if only is None or k in set(only)]
    unknown = set(only or ()) - set(masks)
    if unknown:
        raise KeyError(f"unknown patterns: {sorted(unknown)}")
    return F.coalesce(*(F.when(masks[k], F.lit(k)) for k in chosen))


def lag_features(bars: DataFrame, *columns: str, periods: Iterable[int] = (1,), like: str | None = None) -> DataFrame:
    """Adds ``{column}_prev_{k}`` for named columns and those whose name contains ``like``."""
    missing = [c for c in columns if c not in bars.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")
    chosen = list(dict.fromkeys([*columns, *(c for c in bars.columns if like and like in c)]))
    if not chosen:
        raise ValueError("no column is selected")
    return bars.select("*", *(lag(F.col(c), k).alias(name(c, "prev", k)) for c in chosen for k in periods))


# --- configuration -----------------------------------------------------------------------------------

#: Indicator, source columns, periods (MACD: triples), enabled.
DEFAULT_CONFIG: dict[str, dict] = {
    "sma": {"columns": ["close", "volume"], "periods": [9, 25]},
    "ema": {"columns": ["close"], "periods": [9, 25]},
    "ret": {"columns": ["close", "volume"], "periods": [1, 3]},
    "vol": {"columns": ["close"], "periods": [14]},
    "rsi": {"columns": ["close"], "periods": [14]},
    "min": {"columns": ["close"], "periods": [24]},
    "max": {"columns": ["close"], "periods": [24]},
    "bollinger": {"columns": ["close"], "periods": [20]},
    "mdd": {"columns": ["close"], "periods": [24]},
    **{k: {"columns": ["close"], "periods": [14], "enabled": False} for k in ("atr", "cci", "willr", "stochastic", "wma", "trima", "adx", "aroon", "ad")},
    "macd": {"columns": ["close"], "periods": [12, 26, 9], "enabled": False},
}


def build_features(bars: DataFrame, config: dict[str, dict] | None = None, *, add_color: bool = True) -> DataFrame:
    """Bars with all configured indicators: one projection, one pass for the recursive ones, one join of both.

    Entries that are disabled, unknown, or name missing columns are skipped with a warning.
    """
    config = DEFAULT_CONFIG if config is None else config
    expressions: dict[str, Column] = {}
    recursive: list[tuple[str, str, tuple[int, ...]]] = []
    for kind, entry in config.items():
        if not entry.get("enabled", True):
            continue
        if kind not in BOUNDED and kind not in RECURSIVE and kind != "macd":
            warnings.warn(f"unknown indicator {kind!r} is skipped", stacklevel=2)
            continue
        for on in entry["columns"]:
            if on not in bars.columns:
                warnings.warn(f"{kind}: no column {on!r}, skipped", stacklevel=2)
                continue
            p = list(entry["periods"])
            if kind == "macd":
                if len(p) % 3:
                    raise ValueError("MACD periods are triples")
                recursive += [(kind, on, tuple(p[i : i + 3])) for i in range(0, len(p), 3)]
            elif kind in RECURSIVE:
                recursive += [(kind, on, (w,)) for w in p]
            else:
                for w in p:
                    expressions |= BOUNDED[kind](on, w)
    if add_color and {"open", "close"} <= set(bars.columns):
        expressions["color"] = color()
    out = bars.select("*", *(v.alias(k) for k, v in expressions.items()))
    if recursive:
        out = out.join(recursive_features(bars, recursive), ["ticker", "rn"], "left")
    return out


__all__ = ["BOUNDED", "DEFAULT_CONFIG", "RECURSIVE", "build_features", "by_bar", "candle_geometry", "color", "ewm", "lag_features", "pattern_column", "patterns", "recursive_features"]
