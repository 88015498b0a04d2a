"""Queries of the indicators (K) over daily bars with five tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import indicators as ind
from ruleloom.plans.registry import over, pick, query, rounded, s_full, s_lag, s_ratio, s_select
from ruleloom.sources.bars import ORDER_BARS_SQL as BARS
from ruleloom.sources.bars import order_bars

C = "close"


def _bounded(name: str, kind: str, periods: tuple[int, ...], sql: dict[str, str], ctes: str = "", source: str = "bars") -> None:
    @query(name, s_select(BARS, sql, source, ctes, digits=5))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        expressions = {}
        for w in periods:
            expressions |= ind.BOUNDED[kind](C, w)
        return pick(order_bars(spark, sf_dir), expressions, 5)


_bounded("k1_sma", "sma", (5, 20), {f"close_sma_{w:02d}": s_full(C, w, "avg") for w in (5, 20)})
_bounded("k2_lag", "prev", (1, 3), {f"close_prev_{w:02d}": s_lag(C, w) for w in (1, 3)})
_bounded("k3_volatility", "vol", (14,), {"close_vol_14": s_full("r", 14, "stddev_samp")}, f"x AS (SELECT *, {s_ratio(C, s_lag(C))} - 1 AS r FROM bars)", "x")
_bounded("k4_rolling_min", "min", (24,), {"close_min_24": s_full(C, 24, "min")})
_bounded("k5_rolling_max", "max", (24,), {"close_max_24": s_full(C, 24, "max")})
_bounded("k6_return", "ret", (1, 3), {f"close_ret_{w:02d}": s_ratio(C, s_lag(C, w)) + " - 1" for w in (1, 3)})
_bounded(
    "k8_bollinger",
    "bollinger",
    (20,),
    {"close_bb_mid_20": "m", "close_bb_upper_20": "u", "close_bb_lower_20": "l", "close_bb_width_20": "(u - l) / nullif(m, 0)"},
    f"x AS (SELECT *, {s_full(C, 20, 'avg')} AS m, {s_full(C, 20, 'stddev_samp')} AS s FROM bars), y AS (SELECT *, round_even(m + 2 * s, 5) AS u, round_even(m - 2 * s, 5) AS l FROM x)",
    "y",
)
_bounded("k9_max_drawdown", "mdd", (12,), {"close_mdd_12": f"abs({s_full('d', 12, 'min')})"}, f"x AS (SELECT *, {s_ratio(C, s_full(C, 12, 'max'))} - 1 AS d FROM bars)", "x")
_bounded(
    "k13_cci",
    "cci",
    (14,),
    {"close_cci_14": "(t - m) / nullif(0.015 * list_avg(list_transform(v, lambda z: abs(z - m))), 0)"},
    f"x AS (SELECT *, (high + low + close) / 3 AS t FROM bars), y AS (SELECT *, {s_full('t', 14, 'avg')} AS m, {s_full('t', 14, 'list')} AS v FROM x)",
    "y",
)
_bounded("k14_williams_r", "willr", (14,), {"close_willr_14": s_ratio(f"{s_full('high', 14, 'max')} - close", f"{s_full('high', 14, 'max')} - {s_full('low', 14, 'min')}") + " * 100"})
_bounded(
    "k15_stochastic",  # five bars: the mean of five values of five decimals is never a tie in rounding
    "stochastic",
    (5,),
    {"close_sk_05": "k", "close_sd_05": s_full("k", 5, "avg")},
    f"x AS (SELECT *, round_even({s_ratio(f'close - {s_full("low", 5, "min")}', f'{s_full("high", 5, "max")} - {s_full("low", 5, "min")}')} * 100, 5) AS k FROM bars)",
    "x",
)
_bounded("k16_wma", "wma", (9,), {"close_wma_09": f"CASE WHEN count(close) {over(9)} >= 9 THEN (" + " + ".join(f"{9 - i} * {s_lag(C, i) if i else C}" for i in range(9)) + ") / 45.0::DOUBLE END"})
_bounded("k17_trima", "trima", (9,), {"close_trima_09": s_full("a", 5, "avg")}, f"x AS (SELECT *, {s_full(C, 5, 'avg')} AS a FROM bars)", "x")
_bounded(
    "k19_aroon",
    "aroon",
    (14,),
    {"aroon_up_14": "(list_position(h, list_max(h)) - 1) / 14.0::DOUBLE * 100", "aroon_down_14": "(list_position(l, list_min(l)) - 1) / 14.0::DOUBLE * 100"},
    f"x AS (SELECT *, {s_full('high', 15, 'list')} AS h, {s_full('low', 15, 'list')} AS l FROM bars)",
    "x",
)
_bounded("k20_williams_ad", "ad", (1, 5), {"close_ad_01": "a", "close_ad_05": s_full("a", 5, "avg")}, f"x AS (SELECT *, {s_ratio(f'high - {s_lag(C)}', 'high - low')} AS a FROM bars)", "x")


def _steps(alpha: float, value: str, first: str, extra: str) -> str:
    return f"{alpha!r}::DOUBLE * ({value}) + {1 - alpha!r}::DOUBLE * ({first})" + extra


def _recursive(name: str, wanted: list, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(ind.recursive_features(order_bars(spark, sf_dir), wanted), 5)


def _scan(state: dict[str, tuple[str, str]], columns: dict[str, str], ctes: str, source: str) -> str:
    """A recursive query: ``state`` maps a name to its first value and its next one (``p`` before, ``n`` now)."""
    first = ", ".join(f"({a})::DOUBLE AS {k}" for k, (a, _) in state.items())
    following = ", ".join(f"({b})::DOUBLE" for _, b in state.values())
    scan = f"e AS (SELECT n.*, {first} FROM {source} n WHERE rn = 0 UNION ALL SELECT n.*, {following} FROM e p JOIN {source} n ON n.ticker = p.ticker AND n.rn = p.rn + 1)"
    return s_select(BARS, columns, "e", f"{ctes}{', ' if ctes else ''}{scan}", digits=5)


def _mean(alpha: float, x: str, k: str) -> tuple[str, str]:
    return x.replace("@", "n"), f"{1 - alpha!r} * p.{k} + {alpha!r} * {x.replace('@', 'n')}"


_recursive("k10_ema", [("ema", C, (9,)), ("ema", C, (25,))], _scan({"a": _mean(0.2, "@.close", "a"), "b": _mean(2 / 26, "@.close", "b")}, {"close_ema_09": "round_even(a, 5)", "close_ema_25": "round_even(b, 5)"}, "", "bars"))
_RSI = f"x AS (SELECT *, coalesce(close - {s_lag(C)}, 0) AS d FROM bars)"
_recursive("k7_rsi", [("rsi", C, (14,))], _scan({"g": _mean(1 / 14, "greatest(@.d, 0)", "g"), "l": _mean(1 / 14, "greatest(-@.d, 0)", "l")}, {"close_rsi_14": "round_even(100 - 100 / (1 + g / (l + 1e-10)), 5)"}, _RSI, "x"))
_TR = f"x AS (SELECT *, greatest(high - low, coalesce(abs(high - {s_lag(C)}), 0), coalesce(abs(low - {s_lag(C)}), 0)) AS tr, coalesce(high - {s_lag('high')}, 0) AS up, coalesce({s_lag('low')} - low, 0) AS dn FROM bars)"
_recursive("k11_atr", [("atr", C, (14,))], _scan({"a": _mean(1 / 14, "@.tr", "a")}, {"close_atr_14": "round_even(a, 5)", "close_natr_14": "round_even(a / nullif(close, 0), 5)"}, _TR, "x"))
_LINE = "((f) - (s)) / nullif(n.close, 0)"
_F, _S = _mean(2 / 13, "@.close", "f"), _mean(2 / 27, "@.close", "s")
_recursive(
    "k12_macd",
    [("macd", C, (12, 26, 9))],
    _scan({"f": _F, "s": _S, "g": ("0", f"0.8 * p.g + 0.2 * (({_F[1]}) - ({_S[1]})) / n.close")}, {"close_macd_12_26": "round_even((f - s) / close, 5)", "close_macd_12_26_signal_09": "round_even(g, 5)", "close_macd_12_26_hist_09": "round_even((f - s) / close - g, 5)"}, "", "bars"),
)
_PLUS, _MINUS = "CASE WHEN n.up > n.dn AND n.up > 0 THEN n.up ELSE 0 END", "CASE WHEN n.dn > n.up AND n.dn > 0 THEN n.dn ELSE 0 END"
_recursive(
    "k18_adx",
    [("adx", C, (14,))],
    s_select(
        BARS,
        {"close_adx_14": "round_even(z, 5)"},
        "r",
        _TR
        + f", e AS (SELECT n.*, n.tr AS a, 0::DOUBLE AS u, 0::DOUBLE AS v FROM x n WHERE rn = 0 UNION ALL SELECT n.*, {_mean(1 / 14, '@.tr', 'a')[1]}, {1 - 1 / 14!r} * p.u + {1 / 14!r} * ({_PLUS}), {1 - 1 / 14!r} * p.v + {1 / 14!r} * ({_MINUS}) FROM e p JOIN x n ON n.ticker = p.ticker AND n.rn = p.rn + 1)"
        + ", y AS (SELECT ticker, rn, 100 * u / nullif(a, 0) AS p, 100 * v / nullif(a, 0) AS m FROM e), q AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM y)"
        + f", r AS (SELECT *, dx AS z, CASE WHEN dx IS NULL THEN 1 ELSE 0 END AS gap FROM q WHERE rn = 0 UNION ALL SELECT n.*, CASE WHEN n.dx IS NULL THEN p.z WHEN p.z IS NULL THEN n.dx ELSE (pow({1 - 1 / 14!r}, p.gap + 1) * p.z + {1 / 14!r} * n.dx) / (pow({1 - 1 / 14!r}, p.gap + 1) + {1 / 14!r}) END, CASE WHEN n.dx IS NULL THEN p.gap + 1 ELSE 0 END FROM r p JOIN q n ON n.ticker = p.ticker AND n.rn = p.rn + 1)",
        digits=5,
    ),
)


@query("k21_color", f"WITH {BARS} SELECT ticker, rn::BIGINT AS rn, CASE WHEN close > open THEN 1 WHEN close < open THEN -1 ELSE 0 END::INTEGER AS color FROM bars")
def k21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_bars(spark, sf_dir).select("ticker", F.col("rn").cast("long").alias("rn"), ind.color().alias("color"))


_K22 = {"sma": {"columns": ["close", "volume"], "periods": [9]}, "ret": {"columns": ["close", "gone"], "periods": [1]}, "ema": {"columns": ["close"], "periods": [9]}, "nothing": {"columns": ["close"], "periods": [1]}, "cci": {"columns": ["close"], "periods": [14], "enabled": False}}


@query(
    "k22_build_features",
    _scan(
        {"a": _mean(0.2, "@.close", "a")},
        {"close_sma_09": "x1", "volume_sma_09": "x2", "close_ret_01": "x3", "close_ema_09": "round_even(a, 5)"},
        f"x AS (SELECT *, {s_full(C, 9, 'avg')} AS x1, {s_full('volume', 9, 'avg')} AS x2, {s_ratio(C, s_lag(C))} - 1 AS x3 FROM bars)",
        "x",
    ),
)
def k22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch of a configuration; unknown, disabled and missing entries are skipped."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = ind.build_features(order_bars(spark, sf_dir), _K22)
    return rounded(out.select("ticker", F.col("rn").cast("long").alias("rn"), "close_sma_09", "volume_sma_09", "close_ret_01", "close_ema_09"), 5)


@query("k24_lag_features", s_select(BARS, {f"{c}_prev_{k:02d}": s_lag(c, k) for c in ("close", "high", "low") for k in (1, 5)}))
def k24(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.lag_features(order_bars(spark, sf_dir).select("ticker", "rn", "close", "high", "low"), "close", "high", "low", periods=(1, 5))
    return rounded(out.select("ticker", F.col("rn").cast("long").alias("rn"), *(c for c in out.columns if "_prev_" in c)))


_SPAN = "high - low"


@query(
    "k25_candle_geometry",
    s_select(
        BARS,
        {
            "body": s_ratio("close - open", _SPAN),
            "upper_wick": s_ratio("high - greatest(open, close)", _SPAN),
            "lower_wick": s_ratio("least(open, close) - low", _SPAN),
            "close_pos": s_ratio("close - low", _SPAN),
            "range_pct": s_ratio(_SPAN, "close"),
            "gap": s_ratio("open", s_lag(C)) + " - 1",
        },
        digits=5,
    ),
)
def k25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(order_bars(spark, sf_dir), ind.candle_geometry(), 5)


@query(
    "k26_candle_patterns",
    f"""WITH {BARS}, x AS (SELECT *, {s_lag('open')} AS po, {s_lag('high')} AS ph, {s_lag('low')} AS pl, {s_lag(C)} AS pc, {s_lag('open', 2)} AS qo, {s_lag(C, 2)} AS qc,
  abs(close - open) / nullif(high - low, 0) AS fb, (high - greatest(open, close)) / nullif(high - low, 0) AS fu, (least(open, close) - low) / nullif(high - low, 0) AS fl FROM bars)
SELECT ticker, rn::BIGINT AS rn, CASE
  WHEN qc < qo AND abs(pc - po) / nullif(ph - pl, 0) <= 0.3 AND close > open AND close >= (qo + qc) / 2 THEN 'MORNING_STAR'
  WHEN qc > qo AND abs(pc - po) / nullif(ph - pl, 0) <= 0.3 AND close < open AND close <= (qo + qc) / 2 THEN 'EVENING_STAR'
  WHEN pc < po AND close > open AND open <= pc AND close >= po THEN 'BULLISH_ENGULFING'
  WHEN pc > po AND close < open AND open >= pc AND close <= po THEN 'BEARISH_ENGULFING'
  WHEN pc < po AND close > open AND close <= po AND open >= pc THEN 'BULLISH_HARAMI'
  WHEN pc > po AND close < open AND open <= pc AND close >= po THEN 'BEARISH_HARAMI'
  WHEN fb >= 0.9 THEN 'MARUBOZU'
  WHEN fb > 0 AND fb <= 0.35 AND fl >= 2 * fb AND fu <= 0.15 THEN 'HAMMER'
  WHEN fb > 0 AND fb <= 0.35 AND fu >= 2 * fb AND fl <= 0.15 THEN 'SHOOTING_STAR'
  WHEN fb <= 0.1 THEN 'DOJI' END AS pattern FROM x""",
)
def k26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_bars(spark, sf_dir).select("ticker", F.col("rn").cast("long").alias("rn"), ind.pattern_column().alias("pattern"))
