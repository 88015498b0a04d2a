"""Market regimes: buckets of an EMA ratio, their stability, and the memory of prices."""

from __future__ import annotations

import math
from bisect import insort
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.windows import by_bar, full, lag, ratio, trailing
from ruleloom.operators.indicators import name, recursive_features

LABELS = ("STRONG_BEAR", "BEAR", "NEUTRAL", "BULL", "STRONG_BULL")
THRESHOLDS = (0.975, 0.99, 1.01, 1.025)
SHARES = (0.1, 0.2, 0.4, 0.2, 0.1)
WARM_UP = 200


class RegimeClassifier(Protocol):
    """A user's own classifier: adds ``regime`` (text) and ``regime_code`` (its place in the order)."""

    def classify(self, bars: DataFrame) -> DataFrame: ...

    def labels(self) -> tuple[str, ...]: ...


def with_ema_ratio(bars: DataFrame, source: str = "close", short: int = 9, long: int = 25) -> DataFrame:
    """Adds ``ema_ratio``; EMA columns that are there already are used as they are."""
    wanted = [("ema", source, (p,)) for p in (short, long) if name(source, "ema", p) not in bars.columns]
    if wanted:
        bars = bars.join(recursive_features(bars, wanted), ["ticker", "rn"], "left")
    return bars.withColumn("ema_ratio", ratio(F.col(name(source, "ema", short)), F.col(name(source, "ema", long))))


def bucket(value: Column, thresholds: tuple[float, ...] | list[Column]) -> Column:
    """Number of thresholds strictly below the value; null for null."""
    over = sum((F.when(value > t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return F.when(value.isNotNull(), over)


def label(code: Column, labels: tuple[str, ...] = LABELS) -> Column:
    return F.get(F.array(*map(F.lit, labels)), code)


def balanced_thresholds(df: DataFrame, value: str, shares: tuple[float, ...] = SHARES, *, fixed: tuple[float, ...] = THRESHOLDS, least: int = WARM_UP) -> DataFrame:
    """``(ticker, thresholds)``: quantiles at the cumulative shares, or the fixed ones if values are few or quantiles not rising."""
    cum = [round(sum(shares[: i + 1]), 12) for i in range(len(shares) - 1)]
    q = df.groupBy("ticker").agg(F.percentile(value, F.array(*map(F.lit, cum))).alias("q"), F.count(value).alias("n"))
    rising = F.lit(True)
    for i in range(len(cum) - 1):
        rising = rising & (F.get("q", i) < F.get("q", i + 1))
    return q.select("ticker", F.when((F.col("n") >= least) & rising, F.col("q")).otherwise(F.array(*map(F.lit, fixed))).alias("thresholds"))


def with_expanding_code(df: DataFrame, value: str, out: str, shares: tuple[float, ...] = SHARES, *, fixed: tuple[float, ...] = THRESHOLDS, warm_up: int = WARM_UP) -> DataFrame:
    """Adds ``out``: bucket by quantiles of all values so far; fixed thresholds until ``warm_up`` values are seen.

    One pass per ticker keeps its values sorted as they come, so a bar costs a search and an
    insertion and not a sort of all before it; a task holds one number per bar of a ticker.
    """
    import pyarrow as pa

    cum = [round(sum(shares[: i + 1]), 12) for i in range(len(shares) - 1)]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        seen: list[float] = []
        codes: list[int | None] = []
        for v in table["v"].to_pylist():
            if v is None:
                codes.append(None)
                continue
            insort(seen, v)
            now = fixed
            if len(seen) >= warm_up:
                now = []
                for q in cum:
                    at = q * (len(seen) - 1)
                    low = int(at)
                    high = min(low + 1, len(seen) - 1)
                    now.append(seen[low] if seen[low] == seen[high] else (low + 1 - at) * seen[low] + (at - low) * seen[high])
            codes.append(sum(t < v for t in now))
        return pa.table({"ticker": table["ticker"], "rn": table["rn"].cast(pa.int64()), "code": pa.array(codes, pa.int32())})

    found = df.select("ticker", "rn", F.col(value).cast("double").alias("v")).groupBy("ticker").applyInArrow(run, "ticker string, rn long, code int")
    return df.join(found.select("ticker", "rn", F.col("code").alias(out)), ["ticker", "rn"], "left")


def with_runs(df: DataFrame, value: str, out: str = "run") -> DataFrame:
    """Adds ``out`` (number of the run of equal values) and ``out_len`` (bars of it so far)."""
    changed = F.coalesce((~F.col(value).eqNullSafe(lag(F.col(value)))).cast("int"), F.lit(1))
    df = df.withColumn(out, F.sum(F.when(F.col("rn") == 0, 1).otherwise(changed)).over(by_bar().rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(f"{out}_len", F.row_number().over(Window.partitionBy("ticker", out).orderBy("rn")))


def with_stability(df: DataFrame, window: int, regime: str = "regime") -> DataFrame:
    """Adds ``regime_stable``: the same label for at least ``window`` bars."""
    if window <= 1:
        return df.withColumn("regime_stable", F.col(regime).isNotNull())
    return with_runs(df, regime, "__run").withColumn("regime_stable", F.col(regime).isNotNull() & (F.col("__run_len") >= window)).drop("__run", "__run_len")


def distribution(df: DataFrame, labels: tuple[str, ...] = LABELS, regime: str = "regime") -> DataFrame:
    """``(ticker, regime, n, share)`` with every label of every ticker."""
    spine = df.select("ticker").distinct().select("ticker", F.explode(F.array(*map(F.lit, labels))).alias("regime"))
    n = df.where(F.col(regime).isNotNull()).groupBy("ticker", F.col(regime).alias("regime")).agg(F.count("*").alias("n"))
    out = spine.join(n, ["ticker", "regime"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ticker")), 4))


def regime_table(df: DataFrame) -> DataFrame:
    """Lookup by ticker and time."""
    return df.select("ticker", "open_dt", "regime", "regime_stable")


@dataclass(frozen=True)
class EmaRegime:
    """The built-in classifier."""

    source: str = "close"
    short: int = 9
    long: int = 25
    mode: str = "fixed"  # fixed, balanced or expanding
    stable_window: int = 12

    def labels(self) -> tuple[str, ...]:
        return LABELS

    def classify(self, bars: DataFrame) -> DataFrame:
        if self.source not in bars.columns:
            raise KeyError(f"no column {self.source!r}")
        df = with_ema_ratio(bars, self.source, self.short, self.long)
        if self.mode == "expanding":
            df = with_expanding_code(df, "ema_ratio", "regime_code")
        elif self.mode == "balanced":
            df = df.join(balanced_thresholds(df, "ema_ratio"), "ticker")
            df = df.withColumn("regime_code", bucket(F.col("ema_ratio"), [F.get("thresholds", i) for i in range(len(THRESHOLDS))])).drop("thresholds")
        else:
            df = df.withColumn("regime_code", bucket(F.col("ema_ratio"), THRESHOLDS))
        return with_stability(df.withColumn("regime", label(F.col("regime_code"))), self.stable_window)


# --- memory of prices --------------------------------------------------------------------------------


def log_price(source: str = "close") -> Column:
    return F.when(F.col(source) > 0, F.log(source))


def half_life(slope: Column, n: Column) -> Column:
    """Ornstein-Uhlenbeck half-life from the regression slope; null unless it reverts within ``n`` bars."""
    h = F.when((slope < 0) & (slope > -1), -math.log(2) / F.log1p(slope))
    return F.when(h <= n, h)


def ou_half_life(bars: DataFrame, source: str = "close") -> DataFrame:
    """``(ticker, slope, half_life)`` over all bars."""
    p = bars.withColumn("p", log_price(source)).withColumn("before", lag(F.col("p"))).withColumn("d", F.col("p") - F.col("before"))
    out = p.groupBy("ticker").agg(F.regr_slope("d", "before").alias("slope"), F.count("p").alias("n"))
    return out.select("ticker", "slope", half_life(F.col("slope"), F.col("n")).alias("half_life"))


def rolling_half_life(bars: DataFrame, window: int, stride: int, source: str = "close") -> DataFrame:
    """``(ticker, rn, half_life)`` of windows of ``window`` prices that end ``stride`` bars apart."""
    p = bars.withColumn("p", log_price(source)).withColumn("before", lag(F.col("p"))).withColumn("d", F.col("p") - F.col("before"))
    w = trailing(window - 1)
    p = p.withColumn("slope", F.when(F.count("d").over(w) >= window - 1, F.regr_slope("d", "before").over(w)))
    ends = p.where((F.col("rn") >= window - 1) & ((F.col("rn") - (window - 1)) % stride == 0))
    return ends.select("ticker", "rn", half_life(F.col("slope"), F.lit(window)).alias("half_life"))


def variance_ratio(bars: DataFrame, lags: tuple[int, ...], source: str = "close") -> DataFrame:
    """``(ticker, lag, ratio)``: variance of ``k``-bar sums of log returns over ``k`` times that of one bar."""
    r = bars.withColumn("r", log_price(source) - lag(log_price(source)))
    wide = r.select("ticker", "r", *(full(F.col("r"), k, F.sum).alias(f"s{k}") for k in lags))
    sums = wide.groupBy("ticker").agg(F.var_samp("r").alias("v"), *(F.var_samp(f"s{k}").alias(f"v{k}") for k in lags))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), ratio(F.col(f"v{k}"), k * F.col("v")).alias("ratio")) for k in lags)))
    return sums.select("ticker", each.alias("x")).select("ticker", "x.lag", "x.ratio")


def dfa_hurst(r, least: int = 8, most: int | None = None) -> float | None:
    """Hurst exponent by detrended fluctuation analysis of a numpy array of returns; None below three scales."""
    import numpy as np

    r = r[np.isfinite(r)]
    most = most or len(r) // 4
    if len(r) < 2 * least or most <= least:
        return None
    profile = np.cumsum(r - r.mean())
    scales, flucts = [], []
    for n in np.unique(np.round(np.logspace(np.log10(least), np.log10(most), 20)).astype(int)):
        k = len(profile) // n
        if n < 4 or k < 1:
            continue
        y = profile[: k * n].reshape(k, n)
        t = np.arange(n) - (n - 1) / 2
        slope = (y * t).sum(axis=1) / (t * t).sum()
        rest = y - y.mean(axis=1, keepdims=True) - slope[:, None] * t
        f = float(np.sqrt((rest * rest).mean()))
        if f > 0:
            scales.append(n)
            flucts.append(f)
    if len(scales) < 3:
        return None
    return float(np.polyfit(np.log(scales), np.log(flucts), 1)[0])


def hurst(bars: DataFrame, source: str = "close") -> DataFrame:
    """``(ticker, hurst)``; the log-log fit has no relational form, so each ticker's returns go to numpy."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("rn")[source].to_numpy(float)
        h = dfa_hurst(np.diff(np.log(p[p > 0])))
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "hurst": [h]}).astype({"hurst": float})

    return bars.select("ticker", "rn", source).groupBy("ticker").applyInPandas(run, "ticker string, hurst double").withColumn("hurst", F.nanvl("hurst", F.lit(None).cast("double")))


def rolling_hurst(bars: DataFrame, window: int, stride: int, source: str = "close") -> DataFrame:
    """``(ticker, rn, hurst)``; every window is its own small group, so one ticker spreads over many tasks."""
    import numpy as np
    import pandas as pd

    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (window - 1)) / stride))
    sent = bars.select("ticker", "rn", source).withColumn("w", F.explode(F.sequence(first.cast("long"), F.floor(F.col("rn") / stride).cast("long"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn")
        h = dfa_hurst(np.diff(np.log(pdf[source].to_numpy(float)))) if len(pdf) == window else None
        return pd.DataFrame({"ticker": [pdf["ticker"].iloc[0]], "rn": [int(pdf["rn"].iloc[-1])], "hurst": [np.nan if h is None else h], "n": [len(pdf)]})

    out = sent.groupBy("ticker", "w").applyInPandas(run, "ticker string, rn long, hurst double, n int")
    return out.where(F.col("n") == window).select("ticker", "rn", F.when(~F.isnan("hurst"), F.col("hurst")).alias("hurst"))


def derive_ema_windows(bars: DataFrame, *, window: int, stride: int, fast_ratio: float = 0.36, least: int = 3, fixed: tuple[int, int] = (9, 25)) -> DataFrame:
    """``(ticker, short, long)``: long is the median rolling half-life; the fixed pair if estimates are few or do not order."""
    h = rolling_half_life(bars, window, stride).groupBy("ticker").agg(F.percentile("half_life", F.lit(0.5)).alias("m"), F.count("half_life").alias("n"))
    long = F.greatest(F.round("m").cast("int"), F.lit(2))
    short = F.greatest(F.round(F.col("m") * fast_ratio).cast("int"), F.lit(1))
    ok = F.coalesce((F.col("n") >= least) & (short < long), F.lit(False))
    return h.select("ticker", F.when(ok, short).otherwise(fixed[0]).alias("short"), F.when(ok, long).otherwise(fixed[1]).alias("long"))


def suggest_ema_windows(bars: DataFrame, timeframe: str = "1h", *, window_hours: float = 168.0, stride_hours: float = 24.0, fast_ratio: float = 1 / 2.3) -> DataFrame:
    """``(ticker, half_life, half_life_hours, short, long, estimates, hurst)``: what the local half-lives of a ticker suggest.

    Tickers without a mean-reverting window have null windows.
    """
    window, stride = hours_to_bars(window_hours, timeframe), hours_to_bars(stride_hours, timeframe)
    h = rolling_half_life(bars, window, stride).groupBy("ticker").agg(F.percentile("half_life", F.lit(0.5)).alias("half_life"), F.count("half_life").alias("estimates"))
    long = F.greatest(F.round("half_life").cast("int"), F.lit(2))
    memory = rolling_hurst(bars, window, stride).groupBy("ticker").agg(F.round(F.percentile("hurst", F.lit(0.5)), 3).alias("hurst"))
    out = h.join(memory, "ticker", "left").withColumn("half_life_hours", F.round(F.col("half_life") * timeframe_hours(timeframe), 1))
    some = F.col("half_life").isNotNull()
    return out.select("ticker", "half_life", "half_life_hours", F.when(some, F.greatest(F.round(F.col("half_life") * fast_ratio).cast("int"), F.lit(1))).alias("short"), F.when(some, long).alias("long"), "estimates", "hurst")


def timeframe_hours(timeframe: str) -> float:
    """``15m``, ``4h``, ``1d``, ``1w`` in hours."""
    n, unit = int(timeframe[:-1]), timeframe[-1].lower()
    return n * {"m": 1 / 60, "h": 1.0, "d": 24.0, "w": 168.0}[unit]


def hours_to_bars(hours: float, timeframe: str) -> int:
    return max(1, round(hours / timeframe_hours(timeframe)))


def transitions(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Bars whose regime differs from the one before, and how long that had lasted."""
    runs = with_runs(df.where(F.col(regime).isNotNull()), regime, "run")
    before, length = F.lag(regime).over(by_bar()), F.lag("run_len").over(by_bar())
    return runs.withColumn("regime_from", before).withColumn("bars_before", length).where(F.col("regime_from").isNotNull() & (F.col(regime) != F.col("regime_from"))).select("ticker", "rn", "open_dt", "regime_from", F.col(regime).alias("regime_to"), "bars_before")


def acf(bars: DataFrame, lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24), source: str = "close") -> DataFrame:
    """``(ticker, lag, acf)``: correlation of one-bar returns with themselves ``k`` bars earlier."""
    r = bars.withColumn("r", ratio(F.col(source), lag(F.col(source))) - 1)
    wide = r.select("ticker", "r", *(lag(F.col("r"), k).alias(f"l{k}") for k in lags)).groupBy("ticker").agg(*(F.corr("r", f"l{k}").alias(f"c{k}") for k in lags))
    return wide.select("ticker", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("acf")) for k in lags))).alias("x")).select("ticker", "x.lag", "x.acf")
