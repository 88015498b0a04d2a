"""Backtests: parameter cells, tickers and windows are keys of one job.

A signal acts on the bar after it.  Fill and exit are the first bars of bounded
ranges that meet a price, found by exploding the range and joining on the bar
number: linear in signals times range, whatever the number of cells.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.gate import concurrency, month, with_episodes

#: Why a rule that only the rotations of the whole search explain is no full edge.
ROTATION_REASON = "search rotations"


@dataclass(frozen=True)
class Params:
    direction: str = "long"
    buy_type: str = "limit"  # limit or market
    drop: float = 0.01
    delay: int = 6
    sell: float = 0.04
    horizon: int = 24
    fee: float = 0.002
    early_stop: bool = True
    anchor: str = "close"
    target_col: str = "close"
    hit_col: str = "close"


def cells(spark: SparkSession, params: list[Params]) -> DataFrame:
    """``(cell, …)``: the grid as a small table."""
    return spark.createDataFrame([{"cell": i, **asdict(p)} for i, p in enumerate(params)]).select("cell", *Params.__dataclass_fields__)


def build_grid(base: Params, *, drop: list[float] | None = None, sell: list[float] | None = None, horizon: list[int] | None = None, delay: list[int] | None = None) -> list[Params]:
    """Product of the axes; an axis that is not given fans out around the base (limit entries alone have drops and delays)."""
    limit = base.buy_type == "limit"
    drop = drop or ([round(base.drop * f, 6) for f in (0.5, 1.0, 1.5)] if limit else [base.drop])
    sell = sell or [round(base.sell * f, 6) for f in (0.75, 1.0, 1.25)]
    horizon = horizon or sorted({max(1, round(base.horizon * f)) for f in (0.5, 1.0, 1.5)})
    delay = delay or [base.delay]
    return [replace(base, drop=d, sell=s, horizon=h, delay=w) for d, s, h, w in product(drop, sell, horizon, delay)]


def run(
    bars: DataFrame, signals: DataFrame, grid: DataFrame, *, windows: DataFrame | None = None,
    only: DataFrame | None = None, keys: tuple[str, ...] = ("ticker", "event_id"),
) -> tuple[DataFrame, DataFrame]:
    """Trade ledger and signal counts, keyed by ``keys``, cell and (with ``windows``) window.

    ``signals`` has the keys and ``rn`` of active bars, ``windows`` ``(window, from_dt, to_dt)``: the bar
    after the signal must lie in ``[from_dt, to_dt)``.  A trade without all bars up to its horizon is left out.
    With ``only``, rows of the keys, cell and window, no other combination is run.
    """
    price = bars.select("ticker", "rn", "open_dt", "open", "high", "low", "close")
    last = bars.groupBy("ticker").agg(F.max("rn").alias("last"))
    column = lambda which: F.when(F.col(which) == "open", F.col("open")).when(F.col(which) == "high", F.col("high")).when(F.col(which) == "low", F.col("low")).otherwise(F.col("close"))

    ep = with_episodes(signals.select(*keys, "rn").distinct(), 1, *keys).select(*keys, "rn", F.col("episode").alias("episode_id"))
    s = ep.join(price.select("ticker", "rn", *(F.col(c).alias(f"s_{c}") for c in ("open", "high", "low", "close"))), ["ticker", "rn"])
    nxt = price.select("ticker", (F.col("rn") - 1).alias("rn"), F.col("open").alias("next_open"), F.col("open_dt").alias("next_dt"))
    s = s.join(nxt, ["ticker", "rn"])  # a signal on the last bar cannot act
    keys = keys + ("cell",)
    own = [k for k in keys[:-1] if k in grid.columns]  # a grid may have cells of its own for each rule
    s = s.join(grid, own) if own else s.crossJoin(F.broadcast(grid))
    if windows is not None:
        s = s.join(F.broadcast(windows), (F.col("next_dt") >= F.col("from_dt")) & (F.col("next_dt") < F.col("to_dt")))
        keys = keys + ("window",)
    if only is not None:
        s = s.join(only.select(*keys).distinct(), list(keys), "left_semi")
    short = F.col("direction") == "short"
    anchor = F.when(F.col("anchor") == "open", F.col("s_open")).when(F.col("anchor") == "high", F.col("s_high")).when(F.col("anchor") == "low", F.col("s_low")).otherwise(F.col("s_close"))
    market = F.col("buy_type") == "market"
    s = s.withColumn("buy_price", F.when(market, F.col("next_open")).otherwise(anchor * F.when(short, 1.0 + F.col("drop")).otherwise(1.0 - F.col("drop"))))
    s = s.withColumn("signal_rn", F.col("rn")).drop("rn")
    counts = s.groupBy(*keys).agg(F.count("*").alias("total_signals"))

    id_ = (*keys, "signal_rn")
    reach = F.when(market, 1).otherwise(F.col("delay"))
    probe = s.withColumn("rn", F.explode(F.sequence(F.col("signal_rn") + 1, F.col("signal_rn") + F.greatest(reach, F.lit(1)))))
    probe = probe.join(price.select("ticker", "rn", "high", "low"), ["ticker", "rn"])
    met = F.when(market, F.lit(True)).when(short, F.col("high") >= F.col("buy_price")).otherwise(F.col("low") <= F.col("buy_price"))
    carried = ("episode_id", "buy_price", "direction", "sell", "horizon", "fee", "early_stop", "target_col", "hit_col")
    filled = probe.where(met).groupBy(*id_).agg(F.min("rn").alias("fill_rn"), *(F.first(c).alias(c) for c in carried))
    filled = filled.withColumn("target_rn", F.col("fill_rn") + F.col("horizon")).join(last, "ticker").where("target_rn <= last").drop("last")
    short = F.col("direction") == "short"
    filled = filled.withColumn("sell_price", F.col("buy_price") * F.when(short, 1.0 - F.col("sell")).otherwise(1.0 + F.col("sell")))

    path = filled.withColumn("rn", F.explode(F.sequence(F.col("fill_rn"), F.col("target_rn")))).join(price, ["ticker", "rn"])
    hit = F.col("early_stop") & (F.col("rn") > F.col("fill_rn")) & F.when(short, column("hit_col") <= F.col("sell_price")).otherwise(column("hit_col") >= F.col("sell_price"))
    out = path.groupBy(*id_).agg(
        F.min(F.when(hit, F.col("rn"))).alias("hit_rn"),
        F.max(F.when(F.col("rn") == F.col("target_rn"), column("target_col"))).alias("target_price"),
        F.max(F.when(F.col("rn") == F.col("fill_rn"), F.col("open_dt"))).alias("fill_dt"),
        F.min(F.when(hit, F.col("open_dt"))).alias("hit_dt"),
        F.max(F.when(F.col("rn") == F.col("target_rn"), F.col("open_dt"))).alias("target_dt"),
        F.max(F.when(F.col("rn") > F.col("fill_rn"), F.col("high"))).alias("path_high"),
        F.min(F.when(F.col("rn") > F.col("fill_rn"), F.col("low"))).alias("path_low"),
        *(F.first(c).alias(c) for c in ("fill_rn", "target_rn", "episode_id", "direction", "buy_price", "sell_price", "fee")),
    )
    target_hit = F.col("hit_rn").isNotNull()
    exit_price = F.when(target_hit, F.col("sell_price")).otherwise(F.col("target_price"))
    gain = (exit_price - F.col("buy_price")) / F.col("buy_price") * F.when(F.col("direction") == "short", -1.0).otherwise(1.0) - 2 * F.col("fee")
    ledger = out.select(*keys, "signal_rn", "fill_rn", "target_rn", F.coalesce("hit_rn", "target_rn").alias("exit_rn"), "episode_id", "fill_dt", F.when(target_hit, F.col("hit_dt")).otherwise(F.col("target_dt")).alias("exit_dt"), "direction", "buy_price", "sell_price", exit_price.alias("exit_price"), gain.alias("net_pct_gain"), target_hit.alias("target_hit"))
    return ledger, counts


def profit_factor(net: str = "net_pct_gain") -> Column:
    won, lost = F.coalesce(F.sum(F.when(F.col(net) > 0, F.col(net))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col(net) < 0, F.col(net))), F.lit(0.0))
    return F.when(lost == 0, F.when(won > 0, 9999.0).otherwise(0.0)).otherwise(won / F.nullif(lost, F.lit(0.0)))


def summarise(ledger: DataFrame, counts: DataFrame, months: DataFrame, *, keys: tuple[str, ...], least_trades: int = 10, tpm: float = 2.0, steep: float = 0.05) -> DataFrame:
    """One row per key of ``counts``: trades, rates, gains, monthly regularity and scores.

    ``months`` has ``(ticker, first_month, last_month)`` (or per window): all its calendar
    months count, those without trades as zeros.
    """
    t = ledger.withColumn("month", month(F.col("fill_dt")))
    by_month = t.groupBy(*keys, "month").agg(F.count("*").alias("m"))
    months_key = [k for k in ("ticker", "window") if k in months.columns and k in keys]
    by_month = by_month.join(months, months_key).where("month between first_month and last_month").groupBy(*keys).agg(F.count("*").alias("active_months"), F.sum("m").alias("in_months"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    agg = t.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.sum((F.col("net_pct_gain") > 0).cast("long")).alias("winning_trades"),
        F.sum((F.col("net_pct_gain") < 0).cast("long")).alias("losing_trades"),
        F.sum("net_pct_gain").alias("total_net_gain"),
        F.avg("net_pct_gain").alias("expectancy"),
        F.coalesce(F.stddev_samp("net_pct_gain"), F.lit(0.0)).alias("std_net_gain"),
        profit_factor().alias("profit_factor"),
        F.max("net_pct_gain").alias("best_trade"),
        F.min("net_pct_gain").alias("worst_trade"),
        (F.avg(F.col("target_hit").cast("double")) * 100).alias("target_hit_rate_pct"),
        F.count_distinct("episode_id").alias("n_episodes"),
    )
    out = counts.join(agg, list(keys), "left").join(by_month, list(keys), "left").join(months, months_key)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.withColumn("n_months", F.greatest(F.lit(1), F.col("last_month") - F.col("first_month") + 1))
    for c in ("total_trades", "winning_trades", "losing_trades", "n_episodes", "active_months", "in_months", "squares", "profit_factor", "total_net_gain", "std_net_gain"):
        out = out.withColumn(c, zero(c))
    out = out.withColumn("fill_rate", F.col("total_trades") / F.col("total_signals")).withColumn("win_rate", F.col("winning_trades") / F.nullif(F.col("total_trades"), F.lit(0)))
    out = out.withColumn("zero_months", F.col("n_months") - F.col("active_months")).withColumn("tpm_mu", F.col("in_months") / F.col("n_months"))
    out = out.withColumn("tpm_sigma", F.sqrt(F.greatest(F.col("squares") / F.col("n_months") - F.col("tpm_mu") * F.col("tpm_mu"), F.lit(0.0))))
    spread = F.col("tpm_sigma") * F.col("tpm_sigma") / F.nullif(F.col("tpm_mu"), F.lit(0.0))
    out = out.withColumn("c_norm", F.when(F.col("tpm_mu") > 0, F.least(F.lit(1.0), 1.0 / F.greatest(spread, F.lit(1.0)))).otherwise(0.0))
    floor = F.greatest(F.lit(float(least_trades)), F.col("n_months") * tpm)
    out = out.withColumn("pf_score", F.greatest(F.col("profit_factor") / (1.0 + F.exp(-steep * (F.col("total_trades") - floor))), F.lit(0.0)))
    out = out.withColumn("pf_score_tpm", F.greatest(F.col("profit_factor") * F.col("c_norm"), F.lit(0.0))).withColumn("exp_score_tpm", F.greatest(F.coalesce("expectancy", F.lit(0.0)) * F.col("c_norm"), F.lit(0.0)))
    out = out.withColumn("sharpe_raw", F.coalesce("expectancy", F.lit(0.0)) / F.greatest(F.col("std_net_gain"), F.lit(1e-9)))
    return out.drop("in_months", "squares", "first_month", "last_month")


def span_months(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min(month(F.col("open_dt"))).alias("first_month"), F.max(month(F.col("open_dt"))).alias("last_month"))


def overlap(ledger: DataFrame, *keys: str) -> DataFrame:
    return concurrency(ledger, *keys)


def select_best(summary: DataFrame, *keys: str, least_pf: float = 2.0, least_wr: float = 0.55, least_tpm: float = 2.0, least_score: float = 0.30, least_fill: float = 0.40) -> DataFrame:
    """The cell of largest ``pf_score_tpm``, to nine digits: of those that qualify, or of all if none does; ties to the first cell."""
    ok = (F.col("profit_factor") >= least_pf) & (F.col("win_rate") >= least_wr) & (F.col("tpm_mu") >= least_tpm) & (F.col("pf_score_tpm") >= least_score) & (F.col("fill_rate") >= least_fill)
    s = summary.withColumn("qualified", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy(F.desc("qualified"), F.desc(F.round("pf_score_tpm", 9)), "cell")
    return s.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def excursions(bars: DataFrame, ledger: DataFrame, *keys: str) -> DataFrame:
    """Largest adverse (``mae``, signed, at most 0) and favourable move of each trade over ``(fill, exit]``."""
    path = ledger.withColumn("rn", F.explode(F.sequence(F.col("fill_rn") + 1, F.col("exit_rn")))).join(bars.select("ticker", "rn", "high", "low"), ["ticker", "rn"])
    short = F.first("direction") == "short"
    m = path.groupBy(*keys, "signal_rn").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.first("buy_price").alias("p"), short.alias("short"), F.first("net_pct_gain").alias("net_pct_gain"))
    up, down = F.col("h") / F.col("p") - 1, F.col("l") / F.col("p") - 1
    worst, best = F.when(F.col("short"), -up).otherwise(down), F.when(F.col("short"), -down).otherwise(up)
    return m.select(*keys, "signal_rn", F.least(worst, F.lit(0.0)).alias("mae"), F.greatest(best, F.lit(0.0)).alias("mfe"), "net_pct_gain")


def month_splits(start: int, end: int, *, n_splits: int = 4, min_train: int = 6, train_span: int | None = None, test_span: int | None = None) -> list[tuple[int, int, int, int]]:
    """Walk-forward windows as month offsets ``(train_from, train_to, test_from, test_to)``; the last test takes the rest."""
    total = end - start
    if total <= min_train:
        return []
    usable = total - min_train
    n = min(n_splits, max(usable // test_span, 1)) if test_span else max(n_splits, 1)
    span = test_span or max(usable // n, 1)
    out = []
    for i in range(n):
        a, b = min_train + i * span, total if i == n - 1 else min(min_train + (i + 1) * span, total)
        if a >= total or b <= a:
            break
        out.append((max(0, a - train_span) if train_span else 0, a, a, b))
    return out


def longest_trade(grid: list[Params] | DataFrame) -> int:
    """Bars from a signal to the end of the longest trade of any cell."""
    if isinstance(grid, DataFrame):
        row = grid.agg(F.max("horizon").alias("h"), F.max(F.when(F.col("buy_type") == "market", 0).otherwise(F.col("delay"))).alias("d")).first()
        return (row["h"] or 0) + (row["d"] or 0) + 1
    return max(p.horizon for p in grid) + (0 if grid[0].buy_type == "market" else max(p.delay for p in grid)) + 1


def walk_windows(bars: DataFrame, grid: list[Params] | DataFrame, *, n_splits: int = 4, min_train: int = 6, embargo: int = 0, train_span: int | None = None) -> DataFrame:
    """``(window, part, from_dt, to_dt)`` of train and test parts, trains purged by the longest trade, tests embargoed."""
    spark = bars.sparkSession
    us = F.unix_micros(F.col("open_dt").cast("timestamp"))
    step = us - F.lag(us).over(Window.partitionBy("ticker").orderBy("rn"))
    a, b, delta = bars.withColumn("s", step).agg(F.min("open_dt"), F.max("open_dt"), F.percentile("s", F.lit(0.5))).first()
    import datetime as dt

    first, last = a.year * 12 + a.month - 1, b.year * 12 + b.month - 1 + 1
    at = lambda m: dt.datetime((first + m) // 12, (first + m) % 12 + 1, 1)
    purge = longest_trade(grid)
    bar = dt.timedelta(microseconds=int(delta or 0))
    rows = []
    for i, (tf, tt, ef, et) in enumerate(month_splits(first, last, n_splits=n_splits, min_train=min_train, train_span=train_span)):
        rows += [(i, "train", at(tf), max(at(tf), at(tt) - purge * bar)), (i, "test", min(at(et), at(ef) + embargo * bar), at(et))]
    return spark.createDataFrame(rows, "window int, part string, from_dt timestamp_ntz, to_dt timestamp_ntz")


def walk_forward(
    bars: DataFrame, signals: DataFrame, params: list[Params] | DataFrame, *, n_splits: int = 4, min_train: int = 6,
    embargo: int = 0, keys: tuple[str, ...] = ("ticker", "event_id"), windows: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Best cell of each train window, and its pooled out-of-sample ledger: all windows and cells in one job."""
    if windows is None:
        windows = walk_windows(bars, params, n_splits=n_splits, min_train=min_train, embargo=embargo)
    grid = params if isinstance(params, DataFrame) else cells(bars.sparkSession, params)
    at = lambda c: F.year(c) * 12 + F.month(c)
    train = windows.where("part = 'train'").drop("part")
    ledger, counts = run(bars, signals, grid, windows=train, keys=keys)
    spans = train.select("window", at(F.col("from_dt")).alias("first_month"), at(F.expr("to_dt - interval 1 microsecond")).alias("last_month"))
    best = select_best(summarise(ledger, counts, spans, keys=(*keys, "cell", "window")), *keys, "window")
    tests, _ = run(bars, signals, grid, windows=windows.where("part = 'test'").drop("part"), only=best, keys=keys)
    return best, tests


def stability(ledger: DataFrame, *keys: str) -> DataFrame:
    """Profit factors of the earlier and the later half of the trades; both below 1 fail, one is partial."""
    w = Window.partitionBy(*keys)
    half = F.row_number().over(w.orderBy("fill_rn", "signal_rn")) * 2 > F.count("*").over(w)
    t = ledger.withColumn("late", half)
    halves = t.groupBy(*keys, "late").agg(profit_factor().alias("pf"))
    out = halves.groupBy(*keys).agg(F.max(F.when(~F.col("late"), F.col("pf"))).alias("pf_early"), F.max(F.when(F.col("late"), F.col("pf"))).alias("pf_late"))
    low = (F.coalesce("pf_early", F.lit(0.0)) < 1).cast("int") + (F.coalesce("pf_late", F.lit(0.0)) < 1).cast("int")
    return out.withColumn("stability", F.when(low == 0, "PASS").when(low == 1, "PARTIAL").otherwise("FAIL"))


def regime_breakdown(ledger: DataFrame, regimes: DataFrame, *keys: str) -> DataFrame:
    """Trades by the regime of their fill bar, UNDEFINED where it has none; to be avoided: five or more and losing."""
    t = ledger.join(regimes.select("ticker", F.col("open_dt").alias("fill_dt"), "regime"), ["ticker", "fill_dt"], "left").withColumn("regime", F.coalesce("regime", F.lit("UNDEFINED")))
    out = t.groupBy(*keys, "regime").agg(F.count("*").alias("n_trades"), F.avg((F.col("net_pct_gain") > 0).cast("double")).alias("win_rate"), profit_factor().alias("profit_factor"), F.avg("net_pct_gain").alias("expectancy"), F.sum("net_pct_gain").alias("cum_gain"))
    return out.withColumn("avoid", (F.col("n_trades") >= 5) & (F.col("profit_factor") < 1.0))


def dependency(ledger: DataFrame, *keys: str) -> DataFrame:
    """One less the normalised entropy of monthly trade counts; 1 for a single month."""
    m = ledger.groupBy(*keys, month(F.col("fill_dt")).alias("m")).agg(F.count("*").alias("n"))
    m = m.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    out = m.groupBy(*keys).agg(F.count("*").alias("months"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("h"))
    return out.select(*keys, "months", F.when(F.col("months") <= 1, 1.0).otherwise(1 - F.col("h") / F.log(F.greatest(F.col("months"), F.lit(2)))).alias("dependency"))


def early_elimination(summary: DataFrame, *, tpm: float = 2.0, least_fill: float = 0.40, floor: int | None = None) -> DataFrame:
    """Adds ``reasons``: why a summary needs no further work (empty: none); ``floor`` replaces the trades due at ``tpm``."""
    floor = F.greatest(F.lit(10), F.floor(F.col("n_months") * tpm)) if floor is None else F.lit(floor)
    tests = [("trades", F.col("total_trades") < floor), ("profit factor", F.col("profit_factor") < 1.0), ("fill rate", F.col("fill_rate") < least_fill)]
    return summary.withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests))))


def decide(s: DataFrame, *, partial_pf: float = 1.5, pf: float = 2.0, wr: float = 0.55, tpm: float = 2.0, p_max: float = 0.05, active: float = 0.80, dependency_max: float = 0.30, dsr: float = 1.0, least_oos: int = 10, rotation_p_max: float = 0.05) -> DataFrame:
    """Adds ``verdict`` and ``reasons`` from a summary with ``p``, ``oos_pf``, ``dependency``, ``stability`` and ``dsr``.

    Where they are there, ``consistency`` and ``rotation_p`` can make an edge partial, and too
    few ``oos_trades``, or an ``oos_mde`` above the expectancy, leave it without a verdict.
    """
    floor = F.greatest(F.lit(10), F.floor(F.col("n_months") * tpm))
    short_span = F.col("n_months") * tpm < floor
    few = F.col("total_trades") < floor
    hard = [("in-sample profit factor", F.col("profit_factor") < partial_pf), ("trades", few & ~short_span), ("expectancy not significant", F.coalesce(F.col("p") >= p_max, F.lit(True))), ("out-of-sample profit factor", F.coalesce(F.col("oos_pf") < 1.0, F.lit(False)))]
    soft = [("profit factor", F.col("profit_factor") < pf), ("win rate", F.col("win_rate") < wr), ("active months", F.col("active_months") / F.col("n_months") < active), ("deflated Sharpe", F.coalesce(F.col("dsr") < dsr, F.lit(True))), ("stability", F.col("stability") == "FAIL"), ("regime dependency", F.coalesce(F.col("dependency") > dependency_max, F.lit(False)))]
    if "consistency" in s.columns:
        soft.append(("out-of-sample consistency", F.col("consistency") < 0.5))
    if "rotation_p" in s.columns:
        soft.append((ROTATION_REASON, F.col("rotation_p") > rotation_p_max))
    weak = F.lit(None).cast("string")
    if "oos_trades" in s.columns:
        weak = F.when(F.col("oos_trades") < least_oos, "few out-of-sample trades").when(F.col("oos_mde") > F.greatest(F.coalesce("expectancy", F.lit(0.0)), F.lit(0.0)), "out-of-sample power")
    why = lambda tests: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests)))
    s = s.withColumn("__hard", why(hard)).withColumn("__soft", why(soft))
    verdict = F.when(F.size("__hard") > 0, "NON-EDGE").when(few, "INSUFFICIENT-DATA").when(weak.isNotNull(), "INSUFFICIENT-DATA").when(F.size("__soft") > 0, "PARTIAL-EDGE").otherwise("EDGE")
    reasons = F.when(F.size("__hard") > 0, F.col("__hard")).when(few, F.array(F.lit("trades"))).otherwise(F.array_compact(F.concat(F.array(weak), F.col("__soft"))))
    return s.withColumn("verdict", verdict).withColumn("reasons", reasons).drop("__hard", "__soft")


def pick_cell(best: DataFrame, *keys: str, policy: str = "last") -> DataFrame:
    """``(*keys, cell)`` from each window's best cell: the last window's, or the one chosen most often (ties: most recently)."""
    if policy == "last":
        return best.groupBy(*keys).agg(F.max_by("cell", "window").alias("cell"))
    votes = best.groupBy(*keys, "cell").agg(F.count("*").alias("votes"), F.max("window").alias("latest"))
    return votes.groupBy(*keys).agg(F.max_by("cell", F.struct("votes", "latest")).alias("cell"))


def adopt_limit(market: DataFrame, limit: DataFrame, *keys: str, least_fill: float = 0.80, retention: float = 0.5) -> DataFrame:
    """``(*keys, adopted, failed)``: a limit entry replaces the market entry if out of sample it fills often enough, has at
    least its opportunity Sharpe ratio, and keeps ``retention`` of its gain (all of a loss).

    Both frames have ``fill_rate``, ``sharpe`` and ``total_net_gain``; ``failed`` names the first condition that does not hold.
    """
    m = market.select(*keys, F.col("sharpe").alias("m_sharpe"), F.col("total_net_gain").alias("m_gain"))
    both = m.join(limit.select(*keys, "fill_rate", "sharpe", "total_net_gain"), list(keys), "left")
    floor = F.when(F.col("m_gain") > 0, F.col("m_gain") * retention).otherwise(F.col("m_gain"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    failed = F.when(~holds(F.col("fill_rate") >= least_fill), "fill").when(~holds(F.col("sharpe") >= F.col("m_sharpe")), "sharpe").when(~holds(F.col("total_net_gain") >= floor), "net_gain")
    return both.select(*keys, failed.isNull().alias("adopted"), failed.alias("failed"))


def opportunity(ledger: DataFrame, counts: DataFrame, years: float, *keys: str) -> DataFrame:
    """``(*keys, fill_rate, sharpe, total_net_gain)``: the Sharpe ratio by the trades made per year; null without spread."""
    g = ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("net_pct_gain").alias("m"), F.stddev_samp("net_pct_gain").alias("sd"), F.sum("net_pct_gain").alias("total_net_gain"))
    sd = F.when(F.col("sd") > 1e-9 * F.greatest(F.abs("m"), F.lit(1.0)), F.col("sd"))
    g = g.withColumn("sharpe", F.when(F.col("n") >= 2, F.col("m") / sd * F.sqrt(F.col("n") / years)))
    out = counts.join(g, list(keys), "left").withColumn("fill_rate", F.coalesce("n", F.lit(0)) / F.col("total_signals"))
    return out.select(*keys, "fill_rate", "sharpe", "total_net_gain")


def seeded(contracts: DataFrame, base: Params, *, floor: float = 0.005, drops: tuple[float, ...] = (0.5, 1.0, 1.5), sells: tuple[float, ...] = (0.75, 1.0, 1.25), horizons: tuple[float, ...] = (0.5, 1.0, 1.5)) -> DataFrame:
    """A grid of its own for each contract: ``(ticker, event_id, cell, parameters)``.

    ``contracts`` has ticker, event_id, direction, h and take_profit: direction, horizon
    and take-profit (at least ``floor``, to four digits) replace those of ``base`` where
    they are there, and the axes fan out around them.
    """
    if base.buy_type == "market":
        drops = (1.0,)
    axes = [(d, x, h) for d, x, h in product(drops, sells, horizons)]
    cell = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("cell"), F.lit(d).alias("d"), F.lit(x).alias("x"), F.lit(h).alias("f")) for i, (d, x, h) in enumerate(axes)))).alias("c")
    c = contracts.select("ticker", "event_id", "direction", "h", "take_profit", cell)
    sell = F.coalesce(F.when(F.col("take_profit") > 0, F.round(F.greatest(F.lit(floor), F.col("take_profit")), 4)), F.lit(base.sell))
    horizon = F.coalesce(F.when(F.col("h") >= 0, F.col("h")), F.lit(base.horizon))
    given = {
        "direction": F.when(F.col("direction").isin("long", "short"), F.col("direction")).otherwise(base.direction),
        "drop": F.round(base.drop * F.col("c.d"), 6),
        "sell": F.round(sell * F.col("c.x"), 6),
        "horizon": F.greatest(F.lit(1), F.round(horizon * F.col("c.f")).cast("int")),
    }
    plain = asdict(base)
    return c.select("ticker", "event_id", "c.cell", *((given[k] if k in given else F.lit(v)).alias(k) for k, v in plain.items()))


def bars_per_year(bars: DataFrame) -> float:
    """By the median distance of a ticker's bars."""
    us = F.unix_micros(F.col("open_dt").cast("timestamp"))
    step = bars.select((us - F.lag(us).over(Window.partitionBy("ticker").orderBy("rn"))).alias("s")).agg(F.percentile("s", F.lit(0.5))).first()[0]
    return 365.25 * 86_400e6 / step if step else 365.25


def validation(ledger: DataFrame, trials: DataFrame | int, per_year: float, *keys: str) -> DataFrame:
    """``(*keys, trades, n_effective, t, p, sharpe, dsr, mde)`` of the expectancy of a ledger.

    Overlapping trades count as one observation, so the sample is the number of trades over
    the mean of open positions.  ``sharpe`` is annual, by the holding periods that fit in a
    year; ``dsr`` deflates it by the number of cells tried, null where that leaves nothing;
    ``mde`` is the least expectancy that the sample could confirm.
    """
    from ruleloom.functions import stats

    g = ledger.groupBy(*keys).agg(F.count("*").alias("trades"), F.avg("net_pct_gain").alias("m"), F.stddev_samp("net_pct_gain").alias("sd"), F.avg(F.col("exit_rn") - F.col("fill_rn")).alias("hold"))
    g = g.join(concurrency(ledger, *keys).select(*keys, F.greatest("effective_trades", F.lit(2.0)).alias("n_effective")), list(keys))
    g = g.join(trials, list(keys), "left") if isinstance(trials, DataFrame) else g.withColumn("trials", F.lit(trials))
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) <= 1e-12
    g = g.withColumn("t", F.when(~flat, F.col("m") / (F.col("sd") / F.sqrt("n_effective")))).withColumn("df", F.col("n_effective") - 1)
    g = stats.with_p_greater(g, "t", "df", "p").withColumn("p", F.when(F.col("trades") < 2, F.lit(None)).when(flat, F.when(F.col("m") > 0, 0.0).otherwise(1.0)).otherwise(F.col("p")))
    periods = F.greatest(F.lit(per_year) / F.greatest(F.col("hold"), F.lit(1.0)), F.lit(1.0))
    g = g.withColumn("sharpe", F.when(~flat, F.col("m") / F.col("sd") * F.sqrt(periods)))
    n = F.floor("n_effective")
    left = 1 - stats.EULER * F.log("trials") / F.nullif(F.log(n), F.lit(0.0))
    g = g.withColumn("dsr", F.when((F.col("trials") <= 1) | (n <= float(np.e)), F.col("sharpe")).when(left > 0, F.col("sharpe") * F.sqrt(left)))
    g = stats.with_t_quantile(g, 0.95, "df", "tq").withColumn("mde", F.when(flat, 0.0).otherwise(F.col("tq") * F.col("sd") / F.sqrt("n_effective")))
    return g.select(*keys, "trades", "n_effective", "t", "p", "sharpe", "dsr", "mde")


def discover(
    bars: DataFrame, signals: DataFrame, params: list[Params] | DataFrame, *, n_splits: int = 4, min_train: int = 6, embargo: int = 0,
    policy: str = "last", upstream: int = 1, tpm: float = 2.0, keys: tuple[str, ...] = ("ticker", "event_id"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts, in-sample ledger and pooled out-of-sample ledger of rules whose parameters are chosen in train windows alone.

    The published cell is the last train window's, or the consensus (``policy``).  The
    summary, validation, stability and dependency behind the verdict come from the
    selection span, which ends where the last train window does; no figure but those named
    ``oos`` reads a test window.  A rule that the first train window rules out, or the
    selection span, is no edge.  Bars too few for one window: an empty result.
    """
    from ruleloom.functions.lineage import written

    bars = written(bars.select("ticker", "rn", "open_dt", "open", "high", "low", "close"), "prices")
    signals = written(signals.select(*keys, "rn"), "signals")
    windows = written(walk_windows(bars, params, n_splits=n_splits, min_train=min_train, embargo=embargo), "windows")
    grid = written(params if isinstance(params, DataFrame) else cells(bars.sparkSession, params), "grid")
    keyed = [k for k in keys if k in grid.columns]
    tried = grid.groupBy(*keyed).agg((F.count("*") * upstream).alias("trials")) if keyed else grid.count() * upstream
    best, oos = walk_forward(bars, signals, grid, windows=windows, keys=keys)
    best, oos = written(best, "choices"), written(oos, "oos")
    span = windows.where("part = 'train'").agg(F.lit(0).alias("window"), F.min("from_dt").alias("from_dt"), F.max("to_dt").alias("to_dt"))
    chosen = pick_cell(best, *keys, policy=policy).withColumn("window", F.lit(0))
    ledger, counts = run(bars, signals, grid, windows=span, only=chosen, keys=keys)
    ledger = written(ledger.drop("window"), "trades")
    at = lambda c: F.year(c) * 12 + F.month(c)
    months = span.select("window", at(F.col("from_dt")).alias("first_month"), at(F.expr("to_dt - interval 1 microsecond")).alias("last_month"))
    summary = summarise(ledger.withColumn("window", F.lit(0)), counts, months, keys=(*keys, "cell", "window"), tpm=tpm).drop("window")

    tests = windows.where("part = 'test'").count()
    per_window = oos.groupBy(*keys, "window").agg(F.sum("net_pct_gain").alias("gain")).groupBy(*keys).agg((F.sum((F.col("gain") > 0).cast("long")) / max(tests, 1)).alias("consistency"))
    pooled = oos.groupBy(*keys).agg(F.count("*").alias("oos_trades"), profit_factor().alias("oos_pf"))
    year = bars_per_year(bars)
    confirmed = validation(oos, 1, year, *keys).select(*keys, F.col("mde").alias("oos_mde"))
    first = early_elimination(best.where("window = 0"), tpm=tpm, floor=10).select(*keys, F.col("reasons").alias("first_reasons"))
    whole = early_elimination(summary, tpm=tpm).select(*keys, F.col("reasons").alias("span_reasons"))
    s = summary
    for extra in (validation(ledger, tried, year, *keys).drop("trades"), stability(ledger, *keys).select(*keys, "stability"), dependency(ledger, *keys).select(*keys, "dependency"), per_window, pooled, confirmed, first, whole):
        s = s.join(extra, list(keys), "left")
    s = s.withColumn("oos_trades", F.coalesce("oos_trades", F.lit(0))).withColumn("oos_pf", F.coalesce("oos_pf", F.lit(0.0))).withColumn("consistency", F.coalesce("consistency", F.lit(0.0)))
    s = decide(s, tpm=tpm)
    none = F.array().cast("array<string>")
    out = F.array_distinct(F.concat(F.coalesce("first_reasons", none), F.coalesce("span_reasons", none)))
    s = s.withColumn("reasons", F.when(F.size(out) > 0, F.array_distinct(F.concat(out, "reasons"))).otherwise(F.col("reasons"))).withColumn("verdict", F.when(F.size(out) > 0, "NON-EDGE").otherwise(F.col("verdict")))
    return s.drop("first_reasons", "span_reasons"), ledger, oos
