"""Episodes, monthly consistency, and diversity of events.

Activations are a long table: a row per active bar of an event.  Bars have a month;
a gate's denominators count the months that have bars.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95, Z95_TWO_SIDED = 1.6448536269514722, 1.959963984540054


@dataclass(frozen=True)
class GateParams:
    min_tpm: float = 0.5
    max_dispersion: float = 1.5
    margin: float = 1.3
    counting: str = "episode"  # episode or bar
    min_episodes: int = 10
    gap: int = 1
    mode: str = "floor"  # floor or ranged
    tolerance: float | None = None

    def __post_init__(self):
        if self.mode == "ranged" and self.counting == "bar":
            raise ValueError("a ranged rate is defined for episodes only")


def month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def with_episodes(active: DataFrame, gap: int = 1, *keys: str) -> DataFrame:
    """Adds ``starts`` (first bar of an episode) and ``episode`` (its number from 0) to active bars.

    An episode bridges up to ``gap`` inactive bars.
    """
    w = Window.partitionBy(*(keys or ("ticker", "event_id"))).orderBy("rn")
    before = F.lag("rn").over(w)
    out = active.withColumn("starts", before.isNull() | (F.col("rn") - before - 1 > gap))
    return out.withColumn("episode", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def concurrency(trades: DataFrame, *keys: str, opened: str = "fill_rn", closed: str = "exit_rn") -> DataFrame:
    """Per key: mean open positions over occupied bars, peak, occupied bars, position bars, effective trades.

    A sweep over the bars where the count changes, so the work follows the trades, not their length.
    """
    keys = keys or ("ticker",)
    steps = trades.select(*keys, F.explode(F.array(F.struct(F.col(opened).alias("rn"), F.lit(1).alias("d")), F.struct((F.col(closed) + 1).alias("rn"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*keys, F.col("x.rn").alias("rn")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("rn")
    steps = steps.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bars", F.lead("rn").over(w) - F.col("rn"))
    out = steps.where("open > 0").groupBy(*keys).agg(F.max("open").alias("peak"), F.sum("bars").alias("occupied"), F.sum(F.col("open") * F.col("bars")).alias("position_bars"))
    n = trades.groupBy(*keys).agg(F.count("*").alias("trades"))
    return out.join(n, list(keys)).withColumn("mean_open", F.col("position_bars") / F.col("occupied")).withColumn("effective_trades", F.col("trades") / F.col("mean_open"))


def months_of(bars: DataFrame) -> DataFrame:
    """``(ticker, month, month_index)`` of the months that have bars."""
    m = bars.select("ticker", month(F.col("open_dt")).alias("month")).distinct()
    return m.withColumn("month_index", F.dense_rank().over(Window.partitionBy("ticker").orderBy("month")) - 1)


def monthly_counts(active: DataFrame, bars: DataFrame, gap: int = 1) -> DataFrame:
    """``(ticker, event_id, month, bars, episodes)`` of every event and month with bars, zeros included."""
    a = with_episodes(active, gap).withColumn("month", month(F.col("open_dt")))
    counted = a.groupBy("ticker", "event_id", "month").agg(F.count("*").alias("bars"), F.sum(F.col("starts").cast("long")).alias("episodes"))
    spine = active.select("ticker", "event_id").distinct().join(months_of(bars).select("ticker", "month"), "ticker")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return spine.join(counted, ["ticker", "event_id", "month"], "left").select("ticker", "event_id", "month", zero("bars"), zero("episodes"))


def chi2_95(df: Column) -> Column:
    """95th percentile of chi-square by the Wilson-Hilferty cube."""
    t = 2.0 / (9.0 * df)
    return df * F.pow(1.0 - t + Z95 * F.sqrt(t), F.lit(3.0))


def dispersion_limit(months: Column, margin: float) -> Column:
    """Largest index of dispersion that a random process of the same rate would show, with a margin."""
    return F.when(months > 1, chi2_95(F.greatest(months - 1, F.lit(1))) / F.greatest(months - 1, F.lit(1)) * margin).otherwise(0.0)


def gate_metrics(active: DataFrame, bars: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """One row per event: rates, dispersions, concentration, effective sample and the gate's limits."""
    m = monthly_counts(active, bars, p.gap).groupBy("ticker", "event_id").agg(
        F.count("*").alias("n_months"),
        F.sum("bars").alias("n_activations"),
        F.sum((F.col("bars") > 0).cast("long")).alias("n_active_months"),
        F.max("bars").alias("__most"),
        F.avg("bars").alias("mean_tpm"),
        F.var_samp("bars").alias("__var"),
        F.sum("episodes").alias("n_episodes"),
        F.avg("episodes").alias("episode_tpm"),
        F.var_samp("episodes").alias("__evar"),
    )
    several = F.col("n_months") > 1
    m = m.withColumn("max_monthly_share", F.col("__most") / F.col("n_activations"))
    m = m.withColumn("dispersion", F.when(several & (F.col("n_activations") > 0), F.col("__var") / F.col("mean_tpm")).otherwise(0.0))
    m = m.withColumn("episode_dispersion", F.when(several & (F.col("n_episodes") > 0), F.col("__evar") / F.col("episode_tpm")))
    m = m.withColumn("n_eff", F.when(F.col("episode_dispersion") > 0, F.col("n_episodes") / F.col("episode_dispersion")).when(F.col("episode_dispersion") == 0, F.col("n_episodes").cast("double")))
    m = m.withColumn("limit", dispersion_limit(F.col("n_months"), p.margin))
    half = F.lit(p.tolerance) if p.tolerance is not None else Z95_TWO_SIDED * F.sqrt(F.col("limit") * p.min_tpm / F.col("n_months"))
    return m.withColumn("tpm_low", F.greatest(F.lit(0.0), p.min_tpm - half)).withColumn("tpm_high", p.min_tpm + half).drop("__most", "__var", "__evar")


def gate(active: DataFrame, bars: DataFrame, p: GateParams = GateParams()) -> DataFrame:
    """Metrics with ``passed`` and the first failing criterion as ``fail_reason``."""
    m = gate_metrics(active, bars, p)
    bursty = F.coalesce(F.col("episode_dispersion") > F.col("limit"), F.lit(False))
    if p.counting == "bar":
        fails = [("rate", F.col("mean_tpm") < p.min_tpm), ("dispersion", F.col("dispersion") > p.max_dispersion)]
    elif p.mode == "ranged":
        outside = (F.col("n_episodes") == 0) | (F.col("episode_tpm") < F.col("tpm_low")) | (F.col("episode_tpm") > F.col("tpm_high"))
        fails = [("rate", outside), ("episodes", F.col("n_episodes") < p.min_episodes), ("episode dispersion", bursty)]
    else:
        fails = [("rate", F.col("episode_tpm") < p.min_tpm), ("episodes", F.col("n_episodes") < p.min_episodes), ("episode dispersion", bursty)]
    reason = F.coalesce(*(F.when(c, F.lit(k)) for k, c in fails))
    return m.withColumn("fail_reason", reason).withColumn("passed", F.col("fail_reason").isNull())


def zero_months(active: DataFrame, bars: DataFrame) -> DataFrame:
    """``(ticker, event_id, zero_months)``: calendar months between first and last bar without activation."""
    span = bars.groupBy("ticker").agg(F.min(month(F.col("open_dt"))).alias("a"), F.max(month(F.col("open_dt"))).alias("b"))
    used = active.groupBy("ticker", "event_id").agg(F.count_distinct(month(F.col("open_dt"))).alias("used"))
    return used.join(span, "ticker").select("ticker", "event_id", (F.col("b") - F.col("a") + 1 - F.col("used")).alias("zero_months"))


def survival(gated: DataFrame) -> DataFrame:
    """How many events pass, the medians of the gate's quantities, and the share of each reason to fail."""
    half = lambda c: F.percentile(c, F.lit(0.5)).alias(f"median_{c}")
    share = lambda r: F.avg(F.coalesce((F.col("fail_reason") == r).cast("double"), F.lit(0.0))).alias("share_" + r.replace(" ", "_"))
    out = gated.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("n_passed"), half("episode_tpm"), half("n_episodes"), half("episode_dispersion"), share("rate"), share("episodes"), share("episode dispersion"))
    return out.withColumn("low_survival", F.col("n_passed") < 0.15 * F.col("n"))


def overlaps(active: DataFrame, least: float = 0.0) -> DataFrame:
    """``(ticker, a, b, jaccard)`` of events that share a bar, ``a < b`` by name.

    A bar's active events are paired, so the work is the shared activations; events
    that never meet do not appear.
    """
    n = active.groupBy("ticker", "event_id").agg(F.count("*").alias("n"))
    x, y = active.alias("x"), active.alias("y")
    same = (F.col("x.ticker") == F.col("y.ticker")) & (F.col("x.rn") == F.col("y.rn")) & (F.col("x.event_id") < F.col("y.event_id"))
    both = x.join(y, same).groupBy(F.col("x.ticker").alias("ticker"), F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b")).agg(F.count("*").alias("shared"))
    size = lambda k, v: n.select("ticker", F.col("event_id").alias(k), F.col("n").alias(v))
    out = both.join(size("a", "na"), ["ticker", "a"]).join(size("b", "nb"), ["ticker", "b"])
    out = out.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return out.where(F.col("jaccard") >= least).select("ticker", "a", "b", "shared", "na", "nb", "jaccard")


def diversity(active: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``(ticker, i, event_id)``: greedy by falling activations, an event stays if it overlaps no kept one by ``threshold`` or more.

    Only pairs that overlap that much are gathered, those of a ticker in one task; ``i`` is the order of choice.
    """
    sizes = active.groupBy("ticker", "event_id").agg(F.count("*").alias("n"))
    near = overlaps(active, threshold).select("ticker", "a", "b")
    both = near.union(near.select("ticker", "b", "a")).groupBy("ticker", F.col("a").alias("event_id")).agg(F.collect_set("b").alias("near"))
    rows = sizes.join(both, ["ticker", "event_id"], "left")

    def choose(table):
        import pyarrow as pa

        kept: list[str] = []
        chosen: set[str] = set()
        for _, event, near in sorted(zip([-n for n in table["n"].to_pylist()], table["event_id"].to_pylist(), table["near"].to_pylist()), key=lambda x: x[:2]):
            if chosen.isdisjoint(near or ()):
                kept.append(event)
                chosen.add(event)
        return pa.table({"ticker": [table["ticker"][0].as_py()] * len(kept), "i": pa.array(range(len(kept)), pa.int32()), "event_id": kept})

    return rows.groupBy("ticker").applyInArrow(choose, "ticker string, i int, event_id string")


def fold_validation(active: DataFrame, bars: DataFrame, first_rn: int, *, folds: int = 3, pass_rate: float = 0.6, expected: float = 3.0, p: GateParams = GateParams()) -> DataFrame:
    """Out-of-sample folds of an event: ``(ticker, event_id, testable, passed_folds, verdict)``.

    The bars from ``first_rn`` on are cut into equal folds.  A fold in which fewer than
    ``expected`` episodes are due is indeterminate.
    """
    oos = bars.where(F.col("rn") >= first_rn)
    n = F.count("*").over(Window.partitionBy("ticker"))
    fold = F.least(F.floor((F.col("rn") - first_rn) * folds / n), F.lit(folds - 1)).cast("int")
    oos = oos.withColumn("fold", fold)
    months = oos.groupBy("ticker", "fold").agg(F.count_distinct(month(F.col("open_dt"))).alias("months"))
    hits = with_episodes(active.where(F.col("rn") >= first_rn).join(oos.select("ticker", "rn", "fold"), ["ticker", "rn"]), p.gap, "ticker", "event_id", "fold")
    per = hits.groupBy("ticker", "event_id", "fold").agg(F.sum(F.col("starts").cast("long")).alias("episodes"))
    every = active.select("ticker", "event_id").distinct().join(months, "ticker").join(per, ["ticker", "event_id", "fold"], "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    due = p.min_tpm * F.col("months") >= expected
    ok = F.col("episodes") >= p.min_tpm * F.col("months")
    out = every.groupBy("ticker", "event_id").agg(F.sum(due.cast("long")).alias("testable"), F.sum((due & ok).cast("long")).alias("passed_folds"))
    verdict = F.when(F.col("testable") == 0, "indeterminate").when(F.col("passed_folds") >= pass_rate * F.col("testable"), "passed").otherwise("failed")
    return out.withColumn("verdict", verdict)


def poisson_tail(floor: int, rate: float) -> float:
    """Probability of at least ``floor`` events at a mean of ``rate``."""
    term = total = math.exp(-rate)
    for k in range(1, floor):
        term *= rate / k
        total += term
    return 1.0 - total if floor > 0 else 1.0


def poisson_window(floor: int, rate: float, confidence: float = 0.95, cap: int = 600) -> int:
    """Fewest periods in which ``floor`` events of a mean rate are due with the given confidence."""
    for n in range(1, cap + 1):
        if poisson_tail(floor, rate * n) >= confidence:
            return n
    return cap
