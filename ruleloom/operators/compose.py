"""AND composition of events: pools, pair validity, orders, and the pairs themselves.

Pairs are formed by joining activations on the bar, so the work is the bars that two
events share; pairs that never meet cost nothing.
"""

from __future__ import annotations

from itertools import zip_longest

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.events import Event, event_id
from ruleloom.operators.gate import GateParams, gate

PAIR_SEED = 20260828
MAX_PAIRS, MAX_TRIPLES = 2000, 500


def event_table(spark: SparkSession, events: list[Event], grades: dict[str, str] | None = None) -> DataFrame:
    """``(idx, event_id, slot, native_col, grade)`` of single-component events."""
    rows = []
    for i, e in enumerate(events):
        c = e.components[0]
        native = c.feature.sources[0] if c.kind in ("onehot", "binary") else None
        rows.append((i, e.event_id, "|".join(c.slot), native, (grades or {}).get(e.event_id)))
    return spark.createDataFrame(rows, "idx long, event_id string, slot string, native_col string, grade string")


def pool(events: DataFrame, active: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` events of each slot by activations; ties keep their order."""
    n = active.groupBy("event_id").agg(F.count("*").alias("n_active"))
    w = Window.partitionBy("slot").orderBy(F.desc("n_active"), "idx")
    return events.join(n, "event_id").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("place")


def valid_pair(a: str = "x", b: str = "y") -> Column:
    """Different slots, and not two classes of one native column."""
    native = F.col(f"{a}.native_col") == F.col(f"{b}.native_col")
    return (F.col(f"{a}.slot") != F.col(f"{b}.slot")) & ~F.coalesce(native, F.lit(False))


def candidate_pairs(pooled: DataFrame) -> DataFrame:
    """``(ia, ib, a, b)`` of all valid pairs of pool members; the pool is small by construction."""
    x, y = pooled.alias("x"), pooled.alias("y")
    return x.join(F.broadcast(y), (F.col("x.idx") < F.col("y.idx")) & valid_pair()).select(F.col("x.idx").alias("ia"), F.col("y.idx").alias("ib"), F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b"))


def pair_order(pairs: DataFrame, seed: int = PAIR_SEED) -> Column:
    """A fixed pseudo-random order, the same on any cluster."""
    return F.xxhash64(F.lit(seed), F.col("ia"), F.col("ib"))


def numpy_order(n: int, seed: int = PAIR_SEED) -> list[int]:
    """The driver-side permutation, for lists that are there."""
    return np.random.default_rng(seed).permutation(n).tolist()


def interleave(strata: list[list]) -> list:
    """One of each list in turn."""
    gone = object()
    return [x for row in zip_longest(*strata, fillvalue=gone) for x in row if x is not gone]


def stratified_rank(stratum: str, order: Column) -> Column:
    """Place of a row in a round robin over strata: sort by (place within stratum, stratum)."""
    return F.row_number().over(Window.partitionBy(stratum).orderBy(order))


def pair_activations(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bars where both events of a pair are active: ``(ticker, event_id = a&b, a, b, rn, open_dt)``."""
    left = active.select("ticker", "rn", "open_dt", F.col("event_id").alias("a"))
    right = active.select("ticker", "rn", F.col("event_id").alias("b"))
    met = left.join(right, ["ticker", "rn"]).where("a <> b").join(pairs.select("a", "b"), ["a", "b"])
    return met.select("ticker", F.concat_ws("&", "a", "b").alias("event_id"), "a", "b", "rn", "open_dt")


def compose_pairs(active: DataFrame, bars: DataFrame, pairs: DataFrame, p: GateParams = GateParams(), *, max_jaccard: float | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Gated pairs: ``(ticker, event_id, a, b, n, jaccard, …gate, passed)`` of those with enough bars.

    The volume floor ``max(1, int(min_tpm * months))`` comes before the gate, and of the
    pairs that pass at most ``max_pairs`` stay, in the fixed pseudo-random order.
    """
    both = pair_activations(active, pairs)
    months = bars.groupBy("ticker").agg(F.count_distinct(F.year("open_dt") * 12 + F.month("open_dt")).alias("months"))
    n = both.groupBy("ticker", "event_id", "a", "b").agg(F.count("*").alias("n")).join(months, "ticker")
    n = n.where(F.col("n") >= F.greatest(F.lit(1), F.floor(p.min_tpm * F.col("months"))))
    size = active.groupBy("ticker", "event_id").agg(F.count("*").alias("m"))
    n = n.join(size.select("ticker", F.col("event_id").alias("a"), F.col("m").alias("na")), ["ticker", "a"]).join(size.select("ticker", F.col("event_id").alias("b"), F.col("m").alias("nb")), ["ticker", "b"])
    n = n.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    if max_jaccard is not None:
        n = n.where(F.col("jaccard") <= max_jaccard)
    kept = n.select("ticker", "event_id", "a", "b", "n", "jaccard")
    gated = gate(both.join(kept.select("ticker", "event_id"), ["ticker", "event_id"], "left_semi"), bars, p)
    out = kept.join(gated, ["ticker", "event_id"])
    order = F.row_number().over(Window.partitionBy("ticker", "passed").orderBy(F.xxhash64(F.lit(PAIR_SEED), "a", "b"), "event_id"))
    return out.withColumn("place", order).where(~F.col("passed") | (F.col("place") <= max_pairs)).drop("place")


def composed(events: list[Event], a: str, b: str, i: int) -> Event:
    """The event of a pair: components of both, expressions joined by AND."""
    by_id = {e.event_id: e for e in events}
    parts = by_id[a].components + by_id[b].components
    return Event(event_id(parts, i), parts, {"from": [a, b]})


def triples(events: list[Event], active: DataFrame, bars: DataFrame, pairs: DataFrame, p: GateParams = GateParams(), *, max_jaccard: float | None = None, max_triples: int = MAX_TRIPLES) -> DataFrame:
    """Gated triples: a third event of another slot joined to each pair of the volume floor; a triple appears once, by sorted members.

    ``pairs`` are those of the volume floor, whether they pass the gate or not.  Triples have the
    same floor, and of those that pass at most ``max_triples`` of each ticker stay, in the fixed pseudo-random order.
    """
    spark = active.sparkSession
    slots = event_table(spark, [e for e in events if len(e.components) == 1])
    x, y = slots.alias("x"), slots.alias("y")
    fits = x.join(y, (F.col("x.event_id") != F.col("y.event_id")) & valid_pair()).select(F.col("x.event_id").alias("member"), F.col("y.event_id").alias("c"))
    wanted = pairs.select("a", "b").distinct()
    thirds = wanted.join(fits.withColumnRenamed("member", "a"), "a").join(fits.withColumnRenamed("member", "b"), ["b", "c"]).select("a", "b", "c")
    both = pair_activations(active, wanted).join(thirds, ["a", "b"])
    met = both.join(active.select("ticker", "rn", F.col("event_id").alias("c")), ["ticker", "rn", "c"]).withColumn("members", F.array_sort(F.array("a", "b", "c")))
    met = met.select("ticker", "rn", "open_dt", "members").distinct().withColumn("event_id", F.array_join("members", "&"))
    months = bars.groupBy("ticker").agg(F.count_distinct(F.year("open_dt") * 12 + F.month("open_dt")).alias("months"))
    n = met.groupBy("ticker", "event_id", "members").agg(F.count("*").alias("n")).join(months, "ticker")
    n = n.where(F.col("n") >= F.greatest(F.lit(1), F.floor(p.min_tpm * F.col("months"))))
    if max_jaccard is not None:  # the triple against its largest member
        size = active.groupBy("ticker", "event_id").agg(F.count("*").alias("m"))
        least = n.select("ticker", "event_id", "n", F.explode("members").alias("member")).join(size.withColumnRenamed("event_id", "member"), ["ticker", "member"])
        n = n.join(least.groupBy("ticker", "event_id").agg(F.max(F.col("n") / F.col("m")).alias("share")).where(F.col("share") <= max_jaccard), ["ticker", "event_id"], "left_semi")
    gated = gate(met.join(n.select("ticker", "event_id"), ["ticker", "event_id"], "left_semi"), bars, p)
    order = F.row_number().over(Window.partitionBy("ticker", "passed").orderBy(F.xxhash64(F.lit(PAIR_SEED), "event_id"), "event_id"))
    return gated.withColumn("place", order).where(~F.col("passed") | (F.col("place") <= max_triples)).drop("place")


#: Grades that may be paired, in order, with their caps; the best are paired exhaustively.
STRATA = (("A", "A"), ("A", "B"), ("B", "B"), ("B", "C"), ("C", "C"), ("C", "D"))


def grade_pairs(pooled: DataFrame, *, cap: int = 100, exhaustive: int = 5000) -> DataFrame:
    """Valid pairs of graded events by stratum, each stratum up to its cap, deduplicated by members."""
    pairs = candidate_pairs(pooled)
    g = pooled.select("event_id", "grade")
    pairs = pairs.join(g.select(F.col("event_id").alias("a"), F.col("grade").alias("ga")), "a").join(g.select(F.col("event_id").alias("b"), F.col("grade").alias("gb")), "b")
    stratum = F.concat(F.least("ga", "gb"), F.greatest("ga", "gb"))
    caps = F.create_map(*(F.lit(x) for a, b in STRATA for x in (a + b, exhaustive if b <= "B" else cap)))
    pairs = pairs.withColumn("stratum", stratum).withColumn("most", F.try_element_at(caps, F.col("stratum"))).where("most is not null")
    pairs = pairs.withColumn("place", stratified_rank("stratum", pair_order(pairs))).where(F.col("place") <= F.col("most"))
    return pairs.dropDuplicates(["a", "b"]).select("stratum", "place", "a", "b")
