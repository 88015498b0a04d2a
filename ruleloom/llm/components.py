"""Connected components by alternating large and small stars, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import scratch


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``(a, b)`` edges of longs to ``(cid, root)``, root the least node of the component.

    Nodes without edges do not appear.  Every round is a grouped minimum and an
    equi-join, and is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct()
    edges, before = scratch.cut(edges, "edges"), None
    for _ in range(rounds):
        around = _symmetric(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        last, edges = edges, scratch.cut(small.where("a <> b").distinct(), "edges")
        scratch.drop(last)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("b").distinct().select(F.col("b").alias("cid"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("root")).union(roots)
