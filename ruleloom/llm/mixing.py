"""Mixing sources to target weights by a low-discrepancy schedule, as DataFrame operations only.

Slot ``i`` of the schedule lies at ``frac((i + 1) / golden ratio)``; the source in
whose share of the cumulative targets the point falls owns the slot.  The slots
of a source are ranked, and slot ``r`` takes block ``r`` of the source's stream:
its documents in the order of a keyed hash, repeated, cut into blocks of equal
tokens.  The schedule alone decides how many blocks a source gives and at which
places; as the points spread evenly, each source comes within a few blocks of its
target.  A stream ends after ``repeat`` rounds, so a source uses every document
twice at most.

Running sums go in two levels, over sources (ranges of their order, then within
one range) and over the documents of a source (buckets of the shuffle key, then
within one bucket), so no task holds all sources or a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm import scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2
#: A block has this many words, or more where the schedule would have over ``MOST_SLOTS`` slots.
LEAST_BLOCK = 64
MOST_SLOTS = 1 << 22
GOLDEN = (math.sqrt(5.0) - 1.0) / 2.0
SLOT_CHUNK = 4096
CELL_SLOTS = 1024
BUCKET_ROWS = 512
RANGE_SOURCES = 1 << 16


def n_words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums of some columns over all rows that come before each in a total order."""
    unordered = scratch.cut(rows, "unordered")
    parts = max(1, -(-unordered.count() // RANGE_SOURCES))
    rows = scratch.cut(unordered.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    scratch.drop(unordered)
    each = rows.groupBy("__part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    each = each.select("__part", *(F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(F.broadcast(each), "__part")
    total = {k: F.col(f"__{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}
    return found.select(*rows.drop("__part").columns, *(c.alias(k) for k, c in total.items()))


def _by_name() -> list[Column]:
    """Sources in code-point order, null last."""
    return [F.col("source").isNull(), F.col("source").cast("binary")]


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """``(source, source_size, place, weight, target)`` from ``(source, source_size)``, one row per source.

    Sources in code-point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes; a target stops at ``repeat`` times its source's
    size, and the excess goes to the others by weight until none is above.  That
    is the water level ``x`` with ``sum(min(repeat * size, weight * x)) = total``,
    found by running sums over the sources in the order in which they fill up.
    """
    rows = _before(sizes.select("source", "source_size"), _by_name(), {"place": F.lit(1)})
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights)))
    rows = rows.withColumn("cap", F.col("source_size") * float(repeat)).withColumn("fills", F.col("cap") / F.col("weight"))
    rows = _before(rows, [F.col("fills"), F.col("place")], {"filled": F.col("cap"), "lighter": F.col("weight")})
    whole = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, heavy = (whole["size"] or 0) * share, whole["weight"] or 0.0
    # the level if all before are full and this one and all later are not; the first for which that holds is the highest
    level = (F.lit(total) - F.col("filled")) / (F.lit(heavy) - F.col("lighter"))
    found = rows.select(level.alias("level"), "fills").where("level <= fills").agg(F.max("level").alias("level")).first()["level"]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.col("weight") * F.lit(found))
    return rows.select("source", "source_size", "place", "weight", target.alias("target"))


def block_size(words: int) -> int:
    """Words in a block where all targets together are ``words``."""
    return max(LEAST_BLOCK, words // MOST_SLOTS)


def schedule(targets: DataFrame, *, block_tokens: int | None = None) -> DataFrame:
    """``(place, block, position, block_tokens)``: one row for each slot, that is for each block that the mix takes.

    There are as many slots as blocks in all targets, rounded up.  Golden-ratio
    points are mapped through the cumulative targets and ranked per source.  The
    points and the sources meet in cells of the cumulative scale: in each cell both are
    sorted, and a point belongs to the last source that begins at or before it.
    """
    spark = targets.sparkSession
    rows = targets.select("source", "place", F.floor("target").alias("quota")).where("quota > 0")
    rows = scratch.cut(_before(rows, _by_name(), {"low": F.col("quota")}).select("place", "low", "quota"), "quotas")
    total = rows.agg(F.sum("quota").alias("n")).first()["n"] or 0
    block = block_tokens or block_size(total)
    n = -(-total // block)
    cells, scale = max(1, n // CELL_SLOTS), float(max(total, 1))
    cell = lambda x: F.floor(x / scale * cells)
    slots = spark.range(n).select(F.col("id").alias("position"), ((F.col("id") + 1.0) * GOLDEN % 1.0 * float(total)).alias("at"))
    slots = slots.select(cell(F.col("at")).alias("cell"), "at", "position", F.lit(None).cast("long").alias("begins"))
    reach = F.sequence(cell(F.col("low")), cell(F.col("low") + F.col("quota")))
    shares = rows.select(F.explode(reach).alias("cell"), F.col("low").cast("double").alias("at"), F.lit(-1).cast("long").alias("position"), F.col("place").alias("begins"))
    so_far = Window.partitionBy("cell").orderBy("at", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = slots.union(shares).withColumn("place", F.last("begins", ignorenulls=True).over(so_far)).where("begins is null")
    owned = scratch.cut(owned.select("place", "position", F.expr(f"position div {SLOT_CHUNK}").alias("chunk")), "slots")
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = owned.groupBy("place", "chunk").agg(F.count("*").alias("n")).select("place", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = owned.withColumn("r", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("position")) - 1)
    return ranked.join(before, ["place", "chunk"]).select("place", (F.col("r") + F.col("before")).alias("block"), "position", F.lit(block).cast("long").alias("block_tokens"))


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, block_tokens: int | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, taken_by_pass, first_position, last_position.

    ``taken`` is the number of words that the mix takes of the document over all
    passes; ``taken_by_pass`` splits it; ``first_position`` and ``last_position`` are
    the places in the schedule of the first and the last block that hold any of it
    (null if none is taken).

    Defined cases: a null or blank text has size 0 and nothing is taken; a null
    source is a source, last in order; a source of size 0 has target 0; rows that
    repeat one id follow each other in the stream; a text longer than a block, or
    than a whole source's target, is taken in part; an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    rows = rows.withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = scratch.cut(rows.groupBy("doc_id", "source", "size", "shuffle").agg(F.count("*").alias("copies")), "sizes")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("double") / 4294967296.0 * buckets)
    rows = rows.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("copies"))
    per_bucket = scratch.cut(rows.groupBy("source", "bucket").agg(F.sum("words").alias("words")), "buckets")
    sizes = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = scratch.cut(source_targets(sizes, weights=weights, share=share, repeat=repeat), "targets")
    slots = scratch.cut(schedule(targets, block_tokens=block_tokens), "schedule")
    given = slots.groupBy("place").agg((F.count("*") * F.first("block_tokens")).alias("length"), F.first("block_tokens").alias("block_tokens"))
    known = targets.join(given, "place", "left").withColumn("length", F.coalesce("length", F.lit(0))).withColumn("block_tokens", F.coalesce("block_tokens", F.lit(1)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.withColumnRenamed("source", "s").join(known, F.col("s").eqNullSafe(F.col("source"))).drop("s")

    # documents meet their source's figures by bucket, so that a hot source is many keys
    r, s = rows.alias("r"), starts.alias("s")
    placed = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    placed = placed.select("r.*", "s.start", "s.place", "s.source_size", "s.target", "s.length", "s.block_tokens")
    inside = Window.partitionBy("place", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0)))
    every = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("begin", F.expr("begin + copy * size")).drop("copies", "words", "start", "shuffle", "bucket")

    # a row for each pass and block that a document touches; its place in the stream is begin + turn * source_size
    parts = every.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    parts = parts.withColumn("from", F.expr("turn * source_size + begin")).withColumn("to", F.least(F.col("from") + F.col("size"), "length")).where("to > from")
    parts = parts.withColumn("block", F.explode(F.expr("sequence(from div block_tokens, (to - 1) div block_tokens)")))
    parts = parts.withColumn("words", F.expr("least(to, (block + 1) * block_tokens) - greatest(from, block * block_tokens)"))
    got = parts.select("doc_id", "place", "begin", "turn", "words", "block").join(slots.select("place", "block", "position"), ["place", "block"])
    by_pass = [F.sum(F.when(F.col("turn") == i, F.col("words")).otherwise(0)).alias(f"__t{i}") for i in range(repeat)]
    ends = [F.min("position").alias("first_position"), F.max("position").alias("last_position")]
    got = got.groupBy(F.col("place").alias("p"), F.col("begin").alias("b")).agg(F.sum("words").alias("taken"), *ends, *by_pass)  # words of one document begin at one place
    out = every.join(got, (F.col("place") == F.col("p")) & (F.col("begin") == F.col("b")) & (F.col("size") > 0), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    passes = F.array(*(zero(f"__t{i}") for i in range(repeat)))
    return out.select("doc_id", "source", "size", "source_size", "target", zero("taken").alias("taken"), passes.alias("taken_by_pass"), "first_position", "last_position")


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` takes it, all columns as they are.

    A pass that takes at least half of a document's words takes the document; so
    whole texts pass, and each source misses its target by less than a document
    per pass and a few blocks.

    Defined cases: rows without words (null and blank texts) are taken once, as they
    count for no source; rows alike in id, source and size are taken in the order of
    their text and other columns; very long texts go whole or not; an empty table
    gives an empty result; columns may have any names.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    halves = F.aggregate("taken_by_pass", F.lit(0), lambda n, w: n + F.when(2 * w >= F.col("size"), 1).otherwise(0))
    times = F.when(F.col("size") == 0, 1).otherwise(halves)
    key = lambda i, s, n: F.concat_ws("|", F.coalesce(i.cast("long").cast("string"), F.lit("-")), n.cast("string"), F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("")))
    # one row per key: its copies, where alike are taken alike but at the end of a pass
    keyed = taken.select(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("key"), times.alias("times"))
    keyed = keyed.groupBy("key", "times").agg(F.count("*").alias("n")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("less"), "n"))).alias("runs"))  # at most repeat + 1 each
    own = docs.select(key(F.col(id_col), F.col(source_col), n_words(F.col(text_col))).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.join(keyed, "key")
    order = Window.partitionBy("key").orderBy(F.col(f"row.`{text_col}`"), F.to_json("row"))
    own = own.withColumn("r", F.when(F.size("runs") > 1, F.row_number().over(order)).otherwise(1))
    # the run in which the r-th row of the key falls
    found = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("times")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((F.col("r") > a["seen"]), -x["less"]).otherwise(a["times"]).alias("times")))
    return own.withColumn("times", found["times"]).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
