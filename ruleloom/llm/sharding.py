"""Sharding by extendible hashing, as DataFrame operations only.

The directory is indexed by the leading bits of a hash of the document id.  A
bucket whose documents exceed the byte limit splits on its next bit, and only
such a bucket does; the others keep their shorter prefix.  Depths are settled one
by one on sums per prefix, so documents are read once and each further round sees
the buckets that are still too large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import scratch

LIMIT_BYTES = 1 << 20
HASH_BITS = 60
STEP_BITS = 4


def split(codes: DataFrame, limit_bytes: int) -> DataFrame:
    """``(d, prefix, shard_bytes)`` of all shards, from ``(code, bytes)`` with one row per hash code."""
    settled: list[DataFrame] = []
    rest, last = codes.select("code", "bytes"), -1
    for d in range(HASH_BITS + 1):
        if d > last:  # sums for the next few bits
            last = min(HASH_BITS, d + STEP_BITS - 1)
            rest = scratch.cut(rest, "open")
            leaves = rest.groupBy(F.expr(f"shiftright(code, {HASH_BITS - last})").alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("codes"))
            leaves = scratch.cut(leaves, "leaves")
        at = F.expr(f"shiftright(leaf, {last - d})").alias("prefix")
        level = scratch.cut(leaves.groupBy(at).agg(F.sum("bytes").alias("shard_bytes"), F.sum("codes").alias("codes")), "level")
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("codes") == 1) | F.lit(d == HASH_BITS)
        settled.append(level.where(fits).select(F.lit(d).alias("d"), "prefix", "shard_bytes"))
        over = level.where(~fits).select("prefix")
        if over.isEmpty():
            break
        leaves = leaves.withColumn("prefix", at).join(over, "prefix", "left_semi").drop("prefix")
        if d == last:
            rest = rest.withColumn("prefix", F.expr(f"shiftright(code, {HASH_BITS - d})")).join(over, "prefix", "left_semi").select("code", "bytes")
    return reduce(DataFrame.union, settled)


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row per input row: doc_id, bytes, depth, shard, shard_bytes, oversized.

    ``shard`` is the bucket's prefix in binary digits (empty while one bucket
    holds everything); ``depth`` its length.  No shard exceeds ``limit_bytes``,
    unless its rows share all ``HASH_BITS`` bits: such a bucket cannot be split,
    stays at the depth where nothing but it is left, and is marked ``oversized``.

    Defined cases: a null text has 0 bytes; a null id is hashed as an empty
    text; repeated ids share a shard; an empty table gives an empty result; other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("bytes"))
    code = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = scratch.cut(rows.withColumn("code", code), "codes")
    # one row per code: repeated ids can never be told apart
    shards = scratch.cut(split(rows.groupBy("code").agg(F.sum("bytes").alias("bytes")), limit_bytes), "shards")

    # the directory: a cell for each prefix of `depth` bits; deeper buckets are looked up by their own depth
    sizes = {r.d: r.n for r in shards.groupBy("d").agg(F.count("*").alias("n")).collect()}  # at most HASH_BITS + 1 rows
    most, depth = max(4096, 8 * sum(sizes.values())), 0
    for g in range(max(sizes, default=0) + 1):
        if sum(n << (g - d) for d, n in sizes.items() if d <= g) <= most:
            depth = g
    shallow = shards.where(F.col("d") <= depth).withColumn("width", F.expr(f"shiftleft(1L, {depth} - d)"))
    cells = shallow.select(F.explode(F.expr("sequence(prefix * width, (prefix + 1) * width - 1)")).alias("cell"), "d", "prefix", "shard_bytes")
    rows = rows.withColumn("cell", F.expr(f"shiftright(code, {HASH_BITS - depth})"))
    found = rows.join(cells, "cell").select("doc_id", "bytes", "d", "prefix", "shard_bytes")
    if max(sizes, default=0) > depth:
        deep = shards.where(F.col("d") > depth)
        ways = deep.groupBy(F.expr(f"shiftright(prefix, d - {depth})").alias("cell")).agg(F.collect_set("d").alias("ds"))  # at most HASH_BITS each
        tried = rows.join(ways, "cell").select("doc_id", "bytes", "code", F.explode("ds").alias("d")).withColumn("prefix", F.expr(f"shiftright(code, {HASH_BITS} - d)"))
        found = found.union(tried.join(deep, ["d", "prefix"]).select("doc_id", "bytes", "d", "prefix", "shard_bytes"))
    name = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), d, '0')"))
    return found.select("doc_id", "bytes", F.col("d").alias("depth"), name.alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversized"))
