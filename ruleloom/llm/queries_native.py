"""Queries and SQL of the operators that use DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.mixing import GOLDEN, LEAST_BLOCK, MOST_SLOTS, mix
from ruleloom.llm.sharding import LIMIT_BYTES, shard
from ruleloom.llm.url_filter import Rule, judge_urls

URL_RULES = [Rule.parse("block", "net/"), Rule.parse("allow", "example.net/en/"), Rule.parse("block", "example.com/de/"), Rule.parse("allow", "org/fr/")]


def op3_url_markov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position")


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "bytes", "depth", "shard", "shard_bytes")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
    WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS fills FROM w),
f AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total,
    sum(cap) OVER o - cap AS filled, (SELECT sum(weight) FROM c) - sum(weight) OVER o + weight AS open
  FROM c WINDOW o AS (ORDER BY fills, source IS NULL, encode(source) ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - filled) / open) AS level FROM f WHERE (total - filled) / open <= fills),
t AS (SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM f, l),
q AS (SELECT *, floor(target)::BIGINT AS quota,
    (sum(floor(target)::BIGINT) OVER (ORDER BY source IS NULL, encode(source) ROWS UNBOUNDED PRECEDING))::BIGINT AS high FROM t),
n AS (SELECT max(high) AS words, greatest({LEAST_BLOCK}, max(high) // {MOST_SLOTS}) AS block_tokens FROM q),
i AS (SELECT unnest(range(0, (words + block_tokens - 1) // block_tokens)) AS position FROM n),
-- the schedule: golden-ratio points through the cumulative targets, ranked per source
h AS (SELECT position, (position + 1.0::DOUBLE) * {GOLDEN!r}::DOUBLE % 1.0::DOUBLE * words::DOUBLE AS point FROM i, n),
g AS (SELECT source, position, row_number() OVER (PARTITION BY source ORDER BY position) - 1 AS block
  FROM h JOIN q ON point >= high - quota AND point < high),
k AS (SELECT source, count(*) * any_value(block_tokens) AS length FROM g, n GROUP BY source),
p AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT p.doc_id, p.source, turn * source_size + b AS lo, least(turn * source_size + b + size, length) AS hi
  FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source, (VALUES (0), (1)) v(turn)),
y AS (SELECT x.*, block_tokens, unnest(range(lo // block_tokens, (hi - 1) // block_tokens + 1)) AS block FROM x, n WHERE hi > lo),
z AS (SELECT doc_id, sum(least(hi, (y.block + 1) * block_tokens) - greatest(lo, y.block * block_tokens)) AS taken,
    min(position) AS first_position, max(position) AS last_position
  FROM y JOIN g ON y.source IS NOT DISTINCT FROM g.source AND y.block = g.block GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_position, last_position
FROM p LEFT JOIN z USING (doc_id)
"""

OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS code FROM documents),
c AS (SELECT code, sum(bytes) AS bytes FROM d GROUP BY code),
a AS (SELECT code, bytes, unnest(range(0, 61))::INTEGER AS depth FROM c),
s AS (SELECT depth, code >> (60 - depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS codes FROM a GROUP BY ALL),
o AS (SELECT a.code, min(a.depth) AS depth FROM a JOIN s ON s.depth = a.depth AND s.prefix = a.code >> (60 - a.depth)
  WHERE s.shard_bytes <= {LIMIT_BYTES} OR s.codes = 1 OR a.depth = 60 GROUP BY a.code)
SELECT d.doc_id, d.bytes, o.depth,
  CASE WHEN o.depth = 0 THEN '' ELSE substr(lpad(bin(d.code), 60, '0'), 1, o.depth) END AS shard,
  s.shard_bytes::BIGINT AS shard_bytes
FROM d JOIN o USING (code) JOIN s ON s.depth = o.depth AND s.prefix = d.code >> (60 - o.depth)
"""
