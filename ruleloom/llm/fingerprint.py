"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs.

A paragraph (a line that is not empty) is hashed to a wide vector, and a document
is the sum of its paragraphs' vectors.  So the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector.  The vector has two parts:

* ``EXACT`` words modulo 2**64, drawn from the paragraph's 128-bit hash, for equality;
* one count and ``LIKE`` words modulo 2**32, sums of +1/-1 vectors hashed from the
  pieces of the paragraph (cut where a hash of four bytes says so, so that an
  edit moves only the pieces it touches).  The squared length of the difference of two
  such sums estimates how many pieces the two texts do not share.  No text that
  Spark can hold has the 2**31 pieces at which a sum would turn over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import bound, small
from ruleloom.llm.shingles import mix

EXACT = 4
LIKE = 256
PIECE_MASK = np.uint64(15)
BATCH_BYTES = 1_000_000
RANGE_ROWS = 2048
#: A range has more rows than ``RANGE_ROWS`` where there would be over this many; the driver holds a bound for each.
MOST_RANGES = 1 << 20
#: Ranges that one quantile sketch tells apart; more are found by a sketch within each of these.
COARSE = 2048
STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3 | 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.ones(n + 1, np.uint64)
    down = np.ones(n + 1, np.uint64)
    up[1:], down[1:] = BASE, np.uint64(pow(int(BASE), -1, 1 << 64))
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = _powers(1 << 16)


def _piece_sums(paragraphs: list[bytes], owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per document, and their summed +1/-1 vectors."""
    count, total = np.zeros(docs, np.int64), np.zeros((docs, LIKE), np.int64)
    if not paragraphs:
        return count, total
    data = np.frombuffer(b"".join(paragraphs), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum([len(p) for p in paragraphs])
    near, inside = data.copy(), np.arange(len(data)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    for j in range(1, 4):  # never across the start of a paragraph
        near[j:] += np.where(inside[j:] >= j, data[:-j] << np.uint64(16 * j), np.uint64(0))
    cut = (mix(near) & PIECE_MASK) == 0
    cut[ends - 1] = True
    last = np.flatnonzero(cut)
    start = np.concatenate([[0], last[:-1] + 1])
    # hash of each piece: its bytes as digits of a polynomial, without the place where it stands
    block = len(_UP) - 1
    hashes = np.empty(len(last), np.uint64)
    step = 1024
    for a in range(0, len(last), step):
        s, e = start[a : a + step], last[a : a + step] + 1
        lo, hi = s[0], e[-1]
        if hi - lo <= block:
            sums = np.concatenate([[np.uint64(0)], np.cumsum(data[lo:hi] * _UP[: hi - lo])])
            hashes[a : a + step] = (sums[e - lo] - sums[s - lo]) * _DOWN[s - lo]
        else:
            for i, (x, y) in enumerate(zip(s, e)):
                h = np.zeros(1, np.uint64)
                for c in range(x, y, block):  # a huge piece, in turns
                    part = data[c : min(y, c + block)]
                    own = (part * _UP[: len(part)]).sum(dtype=np.uint64)
                    h = mix(h * STEP + np.uint64(c - x) + own) if y - x > block else h + own
                hashes[a + i] = h[0]
    which = owner[np.searchsorted(ends, last, side="right")]
    size = (last + 1 - start).astype(np.uint64)
    hashes = mix(hashes ^ (size << np.uint64(48)))
    for a in range(0, len(hashes), 65536):
        h, d = hashes[a : a + 65536], which[a : a + 65536]
        words = np.stack([mix(h + np.uint64(i * int(STEP) % (1 << 64))) for i in range(LIKE // 64)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1, count=LIKE)
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        n = np.diff(np.concatenate([first, [len(d)]]))
        count[d[first]] += n
        total[d[first]] += 2 * ones - n[:, None]
    return count, total


class Fingerprints:
    """Vectors of several texts; ``+`` and ``-`` insert and delete paragraphs."""

    def __init__(self, exact: np.ndarray, count: np.ndarray, like: np.ndarray):
        self.exact, self.count, self.like = exact, count.astype(np.uint32), like.astype(np.uint32)

    @classmethod
    def of(cls, texts: list[str | None]) -> Fingerprints:
        """Of whole texts; null is an empty text."""
        paragraphs, owner = [], []
        for i, text in enumerate(texts):
            if text:
                own = [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]
                paragraphs += own
                owner += [i] * len(own)
        owner = np.array(owner, np.int64)
        exact = np.zeros((len(texts), EXACT), np.uint64)
        if paragraphs:
            seeds = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, paragraphs)), np.uint64).reshape(-1, 2)
            words = np.stack([mix(seeds[:, 0] + mix(seeds[:, 1] + np.uint64((i + 1) * int(STEP) % (1 << 64)))) for i in range(EXACT)], axis=1)
            np.add.at(exact, owner, words)
        return cls(exact, *_piece_sums(paragraphs, owner, len(texts)))

    def __add__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.exact + other.exact, self.count + other.count, self.like + other.like)

    def __sub__(self, other: Fingerprints) -> Fingerprints:
        return Fingerprints(self.exact - other.exact, self.count - other.count, self.like - other.like)

    def strings(self) -> list[str]:
        rows = np.concatenate([self.exact.astype(">u8").view(np.uint8), self.count[:, None].astype(">u4").view(np.uint8), self.like.astype(">u4").view(np.uint8)], axis=1)
        return [r.tobytes().hex() for r in rows]

    @classmethod
    def parse(cls, strings: list[str]) -> Fingerprints:
        rows = np.frombuffer(bytes.fromhex("".join(strings)), np.uint8).reshape(len(strings), -1)
        a, b = 8 * EXACT, 8 * EXACT + 4
        view = lambda x, kind: np.ascontiguousarray(x).view(kind)
        return cls(view(rows[:, :a], ">u8").astype(np.uint64), view(rows[:, a:b], ">u4")[:, 0].astype(np.uint32), view(rows[:, b:], ">u4").astype(np.uint32))

    def likeness(self, other: Fingerprints) -> np.ndarray:
        """Estimated share of pieces in common, 0 to 1, row by row; equal fingerprints: 1."""
        square = lambda x: (x.view(np.int32).astype(np.float64) ** 2).mean(axis=1)
        both = square(self.like) + square(other.like)
        same = (self.exact == other.exact).all(axis=1) & (self.count == other.count) & (self.like == other.like).all(axis=1)
        return np.where(same, 1.0, np.where(both > 0, np.clip(1.0 - square(self.like - other.like) / np.maximum(both, 1e-9), 0.0, 1.0), 0.0))


def _bounds(rows: DataFrame, ranges: int) -> np.ndarray:
    """``ranges - 1`` rising approximate quantiles of ``key``; an id that fills several ranges is there as often."""
    if ranges < 2:
        return np.empty(0, np.int64)
    coarse = min(ranges, COARSE)
    sketch = lambda n: F.percentile_approx("key", [i / n for i in range(1, n)], 10 * COARSE)
    first = np.array(rows.select(sketch(coarse)).first()[0], np.int64)
    if coarse == ranges:
        return first
    cuts = np.unique(first)

    @F.pandas_udf("long")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(np.int64), "left"))

    fine = -(-ranges // coarse)
    within = rows.groupBy(part_of("key").alias("part")).agg(F.count("*").alias("n"), F.percentile_approx("key", [i / fine for i in range(1, fine)], 10 * fine).alias("q")).collect()
    usual = rows.count() / len(first)
    inside = []
    for r in within:  # a part that is larger, as one id fills it, has that id as often
        inside += r["q"] * max(1, round(r["n"] / usual))
    return np.sort(np.concatenate([first, np.array(inside, np.int64)]))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int | None = None) -> DataFrame:
    """``(range, tail, doc_id, text)``, sorted in each partition, so that a row's next document follows it.

    Ids are cut into ranges at approximate quantiles, and an id that fills several
    ranges is cut by a hash of its texts; each range also receives, as ``tail``, the
    first document of the next range (the last range: of the first).  One shuffle moves
    the texts, tasks stream through their ranges, and the driver holds one id per range.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, -(-n // (rows_per_range or max(RANGE_ROWS, n // MOST_RANGES))))
    bounds = _bounds(rows.select("key"), ranges)
    hot = np.unique(bounds[1:][bounds[1:] == bounds[:-1]])

    @F.pandas_udf("long")
    def range_of(key: pd.Series, by_text: pd.Series) -> pd.Series:
        """Ids that are several bounds fill the ranges from the first of them on, evenly by hash."""
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(bounds, k, "left"), np.searchsorted(bounds, k, "right")
        share = by_text.to_numpy(np.int64).astype(np.float64) / 2.0**64 + 0.5
        return pd.Series(low + np.minimum(np.floor(share * (high - low)), np.maximum(high - low - 1, 0)).astype(np.int64))

    # the order of documents: by id, and of one id that fills several ranges by hash of the text
    by_text = F.when(F.col("key").isin(hot.tolist()), F.xxhash64("text")).otherwise(F.lit(0)) if len(hot) else F.lit(0)
    rows = rows.withColumn("by_text", by_text.cast("long"))
    ranged = rows.withColumn("range", range_of("key", "by_text")) if len(bounds) else rows.withColumn("range", F.lit(0).cast("long"))
    first = {r["range"]: (r.k["key"], r.k["by_text"]) for r in ranged.select("range", "key", "by_text").groupBy("range").agg(F.min(F.struct("key", "by_text")).alias("k")).collect()}
    order = sorted(first)
    heads = np.array([first[r] for r in order], np.int64).reshape(-1, 2)  # rising, as ranges are
    before = np.array(order[-1:] + order[:-1], np.int64)

    @F.pandas_udf("long")
    def range_before(key: pd.Series, by_text: pd.Series) -> pd.Series:
        """The range before the one that begins with this id and hash, or -1."""
        k, h = key.to_numpy(np.int64), by_text.to_numpy(np.int64)
        found = np.full(len(k), -1, np.int64)
        left, right = np.searchsorted(heads[:, 0], k, "left"), np.searchsorted(heads[:, 0], k, "right")
        for i in np.flatnonzero(right > left):
            at = left[i] + np.searchsorted(heads[left[i] : right[i], 1], h[i])
            if at < right[i] and heads[at, 1] == h[i]:
                found[i] = before[at]
        return pd.Series(found)

    rows = ranged.withColumn("before", range_before("key", "by_text") if order else F.lit(-1).cast("long"))
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    sent = F.when(F.col("before") >= 0, F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    sent = rows.select("key", "by_text", "doc_id", "text", F.explode(sent).alias("t")).select("t.range", "t.tail", "key", "by_text", "doc_id", "text")
    dealt = sent.repartition(max(1, -(-len(order) // 4)), "range").sortWithinPartitions("range", "tail", "key", "by_text", "text")
    return dealt.select("range", "tail", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    ``edited`` is the SHA-256 of the edited text: the last ``n_chars // 4`` code
    points replaced by the first as many (or all) of the next document.  Documents
    follow by ascending id, equal ids by text (those of an id that fills several ranges
    by a hash of it first); after the last comes the first.

    Defined cases: a null text is an empty text; a null id comes before all
    others; a single document is its own next; repeated rows are each other's
    next; texts of any length are hashed whole; an empty table gives an empty
    result; other columns are not read.
    """
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
            texts = [t for _, t, _ in rows]
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for _, t, n in rows]
            own, new, following = Fingerprints.of(texts), Fingerprints.of(edited), Fingerprints.of([n for _, _, n in rows[-1:]])
            shifted = Fingerprints(*(np.concatenate([getattr(own, a)[1:], getattr(following, a)]) for a in ("exact", "count", "like")))
            # within a batch the next text is the next row's, unless the range changes there
            other = [i for i in range(len(rows) - 1) if rows[i][2] is not rows[i + 1][1]]
            if other:
                f = Fingerprints.of([rows[i][2] for i in other])
                shifted.exact[other], shifted.count[other], shifted.like[other] = f.exact, f.count, f.like
            sha = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(sha), pa.array(own.strings()), pa.array(new.strings()), pa.array(own.likeness(new)), pa.array(own.likeness(shifted))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        rows, held, last = [], 0, None
        for batch in small(batches):
            for r, tail, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == r:
                    rows.append((last[1], last[2], text))
                    held += len(last[2]) + 64
                last = None if tail else (r, i, text)
                if tail:
                    continue
                if held >= BATCH_BYTES:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    bound(docs.sparkSession)
    return with_next(docs, id_col=id_col, text_col=text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
