"""Byte-level BPE: merging by a priority queue over a doubly linked symbol list.

A word starts as a list of byte symbols.  A heap holds ``(rank, place)`` for all
neighbouring pairs that can merge; the smallest is taken, an entry whose symbols
have changed since is stale and skipped, and a merge links the new symbol to its
neighbours and pushes the pairs it forms.  That is O(n log n) for a word of n
bytes, however long.  Decoding concatenates the vocabulary's byte strings.

The vocabulary is read from the path given, once in each Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import bound, small

#: Fixed by the vocabulary: how a text is cut into words before merging (white space by its Unicode property).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MEMO = 100_000
MEMO_WORD = 64
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1
BATCH_CHARS = 2_000_000


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, others = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(others)
            others += 1
    return names


class Encoder(dict):
    """Encodes and decodes texts; as a dict it remembers the ids of words."""

    def __init__(self, path: str, memo: int | None = None):
        self.most = MEMO if memo is None else memo
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names = byte_names()
        to_byte = {c: b for b, c in names.items()}
        vocab = file["model"]["vocab"]
        self.single = [vocab[names[b]] for b in range(256)]
        self.id_bits = max(vocab.values()).bit_length()
        self.ranks, self.made = {}, []  # by the pair of ids in one number; and the id that a rank makes
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << self.id_bits | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.older: dict[str, tuple[int, ...]] = {}
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(WORDS)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.merge(word.encode("utf-8"))
        if len(word) <= MEMO_WORD:
            if len(self) >= self.most:  # words in use move on, the rest goes
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def merge(self, word: bytes) -> tuple[int, ...]:
        symbol = list(map(self.single.__getitem__, word))
        n = len(symbol)
        if n == 1:
            return tuple(symbol)
        rank_of, made, push, id_bits = self.ranks.get, self.made, heapq.heappush, self.id_bits
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        heap = []
        left = symbol[0]
        for i in range(1, n):
            right = symbol[i]
            rank = rank_of(left << id_bits | right)
            if rank is not None:
                heap.append(rank << PLACE_BITS | (i - 1))
            left = right
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & PLACE
            j = after[i]
            left = symbol[i]
            if left < 0 or j < 0 or rank_of(left << id_bits | symbol[j]) != entry >> PLACE_BITS:
                continue  # stale
            new = symbol[i] = made[entry >> PLACE_BITS]
            symbol[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = rank_of(new << id_bits | symbol[k])
                if rank is not None:
                    push(heap, rank << PLACE_BITS | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbol[h] << id_bits | new)
                if rank is not None:
                    push(heap, rank << PLACE_BITS | h)
        return tuple([s for s in symbol if s >= 0])

    def encode(self, text: str) -> list[int]:
        if self.cuts is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.__getitem__, self.words.findall(text))))
        ids: list[int] = []
        for part in self.cuts.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.__getitem__, self.words.findall(part))))
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, memo: int | None = None) -> Encoder:
    return Encoder(path, memo)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """Slices of a batch by the characters they hold."""
    values, start, held = batch.column(column).to_pylist(), 0, 0
    for i, v in enumerate(values):
        held += len(v or "") + 64
        if held >= BATCH_CHARS:
            yield start, values[start : i + 1]
            start, held = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", memo: int | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)`` per input row: the token ids of the whole text, and the text decoded from them.

    A worker remembers the ids of up to twice ``memo`` words (about 200 bytes each).

    Defined cases: a null text is encoded as an empty one, which has no ids and
    decodes to an empty text; texts and words of any length are encoded whole; a
    special token's string in a text is that token; repeated rows and null ids are kept; an empty table gives an empty result;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, memo)
        for batch in small(batches):
            for start, texts in _parts(batch, 1):
                ids = [bpe.encode(t) if t else [] for t in texts]
                offsets = [0]
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                flat = pa.array(chain.from_iterable(ids), pa.int32(), size=offsets[-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists, pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    bound(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(coded: DataFrame, vocabulary: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` from arrays of token ids; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what :func:`encode` returns."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
