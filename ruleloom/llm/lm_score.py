"""Language-model scores: masked pseudo-likelihood under a bidirectional window network.

Every token of a text is predicted from the ``REACH`` tokens on both sides, itself
masked; the score of a text is the sum of the logarithms of these probabilities.
The network embeds the window, weighs each place and dimension, and predicts the
token's class and then the token within its class (two softmaxes of 64).

Every word has a probability of its own: that of its token, of ``TOKENS``, which the
network predicts, times the word's share of that token by counts of the whole corpus.
Frequent words have a token almost to themselves, the others share ``TOKENS -
FREQUENT``.  Words are told apart by 64-bit hashes.  The executors hold the counts of
the most frequent words, and the others are joined, so the number of words is not
bounded.  Training reads every document: documents are dealt to shards by a hash, each
shard starts from the corpus counts, makes one pass over its texts with every token as
a target, and the weights of all shards are averaged, weighted by their targets, in
fixed point.  The number of shards follows the number of words, so reruns agree
however the input is split into files and whatever the size of the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import scratch
from ruleloom.llm.batches import ROWS, bound, small
from ruleloom.llm.shingles import mix, word_hashes

CLASSES = 64
TOKENS = CLASSES * CLASSES
FREQUENT = 3072
PAD = TOKENS
SLOT_BITS = 18
WIDTH = 16
REACH = 3
#: Consecutive tokens that are trained together, and tokens in a step.
RUN = 32
BATCH = 8192
RATE = 0.3
FIXED = 1 << 16
#: Words whose counts every executor holds at most; the counts of others are joined, with the same result.
KNOWN = 1 << 18
GROUP_BYTES = 400_000
#: A shard has this many words, or more where there would be over ``MOST_SHARDS``.
SHARD_WORDS = 4_000_000
MOST_SHARDS = 1 << 16
SHIFTS = [j for j in range(-REACH, REACH + 1) if j]


@dataclass
class Network:
    """Weights; ``flat`` and ``load`` turn them into one vector and back."""

    embed: np.ndarray
    place: np.ndarray
    shift: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small seeded weights; biases are the logarithms of the corpus frequencies."""
        rng = np.random.default_rng(20260211)
        c = counts.astype(np.float64).reshape(CLASSES, CLASSES) + 0.5
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        embed = small(TOKENS + 1, WIDTH)
        embed[PAD] = 0
        return cls(embed, np.full((len(SHIFTS), WIDTH), 0.5, np.float32), np.zeros(WIDTH, np.float32), small(CLASSES, WIDTH), np.log(c.sum(axis=1) / c.sum()).astype(np.float32), small(CLASSES, CLASSES, WIDTH), np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.place, self.shift, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def hidden(self, tokens: np.ndarray) -> np.ndarray:
        """For every place with a full window: tokens has REACH pads before and after."""
        e = self.embed[tokens]
        n = len(tokens) - 2 * REACH
        h = np.repeat(self.shift[None, :], n, axis=0)
        for w, j in zip(self.place, SHIFTS):
            h += w * e[REACH + j : REACH + j + n]
        return np.tanh(h, out=h)

    def log_probability(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each target given its hidden vector."""
        order, ends = by_class(target)
        word, hidden = target[order] & 63, np.ascontiguousarray(h[order].T)
        logits = self.to_class @ hidden + self.class_bias[:, None]
        out = np.repeat(np.arange(CLASSES), np.diff(ends))
        out = logits[out, np.arange(len(h))] - log_sum_exp(logits)
        for c in np.flatnonzero(np.diff(ends)):
            at = slice(ends[c], ends[c + 1])
            logits = self.to_word[c] @ hidden[:, at] + self.word_bias[c][:, None]
            out[at] += logits[word[at], np.arange(logits.shape[1])] - log_sum_exp(logits)
        back = np.empty_like(out)
        back[order] = out
        return back

    def step(self, runs: np.ndarray, squares: list[np.ndarray]) -> int:
        """One Adagrad step on every token of some runs (rows of consecutive tokens with REACH before and after); how many there were."""
        inner = runs.shape[1] - 2 * REACH
        at = [slice(REACH + j, REACH + j + inner) for j in SHIFTS]
        target = runs[:, REACH : REACH + inner].ravel()
        order, ends = by_class(target)
        n = int(ends[CLASSES])  # pads come last
        if not n:
            return 0
        order, ends = order[:n], ends[: CLASSES + 1]
        e = self.embed[runs]
        h = np.empty((len(runs), inner, WIDTH), np.float32)
        h[:] = self.shift
        for w, i in zip(self.place, at):
            h += w * e[:, i]
        np.tanh(h, out=h)
        target, h = target[order], h.reshape(-1, WIDTH)[order]
        hidden, word = np.ascontiguousarray(h.T), target & 63
        p = softmax(self.to_class @ hidden + self.class_bias[:, None])
        p[target >> 6, np.arange(n)] -= 1
        g_class, g_class_bias, g_h = p @ h, p.sum(axis=1), self.to_class.T @ p
        g_word, g_word_bias = np.zeros_like(self.to_word), np.zeros_like(self.word_bias)
        for c in np.flatnonzero(np.diff(ends)):
            own = slice(ends[c], ends[c + 1])
            q = softmax(self.to_word[c] @ hidden[:, own] + self.word_bias[c][:, None])
            q[word[own], np.arange(q.shape[1])] -= 1
            g_word[c], g_word_bias[c] = q @ h[own], q.sum(axis=1)
            g_h[:, own] += self.to_word[c].T @ q
        g_h = g_h.T * (1 - h * h)
        spread = np.zeros((len(runs) * inner, WIDTH), np.float32)
        spread[order] = g_h
        spread = spread.reshape(len(runs), inner, WIDTH)
        g_place, g_e = np.empty_like(self.place), np.zeros_like(e)
        for j, (w, i) in enumerate(zip(self.place, at)):
            g_place[j] = np.einsum("rid,rid->d", e[:, i], spread)
            g_e[:, i] += w * spread
        flat = runs.ravel().astype(np.int16)
        by_token = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(flat[by_token]) > 0]))
        rows = flat[by_token][first]
        g_embed = np.add.reduceat(g_e.reshape(-1, WIDTH)[by_token], first, axis=0)
        g_embed[rows == PAD] = 0
        # of the embeddings only those of the runs have a gradient
        g_embed /= n
        squares[0][rows] += g_embed * g_embed
        self.embed[rows] -= RATE * g_embed / (np.sqrt(squares[0][rows]) + 1e-4)
        for w, g, s in zip(self.parts()[1:], [g_place, g_h.sum(axis=0), g_class, g_class_bias, g_word, g_word_bias], squares[1:]):
            g /= n
            s += g * g
            w -= RATE * g / (np.sqrt(s) + 1e-4)
        return n


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of targets by class, pads last, and where each class begins and the last ends."""
    group = (target >> 6).astype(np.uint8)
    return np.argsort(group, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(group, minlength=CLASSES))])


def log_sum_exp(x: np.ndarray) -> np.ndarray:
    """Of each column."""
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each column."""
    x = np.exp(x - x.max(axis=0))
    x /= x.sum(axis=0)
    return x


def _words(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all words of some texts, and the offsets of each text."""
    group: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        group.append(text.encode("utf-8", "surrogatepass").lower() if text else b"")
        held += len(group[-1])
        if held >= GROUP_BYTES or i + 1 == len(texts):
            yield word_hashes(group)
            group, held = [], 0


def _slots(words: np.ndarray) -> np.ndarray:
    return (mix(words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _groups(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of all words of some texts, and the offsets of each text."""
    for words, at in _words(texts):
        yield _slots(words), at


def _padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of several texts with REACH pads around each, and the places of the tokens."""
    place = np.arange(len(ids)) + REACH * (1 + np.repeat(np.arange(len(at) - 1), np.diff(at)))
    tokens = np.full(len(ids) + REACH * len(at), PAD, np.int64)
    tokens[place] = ids
    return tokens, place


def runs_of(tokens: np.ndarray) -> np.ndarray:
    """The padded tokens of several texts as rows of RUN tokens with REACH before and after, in an order by hash."""
    n = -(-(len(tokens) - 2 * REACH) // RUN)
    whole = np.full(n * RUN + 2 * REACH, PAD, np.int64)
    whole[: len(tokens)] = tokens
    rows = np.lib.stride_tricks.sliding_window_view(whole, RUN + 2 * REACH)[::RUN]
    return rows[np.argsort(mix(np.arange(n, dtype=np.uint64)))]


def train_on(batches: Iterator[list[str | None]], table: np.ndarray, start: Network) -> tuple[Network, int]:
    """One pass over the texts of a partition; a step has runs of many texts."""
    net = start.load(start.flat())
    squares = [np.zeros_like(p) for p in net.parts()]
    held, seen, most = np.empty((0, RUN + 2 * REACH), np.int64), 0, BATCH // RUN
    for texts in batches:
        for slots, at in _groups(texts):
            if not len(slots):
                continue
            held = np.concatenate([held, runs_of(_padded(table[slots], at)[0])])
            while len(held) >= most:
                seen += net.step(held[:most], squares)
                held = held[most:]
    if len(held):
        seen += net.step(held, squares)
    return net, seen


def token_scores(slots: np.ndarray, at: np.ndarray, table: np.ndarray, net: Network) -> np.ndarray:
    """Log-probability of the token of every word."""
    tokens, place = _padded(table[slots], at)
    logp = np.empty(len(place))
    for i in range(0, len(place), 65536):
        p = place[i : i + 65536]
        h = net.hidden(tokens[p[0] - REACH : p[-1] + REACH + 1])[p - p[0]]
        logp[i : i + 65536] = net.log_probability(h, tokens[p])
    return logp


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text."""
    total = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        total[some] = np.add.reduceat(values, at[:-1][some])
    return total


def score_texts(texts: list[str | None], table: np.ndarray, net: Network) -> Iterator[tuple[int, float]]:
    """Number of words and summed log-probability of the tokens of each text."""
    for slots, at in _groups(texts):
        total = _sums(token_scores(slots, at, table, net) if len(slots) else np.empty(0), at)
        yield from zip(np.diff(at).tolist(), total.tolist())


@dataclass
class Shares:
    """What words have of their tokens: logarithms of the tokens' counts and of those of the words with ``least`` or more."""

    tokens: np.ndarray
    words: np.ndarray
    logs: np.ndarray
    least: int

    def of(self, words: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the shares, and which words' counts are not among ``words`` and taken as one."""
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        known = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        counts = np.where(known, self.logs[at], 0.0) if len(self.words) else np.zeros(len(words))
        return counts - self.tokens[tokens], ~known


def score_words(texts: list[str | None], table: np.ndarray, net: Network, shares: Shares) -> Iterator[tuple[int, float, np.ndarray]]:
    """Number of words and summed log-probability of each text, and the words whose counts are to be added."""
    for words, at in _words(texts):
        if not len(words):
            yield from ((0, 0.0, words) for _ in at[1:])
            continue
        slots = _slots(words)
        share, unknown = shares.of(words, table[slots])
        total = _sums(token_scores(slots, at, table, net) + share, at)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            # below a count of two there is nothing to add
            yield int(b - a), float(total[i]), words[a:b][unknown[a:b]] if shares.least > 2 else words[:0]


def count_words(texts: DataFrame) -> DataFrame:
    """``(slot, word, n)`` of every word of all texts."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, back = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(_slots(words).astype(np.int32)), pa.array(words.view(np.int64)), pa.array(n)], ["slot", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in small(batches):
            for words, _ in _words(batch.column(0).to_pylist()):
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
                if size >= 1 << 19:
                    yield merged(held)
                    held, size = [], 0
        if size:
            yield merged(held)

    return texts.mapInArrow(count, "slot int, word long, n long").groupBy("slot", "word").agg(F.sum("n").alias("n"))


def word_shares(counts: DataFrame, tokens: np.ndarray) -> Shares:
    """From the counts of words and of tokens."""
    top = 1 << 16
    sizes = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("words")).toArrow()  # at most ``top`` rows
    least, held = top + 1, 0
    for n, words in sorted(zip(sizes["n"].to_pylist(), sizes["words"].to_pylist()), reverse=True):
        if held + words > KNOWN:
            break
        least, held = n, held + words
    # no row has a count between the next one that is there and this one
    below = max((n for n in sizes["n"].to_pylist() if n < least), default=0)
    least = below + 1
    known = counts.where(F.col("n") >= least).select("word", "n").toArrow() if held else None
    words = known["word"].to_numpy().view(np.uint64) if known else np.empty(0, np.uint64)
    order = np.argsort(words)
    logs = np.log(known["n"].to_numpy().astype(np.float64))[order] if known else np.empty(0)
    return Shares(np.log(np.maximum(tokens, 1.0)), words[order], logs, least if held else 1 << 62)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Table from word slot to token, and the averaged network, from all of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _fit(texts, scratch.cut(count_words(texts.select("text")), "lm-words"))[:2]


def _shards(texts: DataFrame, words: int) -> DataFrame:
    """The texts dealt by a hash of id and text, each shard in the order of that hash."""
    n = max(1, -(-words // max(SHARD_WORDS, words // MOST_SHARDS)))
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.withColumn("shard", F.pmod("key", F.lit(n))).repartition(n, "shard").sortWithinPartitions("shard", "key").select("text", "shard")


def _by_shard(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    cuts = [0, *(np.flatnonzero(np.diff(batch.column(1).to_numpy())) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _even(columns: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Lists of ``ROWS`` texts, whatever the size of the batches that they come in."""
    held: list[str | None] = []
    for column in columns:
        for i in range(0, len(column), ROWS):
            held += column.slice(i, ROWS).to_pylist()
            while len(held) >= ROWS:
                yield held[:ROWS]
                held = held[ROWS:]
    if held:
        yield held


def _fit(texts: DataFrame, words: DataFrame) -> tuple[np.ndarray, Network, np.ndarray]:
    """Table, network, and the counts of the tokens."""
    counted = words.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # at most 2**SLOT_BITS rows
    counted = counted.sort_values(["n", "slot"], ascending=[False, True])
    table = FREQUENT + np.arange(1 << SLOT_BITS) % (TOKENS - FREQUENT)
    top = counted["slot"].to_numpy()[:FREQUENT]
    table[top] = np.arange(len(top))
    counts = np.bincount(table[counted["slot"].to_numpy(np.int64)], counted["n"].to_numpy(np.float64), TOKENS)
    start = Network.start(counts)

    def weights(texts: list[list[str | None]]) -> Iterator[pa.RecordBatch]:
        net, seen = train_on(texts, table, start)
        if seen:
            weight = 1 + seen // 1024
            values = np.rint(net.flat().astype(np.float64) * FIXED).astype(np.int64) * weight
            for i in range(0, len(values), 65536):
                part = values[i : i + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), weight, np.int64))], ["i", "v", "w"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a partition, one after the other."""
        parts = ((b.column(1)[0].as_py(), b) for batch in batches for b in _by_shard(batch))
        for _, own in groupby(parts, key=lambda x: x[0]):
            yield from weights(_even(b.column(0) for _, b in own))

    total = int(counted["n"].sum())
    mean = _shards(texts, total).mapInArrow(train, "i int, v long, w long").groupBy("i").agg((F.sum("v").cast("double") / F.sum("w")).alias("v")).toPandas()  # one row per weight
    flat = start.flat().astype(np.float64)
    flat[mean["i"].to_numpy(np.int64)] = mean["v"].to_numpy() / FIXED
    return table, start.load(flat), counts


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_tokens, score (summed log-probability of its words), mean_score (per word).

    Defined cases: a null, empty or blank text has no tokens, score 0 and a null
    mean; places beyond a text's ends are a padding token; texts of any length are
    scored whole; repeated rows get equal scores, however the rows are split; null ids are kept; an empty table gives an empty result; other
    columns are not read.
    """
    bound(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = scratch.cut(count_words(texts.select("text")), "lm-words")
    table, net, counts = _fit(texts, words)
    shares = word_shares(words, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            n, total, rest = zip(*score_words(batch.column(2).to_pylist(), table, net, shares)) if batch.num_rows else ((), (), ())
            out = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array([r.view(np.int64) for r in rest], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["row", "doc_id", "n_tokens", "score", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, score double, rest array<long>")
    if shares.least > 2:
        out = scratch.cut(out, "lm-scores")
        # in fixed point, so that the order of the sum does not matter
        log = F.sum(F.round(F.log("n") * float(1 << 32)).cast("long")) / float(1 << 32)
        more = out.select("row", F.explode("rest").alias("word")).join(words.where(F.col("n") < shares.least).select("word", "n"), "word").groupBy("row").agg(log.alias("more"))
        out = out.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    out = out.select("doc_id", "n_tokens", "score")
    return out.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
