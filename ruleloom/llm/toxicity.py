"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: densities of a lexicon, nearness of its words to second-person words,
capitals, punctuation and obfuscation rates.  The lexicon is learned: words and
word beginnings that labelled toxic texts have and clean ones have not, weighted
by smoothed log-odds.  Trees see features made with the lexicon of the other
folds only, and calibration sees scores of trees of the other folds only.

Labels are read from at most ``TRAIN_ROWS`` rows (those of the smallest id hash),
and only from rows outside the held-out fold; everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.batches import bound, small
from ruleloom.llm.boosting import Boosted, fit_boosted, isotonic

TRAIN_ROWS = 20_000
FOLDS = 3
STARTS = (3, 4, 5, 6, 7, 8)
LEXICON_MOST = 4_000
#: A term of a longer word is its beginning and its hash.
TERM_LETTERS = 64
#: A word's letters, capitals and signs are packed in this many bits each; what is beyond is added apart.
COUNT_BITS = 12
MOST = (1 << COUNT_BITS) - 1
MEMO = 120_000
BANDS = (2.0, 3.0, 4.0)
NEAR = 6
FEATURES = 16
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deiner deinem ihr euch euer sie tu te toi ton ta tes vous votre vos ti tú tus tuyo usted ustedes vosotros os vuestro vuestra".split())
#: Signs that stand for letters in an obfuscated word.
DISGUISE = str.maketrans("013457@$!|*", "oieas" + "t" + "as" + "ii" + "*")


REPEATED = re.compile(r"(.)\1\1", re.DOTALL)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


def plain(word: str) -> str:
    """Lower case without the signs around the word."""
    return word.strip(".,;:!?\"'()[]{}<>*%$#&|-_~`«»¿¡…").lower()


def terms(word: str) -> list[str]:
    """The word itself, marked, and its beginnings."""
    w = plain(word)
    whole = w if len(w) <= TERM_LETTERS else w[:8] + xxhash.xxh3_128_hexdigest(w.encode("utf-8", "surrogatepass"))
    return [whole + "$", *(w[:k] for k in STARTS if k <= len(w))] if len(w) >= 3 else []


class WordCodes(dict):
    """What the features need of a word, packed: letters, capitals, signs, flags, lexicon weight."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.starts = {t[:3] for t in lexicon}  # every term begins with three letters of its words
        self.older: dict[str, int] = {}

    def weigh(self, word: str) -> float:
        return max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0) if plain(word)[:3] in self.starts else 0.0

    def code(self, word: str) -> int:
        if word.isalpha() and word.islower():  # most words
            return min(len(word), MOST) | (word in SECOND_PERSON) << 36 | (REPEATED.search(word) is not None) << 37 | min(int(self.weigh(word) * 100), 2000) << 40
        signs = sum(not c.isalnum() for c in word)
        upper = sum(c.isupper() for c in word)
        w = plain(word)
        odd = any(c in w for c in "@$*!|") or (any(c.isdigit() for c in w) and any(c.isalpha() for c in w)) or REPEATED.search(w) is not None
        weight = self.weigh(word)
        if odd and weight == 0.0:
            weight = self.weigh(w.translate(DISGUISE))
        return min(len(word), MOST) | min(upper, MOST) << 12 | min(signs, MOST) << 24 | (w in SECOND_PERSON) << 36 | odd << 37 | (upper > 1 and upper == sum(c.isalpha() for c in word)) << 38 | ("!" in word) << 39 | min(int(weight * 100), 2000) << 40

    def __missing__(self, word: str) -> int:
        code = self.older.get(word)
        if code is None:
            code = self.code(word)
        if len(word) <= 64:
            if len(self) >= MEMO:  # words in use move on, the rest goes
                self.older = dict(self)
                self.clear()
            self[word] = code
        return code


def features(text: str | None, codes: WordCodes) -> np.ndarray:
    out = np.zeros(FEATURES)
    words = text.split() if text else []
    if not words:
        return out
    c = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    n, letters, upper, signs = len(words), float((c & MOST).sum()), float(((c >> 12) & MOST).sum()), float(((c >> 24) & MOST).sum())
    for w in (words[i] for i in np.flatnonzero((c & MOST) == MOST)):  # what did not fit
        letters += len(w) - MOST
        upper += max(0, sum(x.isupper() for x in w) - MOST)
        signs += max(0, sum(not x.isalnum() for x in w) - MOST)
    weight, you = (c >> 40) / 100.0, (c >> 36) & 1
    for i, band in enumerate(BANDS):
        out[i] = k = float((weight >= band).sum())
        out[3 + i] = 100.0 * k / n
    out[6], out[7] = weight.max(), weight.sum() / n
    hits, persons = np.flatnonzero(weight >= BANDS[0]), np.flatnonzero(you)
    out[8] = 100.0 * len(persons) / n
    if len(hits) and len(persons):
        at = np.searchsorted(persons, hits)
        left = hits - persons[np.maximum(at - 1, 0)]
        right = persons[np.minimum(at, len(persons) - 1)] - hits
        gap = np.minimum(np.where(at > 0, left, 1 << 30), np.where(at < len(persons), right, 1 << 30))
        out[9], out[10] = float((gap <= NEAR).sum()), 1.0 / (1.0 + float(gap.min()))
    out[11] = upper / letters
    out[12] = signs / letters
    out[13] = 100.0 * float(((c >> 37) & 1).sum()) / n
    out[14] = 100.0 * float((((c >> 38) & 1) | ((c >> 39) & 1)).sum()) / n
    out[15] = np.log1p(n)
    return out


def learn_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with at least two toxic texts and log-odds of at least the lowest band."""
    found = {}
    for term, a in toxic.items():
        if a >= 2:
            weight = np.log((a + 0.1) / (n_toxic + 0.2)) - np.log((clean.get(term, 0) + 0.5) / (n_clean + 1.0))
            if weight * min(1.0, a / max(2.0, 0.02 * n_toxic)) >= BANDS[0]:
                found[term] = float(min(weight, 12.0) * min(1.0, a / max(2.0, 0.02 * n_toxic)))
    return dict(sorted(found.items(), key=lambda x: (-x[1] * toxic[x[0]] ** 0.5, x[0]))[:LEXICON_MOST])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Boosted
    at: np.ndarray
    probability: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a trace of the raw score keeps texts of one calibrated step in order."""
        raw = self.trees.raw(x)
        if not len(self.at):
            return 1 / (1 + np.exp(-raw))
        return 0.99 * np.interp(raw, self.at, self.probability) + 0.01 / (1 + np.exp(-raw))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per term, fold and label, summed within the partition."""
    seen: dict[tuple[int, int], dict[str, int]] = {}

    def out() -> pa.RecordBatch:
        rows = [(t, f, y, n) for (f, y), d in seen.items() for t, n in d.items()]
        seen.clear()
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["term", "fold", "toxic", "n"])

    for batch in small(batches):
        for fold, y, text in zip(*(c.to_pylist() for c in batch.columns)):
            d = seen.setdefault((fold, y), {})
            own = {t for w in set((text or "").split()) for t in terms(w)}
            own.add("")  # the text itself
            for t in own:
                d[t] = d.get(t, 0) + 1
            if sum(map(len, seen.values())) > 400_000:
                yield out()
    yield out()


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model of ``labels[label_col]`` from texts of rows whose crc32(id) mod 5 is not 0."""
    bound(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    some = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__y"), F.crc32(key.cast("binary")).alias("__crc")).where("__y in (0, 1) and __id is not null and __crc % 5 <> 0").dropDuplicates(["__id"])
    some = some.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "__id")
    fold = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS)).cast("int")
    texts = texts.select("__id", fold.alias("fold"), F.col("__y").alias("toxic"), "text")

    counted = texts.select("fold", "toxic", "text").mapInArrow(_term_counts, "term string, fold int, toxic int, n long")
    cell = lambda f, y: F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}")
    cells = [(f, y) for f in range(FOLDS) for y in (0, 1)]
    per_term = counted.groupBy("term").agg(*(cell(f, y) for f, y in cells))
    toxic_all, clean_all = (sum(F.col(f"n{f}{y}") for f in range(FOLDS)) for y in (1, 0))
    best = per_term.where((F.col("term") == "") | (toxic_all >= 2)).orderBy(F.col("term") != "", F.desc(F.log((toxic_all + 0.1) / (clean_all + 0.5)) * F.sqrt(toxic_all)), "term").limit(5 * LEXICON_MOST)
    rows = [r.asDict() for r in best.collect()]
    total = next((r for r in rows if r["term"] == ""), {f"n{f}{y}": 0 for f, y in cells})
    rows = [r for r in rows if r["term"]]

    def lexicon(folds: list[int]) -> dict[str, float]:
        add = lambda r, y: sum(r[f"n{f}{y}"] for f in folds)
        return learn_lexicon({r["term"]: add(r, 1) for r in rows}, {r["term"]: add(r, 0) for r in rows}, add(total, 1), add(total, 0))

    whole, others = lexicon(list(range(FOLDS))), [lexicon([g for g in range(FOLDS) if g != f]) for f in range(FOLDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [WordCodes(x) for x in others]
        for batch in small(batches):
            ids, fold, y, text = (c.to_pylist() for c in batch.columns)
            x = [features(t, codes[f]).tolist() for f, t in zip(fold, text)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fold, pa.int32()), pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["id", "fold", "toxic", "x"])

    seen = texts.mapInArrow(describe, "id long, fold int, toxic int, x array<double>").orderBy("id", "x").toPandas()
    if seen.empty:
        return ToxicityModel(whole, Boosted([np.empty(0)] * FEATURES, float(np.log(0.1))), np.empty(0), np.empty(0))
    x, y, folds = np.stack(seen["x"].to_numpy()), seen["toxic"].to_numpy(float), seen["fold"].to_numpy()
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        if (folds == f).any():
            raw[folds == f] = fit_boosted(x[folds != f], y[folds != f]).raw(x[folds == f])
    at, probability = isotonic(raw, y)
    return ToxicityModel(whole, fit_boosted(x, y), at, probability)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted.

    Defined cases: a null or empty text is scored as one without words; texts and
    words of any length are read whole; a null id is hashed as an empty text;
    without labels every text gets the same low score; repeated rows get equal
    scores; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(model.lexicon)
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not ids:
                continue
            score = model.score(np.stack([features(t, codes) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held_out(i) for i in ids]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    bound(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model does not predict toxic, with all their columns.

    Defined cases: null and empty texts are scored as texts without words; repeated
    rows share their fate; texts of any length are read whole; an empty table gives an
    empty result; other columns may have any names.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(model.lexicon)
        for batch in small(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            if not texts:
                continue
            toxic = model.score(np.stack([features(t if t is None else str(t), codes) for t in texts])) >= 0.5
            yield batch.filter(pa.array(~toxic))

    bound(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
