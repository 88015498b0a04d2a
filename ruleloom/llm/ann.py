"""Nearest neighbours by cosine, with one vantage-point tree per shard.

Rows are dealt to shards by a hash of id and vector, so hot ids and vectors spread.  A
task reads a shard, builds its tree once, and streams the queries past it in Arrow
batches, so that its memory holds one shard and one batch.  On unit vectors the chord
length is a metric that falls as the cosine rises, so a subtree whose distances
to its vantage point lie in ``[low, high]`` holds nothing nearer than
``max(d - high, low - d)``.  A subtree is skipped if that bound times ``factor``
exceeds the distance of the k-th neighbour so far: factor one is exact search, a
larger factor skips more and may miss some.

Ties are whole: after the k-th best cosine of a query is known, a second search
gathers every point within ``MARGIN`` of it or above, however many, and these are
ordered by id where their cosines, rounded to doubles, are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 65_536
LEAST_SHARDS = 8
BLOCK_QUERIES = 256
LEAF = 48
#: Cosines this close may be equal; more than the rounding of unit vectors and sums.
MARGIN = 1e-9
#: The error of a chord near zero: the root of that of a cosine.
SLACK = 1e-6


class VantageTree:
    """Tree over unit vectors; nodes are tuples (vantage, inner, outer, bounds) or leaf index arrays."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.leaf:
            return idx
        # the candidate with the widest spread of distances to a few others
        few = self.points[idx[:: max(1, len(idx) // 64)]]
        tried = idx[:: max(1, len(idx) // 8)]
        vantage = tried[np.argmax(_chord(self.points[tried], few).std(axis=1))]
        d = _chord(self.points[vantage][None, :], self.points[idx])[0]
        order = np.argsort(d, kind="stable")
        half = len(idx) // 2
        inner, outer = order[:half], order[half:]
        bounds = (d[inner[0]], d[inner[-1]], d[outer[0]], d[outer[-1]])
        return vantage, self._build(idx[inner]), self._build(idx[outer]), bounds

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Indices and cosines of the ``k`` best points of each query, unordered; index -1 where there are fewer."""
        self.best = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.queries, self.factor, self.seen = queries, factor, {}
        everyone = np.arange(len(queries))
        if len(queries):
            self._descend(self.root, everyone)
            self._visit(self.root, everyone, self._reach, self._scan_rest)
        return self.found, self.best

    def at_least(self, queries: np.ndarray, least: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """``(query, point)`` index pairs with a cosine of ``least`` or more, a value per query."""
        self.queries, self.factor = queries, factor
        pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        reach = _length(least) + SLACK

        def scan(leaf: np.ndarray, active: np.ndarray) -> None:
            i, j = np.nonzero(queries[active] @ self.points[leaf].T >= least[active][:, None])
            pairs.append((active[i], leaf[j]))

        if len(queries):
            self._visit(self.root, np.arange(len(queries)), lambda active: reach[active], scan)
        return np.concatenate([q for q, _ in pairs]), np.concatenate([p for _, p in pairs])

    def _reach(self, active: np.ndarray) -> np.ndarray:
        worst = self.best[active].min(axis=1)
        return np.where(np.isfinite(worst), _length(worst), np.inf) + SLACK

    def _scan(self, leaf: np.ndarray, active: np.ndarray) -> None:
        score = self.queries[active] @ self.points[leaf].T
        scores = np.concatenate([self.best[active], score], axis=1)
        ids = np.concatenate([self.found[active], np.broadcast_to(leaf, score.shape)], axis=1)
        k = self.best.shape[1]
        if scores.shape[1] > k:
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        self.best[active], self.found[active] = scores, ids

    def _scan_rest(self, leaf: np.ndarray, active: np.ndarray) -> None:
        done = self.seen.get(leaf[0])
        active = active[~done[active]] if done is not None else active
        if len(active):
            self._scan(leaf, active)

    def _descend(self, node, active: np.ndarray) -> None:
        """First pass: every query scans the one leaf it falls into."""
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self.seen.setdefault(node[0], np.zeros(len(self.queries), bool))[active] = True
            return self._scan(node, active)
        vantage, inner, outer, bounds = node
        near = _chord(self.queries[active], self.points[vantage][None, :])[:, 0] <= (bounds[1] + bounds[2]) / 2
        self._descend(inner, active[near])
        self._descend(outer, active[~near])

    def _visit(self, node, active: np.ndarray, reach, scan) -> None:
        """The leaves that the triangle inequality does not rule out."""
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            return scan(node, active)
        vantage, inner, outer, (a, b, c, e) = node
        d = _chord(self.queries[active], self.points[vantage][None, :])[:, 0]
        self._visit(inner, active[np.maximum(d - b, a - d) * self.factor <= reach(active)], reach, scan)
        self._visit(outer, active[np.maximum(d - e, c - d) * self.factor <= reach(active)], reach, scan)


def _length(cosine: np.ndarray) -> np.ndarray:
    """The chord between unit vectors of this cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _length(x @ y.T)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosine, computed in extended precision and rounded once, so that vectors of one direction tie whatever their lengths."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.clip(((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).astype(np.float64), -1.0, 1.0)


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Shard:
    """The points of a shard: distinct vectors in a tree, and the ids of each, rising."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        keys = np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        self.by_point = np.argsort(inverse, kind="stable")
        self.starts = np.searchsorted(inverse[self.by_point], np.arange(len(first) + 1))
        self.tree = VantageTree(_unit(self.vectors))

    def nearest(self, asked: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query_id, vec_id, score)`` of the ``k`` best of each query but its own id, ties to the smaller id."""
        unit, todo, points = _unit(vectors), np.arange(len(asked)), k + 1  # one more, as a point may have no id but the query's own
        parts = []
        while len(todo):
            points = min(points, len(self.vectors))
            _, best = self.tree.search(unit[todo], points, factor)
            query, found, score = self._ranked(asked[todo], vectors[todo], unit[todo], best.min(axis=1) - MARGIN, k, factor)
            few = np.bincount(query, minlength=len(todo)) < k
            if points == len(self.vectors):
                few[:] = False
            keep = ~few[query]
            parts.append((asked[todo][query[keep]], found[keep], score[keep]))
            todo, points = todo[few], 4 * points  # the points of these queries have too few ids
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _ranked(self, asked: np.ndarray, vectors: np.ndarray, unit: np.ndarray, least: np.ndarray, k: int, factor: float):
        """The best ``k`` ids of each query, of the points with a cosine of ``least`` or more."""
        query, point = self.tree.at_least(unit, least, factor)
        score = np.empty(len(query))
        for i in range(0, len(query), 65_536):
            score[i : i + 65_536] = cosine(vectors[query[i : i + 65_536]], self.vectors[point[i : i + 65_536]])
        # of one point the k + 1 smallest ids can matter
        n = np.minimum(self.starts[point + 1] - self.starts[point], k + 1)
        rows = np.repeat(np.arange(len(point)), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        found = self.ids[self.by_point[self.starts[point[rows]] + place]]
        query, score = query[rows], score[rows]
        order = np.lexsort((-score, found, query))
        first = np.flatnonzero(np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(found[order]) != 0)])[: len(order)])
        order = order[first]  # an id counts once, with its best vector
        order = order[found[order] != asked[query[order]]]
        order = order[np.lexsort((found[order], -score[order], query[order]))]
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], found[order], score[order]


def _task(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of shards: the points of each, then the queries."""
        at, ids, vectors, shard = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int8)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1) | (np.diff(asked) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
                if i == j:
                    continue
                if at != tuple(keys[i]):
                    at, ids, vectors, shard = tuple(keys[i]), [], [], None
                part = batch.slice(i, j - i)
                own, raw = part.column(3).to_numpy(), part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                if not asked[i]:
                    ids.append(own)
                    vectors.append(raw)
                    continue
                if not ids:
                    continue
                if shard is None:
                    shard = Shard(np.concatenate(ids), np.concatenate(vectors))
                for a in range(0, j - i, BLOCK_QUERIES):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in shard.nearest(own[a : a + BLOCK_QUERIES], raw[a : a + BLOCK_QUERIES], k, factor)], ["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of rows with an id and a vector without null, infinite or NaN components, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` candidates of largest cosine for each query: query_id, rank, vec_id, score.

    All rows of ``vectors`` but those with the query's own id are candidates; ties
    go to the smaller id, however many there are.  With ``factor`` one the result is exact.

    Defined cases: a vector that is null, empty, all zero, or has a null or
    non-finite component takes no part, on either side, and so do null ids; a
    query meets only vectors of its own length; of a query id that has several
    vectors the least counts; repeated rows of one id count as one candidate with its
    best vector; vectors of any length are read whole; fewer than ``k``
    candidates give fewer rows; an empty table gives an empty result; other columns are
    not read.
    """
    points = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(LEAST_SHARDS, -(-vectors.count() // shard_rows))
    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    held = points.select(F.size("v").alias("dim"), shard.alias("shard"), F.lit(False).alias("asked"), "vec_id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    sent = asked.select(F.size("v").alias("dim"), every.alias("shard"), F.lit(True).alias("asked"), "vec_id", "v")
    rows = held.union(sent).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asked")
    found = rows.mapInArrow(_task(k, factor), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
