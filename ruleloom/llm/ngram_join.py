"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

Documents with equal shingle sets form a class, and only classes are joined.
Every class sorts its shingles by one global order (shingles of the heavy list
last, by rising count; all others by hash) and shows only a prefix of it:

* small classes (at most ``boundary`` shingles) enumerate the subsets of two
  shingles of a prefix two longer than the mismatches that the threshold allows;
  two similar small sets share such a subset;
* large classes put single prefix shingles into inverted lists, and every class
  whose size allows a link with a large one scans these lists.

``boundary`` minimises the number of keys written plus lists scanned, from the
size histogram and the mean list length of this very corpus.  Both prefixes are
lossless, so every link is found.  Lists of at most ``COLD`` members become
candidate pairs; longer lists are cut into blocks of bounded size that are
compared block by block.  A parity of each set, two bits a shingle, gives a lower
bound of the difference of two sets, which drops nearly all candidates that are no
links; the rest are verified on whole shingle sets.

The heavy list has at most ``HEAVY_MOST`` entries (1 MB) whatever the input, and
any list gives the same result: it only moves frequent shingles out of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.batches import bound, small
from ruleloom.llm import scratch
from ruleloom.llm.components import connected_components
from ruleloom.llm.shingles import mix, shingle_sets

HEAVY_MOST = 1 << 17
HEAVY_FROM = 64
COLD = 64
BLOCK = 512
PARITY_LEAST, PARITY_MOST = 1 << 10, 1 << 17
PART_SHINGLES, PART_LEAST = 1 << 20, 1 << 10
BITMAP_BITS = 1 << 24
VERIFY_COST = 4.0
SMALL_MOST = 256


def need(size: int, percent: int) -> int:
    """Least overlap with any partner: ceil(percent * size / 100)."""
    return -(-percent * size // 100)


def need_larger(size: int, percent: int) -> int:
    """Least overlap with a partner that is at least as large."""
    return -(-2 * percent * size // (100 + percent))


def choose_boundary(histogram: dict[int, int], list_length: float, percent: int) -> int:
    """Largest small size, by least cost.

    Subsets cost one key each; a single shingle costs its key and the scan and
    verification of the other members of its list.
    """
    best, best_cost = 0, None
    for b in range(SMALL_MOST + 1):
        cost = 0.0
        for size, n in histogram.items():
            p = size - need(size, percent)
            scan = (p + 1) * (1 + VERIFY_COST * max(0.0, list_length - 1))
            if size > b:
                cost += n * scan
            else:
                cost += n * ((p + 2) * (p + 1) / 2)
                if 100 * size >= percent * (b + 1):
                    cost += n * (size - need_larger(size, percent) + 1)
        if best_cost is None or cost < best_cost:
            best, best_cost = b, cost
    return best


def parity(s: np.ndarray) -> np.ndarray:
    """For each of twice as many bits as shingles: whether an odd number of shingles falls on it.

    Two sets whose parities differ in d bits differ in at least d shingles.  A longer
    parity folds onto half its length by exclusive or.
    """
    bits = min(PARITY_MOST, max(PARITY_LEAST, 1 << (2 * len(s) - 1).bit_length()))
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _counts(width: int):
    """Per partition: shingles seen often, list-length moments and the size histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, moments = {}, [0, 0]
        kept, times, buffer, held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def fold(kept, times, buffer):
            values, n = np.unique(np.concatenate(buffer), return_counts=True)
            low = n[n < HEAVY_FROM]
            moments[0] += int(low.sum())
            moments[1] += int((low * low).sum())
            often = n >= 4
            values, inverse = np.unique(np.concatenate([kept, values[often]]), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([times, n[often]])).astype(np.int64)
            if len(values) > HEAVY_MOST:
                top = np.argpartition(-total, HEAVY_MOST)[:HEAVY_MOST]
                values, total = values[top], total[top]
            return values, total

        for batch in small(batches):
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s):
                    sizes[min(len(s), SMALL_MOST + 1)] = sizes.get(min(len(s), SMALL_MOST + 1), 0) + 1
                    buffer.append(s)
                    held += len(s)
                if held > 2_000_000:
                    kept, times = fold(kept, times, buffer)
                    buffer, held = [], 0
        if buffer:
            kept, times = fold(kept, times, buffer)
        rows = [(0, int(v), int(n)) for v, n in zip(kept.view(np.int64), times)]
        rows += [(1, 0, moments[0]), (1, 1, moments[1])] + [(2, s, n) for s, n in sizes.items()]
        for i in range(0, len(rows), 65536):
            part = list(zip(*rows[i : i + 65536]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["kind", "value", "n"])

    return run


def _keys(width: int, percent: int, boundary: int, heavy: np.ndarray, rank: np.ndarray):
    """Per document: set size, class id and the keys under which its class is found."""

    def keys_of(s: np.ndarray) -> np.ndarray:
        n = len(s)
        if n == 1:  # a link needs an equal set, which is the same class
            return np.empty(0, np.uint64)
        take = n - need(n, percent) + 2
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
            is_heavy = heavy[at] == s
            late = at[is_heavy]
            order = np.concatenate([s[~is_heavy][:take], s[is_heavy][np.argsort(rank[late], kind="stable")]])[:take]
        else:
            order = s[:take]
        out = []
        if n <= boundary:
            i, j = np.triu_indices(len(order), 1)
            out.append((mix(order[i] * np.uint64(0x9E3779B97F4A7C15) + order[j]) & ~np.uint64(3)) | np.uint64(2))
        if n > boundary or 100 * n >= percent * (boundary + 1):
            index = n - need_larger(n, percent) + 1
            single = mix(order[: n - need(n, percent) + 1] + np.uint64(1)) & ~np.uint64(3)
            out.append(single[:index] | np.uint64(1))
            if n > boundary:
                out.append(single[index:])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in small(batches):
            sizes, ids, keys, marks, none = [], [], [], [], np.empty(0, np.uint64)
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                cid = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                ids.append(cid - (1 << 64) if cid is not None and cid >> 63 else cid)
                if cid is None or cid in seen:
                    keys.append(none)
                    marks.append(None)
                else:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(cid)
                    keys.append(keys_of(s))
                    marks.append(parity(s))
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = np.concatenate(keys) if keys else none
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), lists, pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "n", "cid", "keys", "parity"])

    return run


def _sets(width: int):
    """Class id and whole shingle set of every row that comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, sets = [], []
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s):
                    cid = xxhash.xxh3_64_intdigest(s.tobytes())
                    ids.append(cid - (1 << 64) if cid >> 63 else cid)
                    sets.append(s.view(np.int64))
            for i in range(0, len(ids), 500):
                part = sets[i : i + 500]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in part])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 500], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part)))], ["cid", "shingles"])

    return run


def _allowed(marks: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (one of ``left``, one of ``right``) that parities and sizes do not rule out, each unordered pair once."""
    words = np.array([len(m) for m in marks])
    same = left is right
    some_i, some_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in np.unique(words[left]):
        for q in np.unique(words[right]):
            if max(p, q) > 2 * min(p, q):
                continue  # sizes too far apart for a link
            least, li, ri = min(p, q), left[words[left] == p], right[words[right] == q]
            x, y = (np.stack([m if len(m) == least else m[:least] ^ m[least:] for m in (marks[i] for i in side)]) for side in (li, ri))
            apart = np.zeros((len(li), len(ri)), np.int32)
            for w in range(least):
                apart += np.bitwise_count(x[:, w][:, None] ^ y[:, w][None, :])
            i, j = np.nonzero((100 + percent) * apart <= (100 - percent) * (sizes[li][:, None] + sizes[ri][None, :]))
            some_i.append(li[i])
            some_j.append(ri[j])
    i, j = np.concatenate(some_i), np.concatenate(some_j)
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    ok = (100 * small >= percent * large) & ((i < j) if same else (i != j))
    return i[ok], j[ok]


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Of some edges those that join two trees: as connected, and fewer than nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[a] = b
            out.append((x, y))
    return out


def _block_candidates(percent: int):
    """Of the candidate pairs of one block, or of two, a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        first, second = table["first"][0].as_py(), table["second"][0].as_py()
        block, ids, sizes = table["block"].to_numpy(), table["cid"].to_numpy(), table["n"].to_numpy()
        marks = [np.asarray(x.values).view(np.uint64) for x in table["parity"]]
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        edges = _forest(*_allowed(marks, sizes, left, right, percent))
        return pa.table({"a": pa.array([int(ids[x]) for x, _ in edges], pa.int64()), "b": pa.array([int(ids[y]) for _, y in edges], pa.int64())})

    return run


def _verify(percent: int):
    """Links within the components of a task, on whole sets: a spanning forest (b set), and what each class links with (b null)."""

    def run(table: pa.Table) -> pa.Table:
        roots, first, second, part = (table[c].to_numpy() for c in ("root", "first", "second", "part"))
        ids, copies = table["cid"].to_numpy(), table["copies"].to_numpy()
        sets = [np.asarray(x.values).view(np.uint64) for x in table["shingles"]]
        out_a, out_b, out_n = [], [], []
        for r in np.unique(roots):
            rows = np.flatnonzero(roots == r)
            _, once = np.unique(np.stack([ids[rows], part[rows]]), axis=1, return_index=True)
            rows = rows[once]
            mine = [sets[i] for i in rows]
            sizes = np.array([len(s) for s in mine], np.int64)
            left = np.flatnonzero(part[rows] == first[rows[0]])
            right = left if first[rows[0]] == second[rows[0]] else np.flatnonzero(part[rows] == second[rows[0]])
            i, j = _allowed([parity(s).view(np.uint64) for s in mine], sizes, left, right, percent)
            ok = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i, j)):
                both = np.sort(np.concatenate([mine[x], mine[y]]), kind="stable")
                o = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * o >= percent * (sizes[x] + sizes[y] - o)
            i, j = i[ok], j[ok]
            linked = np.bincount(i, copies[rows][j], len(rows)) + np.bincount(j, copies[rows][i], len(rows))
            for x in np.flatnonzero(linked):
                out_a.append(int(ids[rows[x]]))
                out_b.append(None)
                out_n.append(int(linked[x]))
            for x, y in _forest(i, j):
                out_a.append(int(ids[rows[x]]))
                out_b.append(int(ids[rows[y]]))
                out_n.append(0)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "linked": pa.array(out_n, pa.int64())})

    return run


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS))


def _with_bit(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be in ``wanted``: a bitmap of at most BITMAP_BITS / 64 rows is broadcast."""
    bits = wanted.select(_slot(F.col(column)).alias("s")).groupBy(F.expr("s div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("__bits"))
    marked = rows.withColumn("__slot", _slot(F.col(column))).withColumn("__word", F.expr("__slot div 64"))
    return marked.join(F.broadcast(bits), "__word").where(F.expr("shiftright(__bits, cast(__slot % 64 as int)) & 1L = 1L"))


def ngram_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """Documents with their class, and the links between classes of different sets.

    Returns ``(doc_id, n, cid)``, one row per input row (``cid`` null without
    words), and rows of two kinds: ``(a, b)`` are links that connect all that links
    connect, ``(a, null, linked)`` say with how many documents of other classes a
    class links (summed over rows).
    """
    bound(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = own.select("text").mapInArrow(_counts(width), "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counted = counted.where((F.col("kind") > 0) | (F.col("n") >= HEAVY_FROM))
    stats = counted.orderBy(F.desc("kind"), F.desc("n"), "value").limit(HEAVY_MOST + SMALL_MOST + 3).collect()
    rows = [(r.n, r.value) for r in stats if r.kind == 0][::-1]  # at most HEAVY_MOST
    heavy = np.array([v for _, v in rows], np.int64).view(np.uint64)
    by_hash = np.argsort(heavy)
    moment = {r.value: r.n for r in stats if r.kind == 1}
    length = moment.get(1, 0) / max(1, moment.get(0, 0))
    boundary = choose_boundary({r.value: r.n for r in stats if r.kind == 2}, length, percent)

    keyed = scratch.cut(own.mapInArrow(_keys(width, percent, boundary, heavy[by_hash], by_hash.astype(np.int64)), "doc_id long, n long, cid long, keys array<long>, parity array<long>"), "keys")
    docs_out = keyed.select("doc_id", "n", "cid")

    entries = keyed.select("cid", "n", F.explode("keys").alias("k")).select(F.expr("shiftright(k, 2)").alias("key"), F.expr("cast(k & 3 as int)").alias("role"), "cid", "n")
    in_list = Window.partitionBy("key")
    entries = entries.repartition("key").dropDuplicates(["key", "cid", "role"]).withColumn("members", F.count("*").over(in_list)).where("members > 1")
    entries = scratch.cut(entries, "lists")

    x, y = entries.where(F.col("members") <= COLD).alias("x"), entries.where(F.col("members") <= COLD).alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))
    fits = (100 * F.col("x.n") >= percent * F.col("y.n")) & (((F.col("x.role") == 2) & (F.col("y.role") == 2)) | ((F.col("x.role") == 1) & (F.col("y.role") < 2) & (F.col("y.n") > boundary)))
    pairs = x.join(y, "key").where(smaller & fits).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total")).where("a < b").distinct()

    sketch = keyed.where("parity is not null").select("cid", "parity").dropDuplicates(["cid"])
    one, two = sketch.select(F.col("cid").alias("a"), F.col("parity").alias("pa")), sketch.select(F.col("cid").alias("b"), F.col("parity").alias("pb"))
    fold = lambda p, q: F.when(F.size(p) > F.size(q), F.zip_with(F.slice(p, 1, F.size(q)), F.slice(p, F.size(q) + 1, F.size(q)), lambda v, w: v.bitwiseXOR(w))).otherwise(F.col(p))
    apart = F.aggregate(F.zip_with(fold("pa", "pb"), fold("pb", "pa"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    pairs = pairs.join(one, "a").join(two, "b").where((100 + percent) * apart <= (100 - percent) * F.col("total")).select("a", "b")

    hot = entries.where(F.col("members") > COLD).select("key", "cid", "n").distinct()
    by_size = Window.partitionBy("key").orderBy("n", "cid")
    hot = scratch.cut(hot.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / BLOCK)), "blocks")
    span = hot.groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    p, q = span.alias("p"), span.alias("q")
    tasks = p.join(q, "key").where((F.col("p.block") <= F.col("q.block")) & (100 * F.col("p.high") >= percent * F.col("q.low")))
    tasks = tasks.select("key", F.col("p.block").alias("first"), F.col("q.block").alias("second"))
    tasks = tasks.select("key", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    sent = tasks.join(hot, ["key", "block"]).join(sketch, "cid")
    hot_pairs = sent.groupBy("key", "first", "second").applyInArrow(_block_candidates(percent), "a long, b long")
    pairs = scratch.cut(pairs.union(hot_pairs), "pairs")

    # The candidates' components meet in tasks, so that a set is sent once and not for every pair; there
    # all pairs of a component are compared.  A large component is cut into parts, and a task has one or two.
    classes = docs_out.where("cid is not null").groupBy("cid").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = connected_components(pairs).join(classes, "cid")
    nodes = nodes.withColumn("part", F.expr(f"(sum(greatest(n, {PART_LEAST})) OVER (PARTITION BY root ORDER BY n, cid) - greatest(n, {PART_LEAST})) div {PART_SHINGLES}"))
    nodes = scratch.cut(nodes, "nodes")
    total = nodes.agg(F.sum("n").alias("t")).first().t or 0
    span = nodes.groupBy("root", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    p, q = span.alias("p"), span.alias("q")
    tasks = p.join(q, "root").where((F.col("p.part") <= F.col("q.part")) & (100 * F.col("p.high") >= percent * F.col("q.low")))
    tasks = tasks.select("root", F.col("p.part").alias("first"), F.col("q.part").alias("second"))
    # components of one part share tasks; the others have one for each pair of parts
    alone = F.col("first") + F.col("second") > 0
    task = F.when(alone | F.col("several"), F.concat_ws(",", "root", "first", "second")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(12, -(-2 * total // PART_SHINGLES)))).cast("string"))
    several = span.groupBy("root").agg((F.max("part") > 0).alias("several"))
    tasks = tasks.join(several, "root").withColumn("task", task).withColumn("part", F.explode(F.array_distinct(F.array("first", "second"))))
    needed = tasks.join(nodes.select("root", "part", "cid", "copies"), ["root", "part"]).select("task", "root", "first", "second", "part", "cid", "copies")
    sets = _with_bit(own, nodes.select("doc_id"), "doc_id").select("text").mapInArrow(_sets(width), "cid long, shingles array<long>")
    found = needed.join(sets, "cid").groupBy("task").applyInArrow(_verify(percent), "a long, b long, linked long")
    found = scratch.cut(found, "links")
    scratch.drop(entries, hot, pairs, nodes)
    return docs_out, found


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    Links join documents with ``100 * |A & B| >= percent * |A | B|``.
    ``component_id`` is the smallest doc_id reachable by links, itself included;
    ``n_links`` counts the rows linked directly, copies included.

    Defined cases: a null, empty or blank text has no shingles, links with
    nothing and keeps its own doc_id as component (null for a null doc_id);
    fewer than ``width`` words are one shingle; repeated rows are linked copies;
    texts of any length are read whole; a null doc_id takes part but is never a smallest id; an empty table gives an
    empty result; other columns of ``docs`` are not read.  Shingles and sets
    are told apart by 64-bit hashes.
    """
    rows, links = ngram_links(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    labels = connected_components(links.where("b is not null").select("a", "b"))
    degree = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("linked").alias("linked"))
    classes = classes.join(labels, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(degree, "cid", "left")
    roots = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = classes.join(roots, "root").select("cid", "component_id", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    joined = rows.join(known, "cid", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of linked rows the one of the smallest id, and of rows with that id the one of the least number; others go.

    Defined cases: rows without words (null, empty, blank) all stay, as they link with
    nothing; rows that repeat an id with different texts are rows of their own, told
    apart by a number hashed from both; of repeated rows one stays; a row with a null
    id stays only where no row of its component has an id; texts of any length are read
    whole; an empty table gives an empty result; other columns may have any names.
    """
    text, own_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    number = F.xxhash64(F.coalesce(own_id.cast("string"), F.lit("null")), F.lit("|"), text)
    worded = docs.where(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    numbered = worded.select(number.alias("number"), own_id.alias("id"), text.alias("text"))
    rows, links = ngram_links(numbered, id_col="number", width=width, percent=percent)
    labels = connected_components(links.where("b is not null").select("a", "b"))
    named = rows.join(numbered.select(F.col("number").alias("doc_id"), "id").distinct(), "doc_id").join(labels, "cid", "left")
    least = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "doc_id"))  # rows with an id first
    kept = scratch.cut(named.groupBy(F.coalesce("root", "cid")).agg(least.alias("k")).select(F.col("k.doc_id").alias("number")), "kept")
    packed = worded.select(number.alias("number"), own_id.alias("id"), F.xxhash64(text).alias("check"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    packed = packed.join(kept, "number", "left_semi").dropDuplicates(["number", "id", "check"])
    blank = docs.where(~F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return packed.select("row.*").union(blank)
