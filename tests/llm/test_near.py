"""Similarity join, components and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import ngram_join
from ruleloom.llm.ann import VantageTree, nearest
from ruleloom.llm.components import connected_components
from ruleloom.llm.ngram_join import choose_boundary, keep_one, ngram_components, parity
from ruleloom.llm.shingles import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, n int, cid string, keys string"


def brute(docs, width, percent):
    """component and link count by doc, by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    ids = list(sets)
    near = {i: {j for j in ids if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in ids}
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), min(seen), len(near[i]))
    return out


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(4000))
    base = [[word() for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 20, 60, 300]))] for _ in range(n // 4)]
    passage = [word() for _ in range(60)]
    docs = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.2:
            t = t + passage
        text = " ".join(t)
        docs.append((i, text.upper() if rng.random() < 0.1 else text))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A\x0bB  C"), (n + 4, "a b c"), (n + 5, "a b c")]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], SCHEMA)


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("width,percent,cold", [(4, 85, 64), (5, 80, 64), (4, 85, 2)])
def test_join_equals_brute_force(spark, monkeypatch, width, percent, cold):
    monkeypatch.setattr(ngram_join, "COLD", cold)  # also the way by blocks
    monkeypatch.setattr(ngram_join, "BLOCK", 5 if cold == 2 else 512)
    docs = corpus(width)
    assert got(ngram_components(frame(spark, docs), width=width, percent=percent)) == brute(docs, width, percent)


def test_large_components_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_SHINGLES", 600)
    monkeypatch.setattr(ngram_join, "PART_LEAST", 10)
    docs = corpus(7)
    assert got(ngram_components(frame(spark, docs))) == brute(docs, 4, 85)


@pytest.mark.parametrize("boundary", [0, 256])
def test_either_way_of_candidates_is_whole(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_join, "choose_boundary", lambda *a: boundary)
    docs = [d for d in corpus(3) if len((d[1] or "").split()) < 100]
    assert got(ngram_components(frame(spark, docs))) == brute(docs, 4, 85)


def test_repeated_null_and_no_rows(spark):
    rows = frame(spark, [(5, "one two three four five six"), (5, "one two three four five six"), (2, "one two three four five six"), (None, "one two three four five six"), (None, None)])
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_components(rows).collect()), key=repr)
    assert out == sorted([(5, 3, 2, 3), (5, 3, 2, 3), (2, 3, 2, 3), (None, 3, 2, 3), (None, 0, None, 0)], key=repr)
    assert ngram_components(rows.where("doc_id > 99")).collect() == []
    assert sorted(map(repr, ((r.doc_id, r.text) for r in keep_one(rows).collect()))) == sorted(map(repr, [(2, "one two three four five six"), (None, None)]))


def test_keep_one_of_rows_that_share_ids(spark):
    t, u, v = "one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g h"
    pairs = lambda rows: sorted(map(repr, ((r.doc_id, r.text) for r in keep_one(frame(spark, rows)).collect())))
    assert pairs([(0, t), (1, t), (1, u)]) == sorted(map(repr, [(0, t), (1, u)]))
    assert pairs([(None, v), (None, v), (3, v), (None, u), (4, ""), (4, ""), (5, None)]) == sorted(map(repr, [(3, v), (None, u), (4, ""), (4, ""), (5, None)]))
    df = spark.createDataFrame([(1, t, 7, "p"), (2, t, 8, "q")], "doc_id long, text string, number long, `row` string")
    assert [tuple(r) for r in keep_one(df).collect()] == [(1, t, 7, "p")] and keep_one(df).columns == df.columns
    assert keep_one(df.where("doc_id > 5")).collect() == []


def test_words_that_break_polynomial_hashes():
    """Thue-Morse words, which collide under every polynomial modulo a power of two."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    hashes, _ = word_hashes([one.encode(), other.encode(), (one + "a").encode(), b"a", b"\x00", b"aa"])
    assert len(set(hashes.tolist())) == 6
    long = "".join(chr(97 + i % 26) for i in range(5000))
    swapped = long[:4000] + long[4001] + long[4000] + long[4002:]
    assert len(set(word_hashes([long.encode(), swapped.encode()])[0].tolist())) == 2


def test_very_long_text(spark):
    long = " ".join(f"t{i % 50_000}" for i in range(120_000))
    out = got(ngram_components(frame(spark, [(1, long), (2, long + " end"), (3, "x" * 300_000)])))
    assert out[1][1] == out[2][1] == 1 and out[3] == (1, 3, 0)


def test_boundary_follows_cost():
    assert choose_boundary({300: 10}, 1.0, 85) == 0 or choose_boundary({300: 10}, 1.0, 85) < 300
    assert choose_boundary({10: 1000}, 500.0, 85) >= 10  # long lists: subsets are cheaper


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[30:], rng.integers(0, 2**63, 20).astype(np.uint64)]))
    apart = int(np.bitwise_count(parity(a).view(np.uint64) ^ parity(b).view(np.uint64)).sum())
    assert 0 < apart <= len(np.setxor1d(a, b))


def test_shingles_keep_to_ascii_rules():
    a, b, c, d = shingle_sets(["A b\x0bC", "a B\tc", "a\x1cb c", None], 4)
    assert (a == b).all() and len(c) == 1 and c[0] != a[0] and len(d) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.cid: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def vectors(n=400, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[50:80] = v[10]  # copies
    v[90] = 2 * v[11]  # the same direction
    return v


def brute_nearest(v, q, k):
    x = v.astype(np.float64)
    s = (x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
    order = [i for i in np.lexsort((np.arange(len(x)), -np.round(s, 12))) if i != q]
    return order[:k]


def test_factor_one_is_exact(spark):
    v = vectors()
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] + [1.0] * 7), (1004, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (1050, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=60).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = r
    assert sorted(out) == list(range(0, 400, 50))
    for q, found in out.items():
        assert [found[i].vec_id for i in range(1, 6)] == brute_nearest(v, q, 5)


@pytest.mark.parametrize("shard_rows", [60, 10_000])
def test_ties_of_any_number_are_whole(spark, shard_rows):
    """More than 100 ties at the cut: powers of two of one vector, and copies of others."""
    import duckdb

    from ruleloom.llm.queries_near import OP2_SQL

    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).round(3)
    rows = [(1000 + i, [float(x) for x in base[0] * 2.0 ** (i % 60 - 30)]) for i in rng.permutation(300).tolist()]
    rows += [(2000 + i, [float(x) for x in base[i % 5]]) for i in range(150)] + [(3000 + i, [float(x) for x in base[i % 40]]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    embeddings = df.toArrow()  # noqa: F841
    want = duckdb.sql(OP2_SQL).fetchall()
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, df.where("vec_id % 50 = 0"), shard_rows=shard_rows).collect()]
    assert sorted(g[:3] for g in got) == sorted(w[:3] for w in want)
    assert np.allclose([g[3] for g in sorted(got)], [w[3] for w in sorted(want)], rtol=0, atol=1e-15)


def test_directions_tie_whatever_the_lengths(spark):
    rng = np.random.default_rng(8)
    d = rng.integers(-9, 10, 8)
    rows = [(101 + 8 * int(i), [float(x) for x in d * n]) for i, n in enumerate(rng.permutation(400) + 1)] + [(50, [float(x) for x in d + np.arange(8)])]
    rows += [(5000 + i, [float(x) for x in -d + rng.normal(size=8)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest(df, df.where("vec_id = 50"), shard_rows=50).orderBy("rank").collect()] == [101, 109, 117, 125, 133]


def test_repeated_ids_have_one_vector_as_query_and_the_best_as_candidate(spark):
    df = spark.createDataFrame([(50, [2.0, 1.0]), (50, [1.0, 2.0]), (7, [0.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df, df.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [(1, 7, 0.8), (2, 8, round(2 / 5**0.5, 6))] or got == [(1, 7, 1.0), (2, 8, round(1 / 5**0.5, 6))]
    rng = np.random.default_rng(1)
    near = [(9, [1.0, 2.0 + x]) for x in rng.random(300).tolist()] + [(50, [1.0, 2.0 + x]) for x in rng.random(300).tolist()]
    many = spark.createDataFrame(near + [(i, [1.0, -float(i)]) for i in range(10, 16)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in nearest(many, many.where("vec_id = 50")).orderBy("rank").collect()]
    assert got == [9, 10, 11, 12, 13]


def test_few_candidates_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest(df, df.where("vec_id % 50 = 0")).collect()] == [(0, 1, 1)]
    assert nearest(df.where("vec_id < 0"), df.where("vec_id < 0")).collect() == []


def test_relaxed_pruning_keeps_recall():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:100]
    true = np.argsort(-(q @ x.T), axis=1)[:, :5]
    for factor, least in ((1.0, 1.0), (1.3, 0.9)):
        found, _ = VantageTree(x).search(q, 5, factor)
        recall = np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, true)])
        assert recall >= least
