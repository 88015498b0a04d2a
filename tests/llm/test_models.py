"""Toxicity by held-out accuracy, and language-model scores against a plain loop; and the pipeline."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleloom.llm import lm_score, toxicity
from ruleloom.llm.boosting import fit_boosted, isotonic
from ruleloom.llm.toxicity import drop_toxic, fit_toxicity, held_out, score_toxicity

SF = "/root/testdata/sf0.001"


def toxic_docs(n=700, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum!", "You moron", "qzqzab", "qzqzcd,"]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.8:
            labels.append((i, int(bad)))
    return docs, labels, {i: y for i, y in labels}


def test_toxicity_learns_words_and_beginnings(spark):
    docs, labels, y = toxic_docs()
    extra = [(10_000, None), (10_001, ""), (10_002, "z" * 100_000), (None, "you idiot scum"), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 5, "s") for d in docs + extra], "doc_id long, text string, score int, predicted string")
    lb = spark.createDataFrame([(*x, 0) for x in labels] + [(None, 1, 0), (10_000, 0, 0)], "doc_id long, toxic int, text int")
    model = fit_toxicity(df, lb)
    out = score_toxicity(df, model).collect()
    assert len(out) == len(docs) + len(extra) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in y]
    assert all(r.held_out == held_out(r.doc_id) for r in out)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    assert [r.predicted for r in out if r.doc_id is None] == [1] and [r.predicted for r in out if r.doc_id == 10_001] == [0]
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_held_out_labels_do_not_matter(spark):
    docs, labels, _ = toxic_docs(200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - t if held_out(i) else t) for i, t in labels]
    a, b = (fit_toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.lexicon == b.lexicon and (a.at == b.at).all() and all((p[2] == q[2]).all() for p, q in zip(a.trees.trees, b.trees.trees))


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in score_toxicity(df, fit_toxicity(df, none)).collect()} == {0}
    assert score_toxicity(df.where("doc_id > 5"), fit_toxicity(df.where("doc_id > 5"), none)).collect() == []


def test_words_of_any_length_count_whole():
    codes = toxicity.WordCodes({})
    for text in ("A" * 9000 + " b", "!" * 5000 + "A" * 5000 + " ok", "x" * 4095 + " " + "Y" * 4096, "plain words"):
        words = text.split()
        letters = sum(map(len, words))
        x = toxicity.features(text, codes)
        assert x[11] == sum(c.isupper() for c in text) / letters and x[12] == sum(not c.isalnum() for w in words for c in w) / letters
    a, b = "verylongword" * 10 + "a", "verylongword" * 10 + "b"
    assert toxicity.terms(a)[0] != toxicity.terms(b)[0] and toxicity.terms(a)[1:] == toxicity.terms(b)[1:] and "abcdefghijklmnopqrstuvwxyz$" in toxicity.terms("abcdefghijklmnopqrstuvwxyz")


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    raw = fit_boosted(x[:600], y[:600]).raw(x[600:])
    assert ((raw > 0) == y[600:]).mean() > 0.9
    at, p = isotonic(raw, y[600:])
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= 0).all()
    at, p = isotonic(np.array([1.0, 2.0, 3.0]), np.array([1.0, 0.0, 1.0]))
    assert p[0] == p[1] < p[2]


def test_pseudo_likelihood_equals_a_loop(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mat", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 60)))) for i in range(80)] + [(80, None), (81, " \n"), (None, "the cat"), (3, "the cat sat")]
    df = spark.createDataFrame([(*d, 1, 2.0) for d in docs], "doc_id long, text string, n_tokens int, score double")
    table, net = lm_score.fit(df)
    got = sorted(((r.doc_id, r.n_tokens, r.score, r.mean_score) for r in lm_score.score_documents(df).collect()), key=repr)
    assert len(got) == len(docs)
    by_text = {t: (n, s) for t, (n, s) in zip([t for _, t in docs], lm_score.score_texts([t for _, t in docs], table, net))}
    assert sorted(round(s, 4) for _, _, s, _ in got) == sorted(round(by_text[t][1], 4) for _, t in docs)
    for _, text in docs[:5]:
        slots = [int(s) for g, _ in lm_score._groups([text]) for s in g]
        ids = [int(table[s]) for s in slots]
        total = 0.0
        for i, target in enumerate(ids):
            h = net.shift.astype(float).copy()
            for w, j in zip(net.place, lm_score.SHIFTS):
                h += w * net.embed[ids[i + j] if 0 <= i + j < len(ids) else lm_score.PAD]
            h = np.tanh(h)
            a, b = net.to_class @ h + net.class_bias, net.to_word[target >> 6] @ h + net.word_bias[target >> 6]
            total += a[target >> 6] - np.log(np.exp(a).sum()) + b[target & 63] - np.log(np.exp(b).sum())
        assert abs(total - by_text[text][1]) < 1e-3 * max(1, len(ids))
    empty = [g for g in got if g[1] == 0]
    assert len(empty) == 2 and all(g[2] == 0 and g[3] is None for g in empty)


def test_training_beats_frequencies(spark):
    rng = random.Random(4)
    pairs = [("left", "right"), ("up", "down"), ("hot", "cold")]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(60)]
    slots = [lm_score._groups(texts)]
    table = np.arange(1 << lm_score.SLOT_BITS) % lm_score.TOKENS
    counts = np.zeros(lm_score.TOKENS)
    for group in slots[0]:
        counts += np.bincount(table[group[0]], minlength=lm_score.TOKENS)
    start = lm_score.Network.start(counts)
    net, seen = lm_score.train_on(iter([texts] * 80), table, start)
    mean = lambda n: np.mean([s / k for k, s in lm_score.score_texts(texts[:10], table, n)])
    assert seen > 0 and mean(net) > mean(start) + 0.1
    assert (start.load(start.flat()).flat() == start.flat()).all()


@pytest.mark.parametrize("known", [0, 3000, 1 << 18])
def test_every_word_has_a_probability_of_its_own(spark, monkeypatch, known):
    monkeypatch.setattr(lm_score, "KNOWN", known)
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{min(rng.randrange(9000), rng.randrange(9000))}" for _ in range(300))) for i in range(80)] + [(None, "w1 w2"), (3, ""), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table, net = lm_score.fit(df)
    counts = Counter(w for _, t in docs for w in (t or "").split())
    token = {w: int(table[next(lm_score._groups([w]))[0][0]]) for w in counts}
    assert len(counts) > lm_score.TOKENS  # so that words share tokens
    whole = Counter()
    for w, n in counts.items():
        whole[token[w]] += n
    want = [s + sum(np.log(counts[w] / whole[token[w]]) for w in (t or "").split()) for (_, t), (_, s) in zip(docs, lm_score.score_texts([t for _, t in docs], table, net))]
    got = lm_score.score_documents(df).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (i for i, _ in docs)))
    assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-3)


def test_scores_do_not_depend_on_the_split_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_WORDS", 700)
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", f"w{rng.randrange(99)}"]) for _ in range(rng.randrange(80)))) for i in range(150)], "doc_id long, text string")
    want = sorted((r.doc_id, r.score) for r in lm_score.score_documents(df.coalesce(1)).collect())
    assert want == sorted((r.doc_id, r.score) for r in lm_score.score_documents(df.repartition(7)).collect())


def test_every_token_is_a_target():
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(70)) for i in range(90)] + [None, ""]
    table = np.arange(1 << lm_score.SLOT_BITS) % lm_score.TOKENS
    start = lm_score.Network.start(np.ones(lm_score.TOKENS))
    assert lm_score.train_on(iter([texts[:40], texts[40:]]), table, start)[1] == 90 * 70


def test_scores_of_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").where("doc_id > 5")
    assert lm_score.score_documents(df).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp
    from tests.llm.test_near import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {"start": docs}
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = after[name] = spark.read.parquet(str(tmp_path / name))
        if name != cp.STAGES[-1][0]:
            assert docs.columns == after["start"].columns
    ids = lambda n: {r.doc_id for r in after[n].select("doc_id").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    dropped = ids("start") - ids("toxicity")
    assert dropped and len(dropped & clean) <= 0.05 * len(clean)
    groups = brute([(r.doc_id, r.text) for r in after["toxicity"].collect()], 5, 80)
    assert ids("near_duplicates") == {i for i, (_, c, _) in groups.items() if c == i}
    from ruleloom.llm.pii import Surrogates, replace

    texts = {r.doc_id: r.text for r in after["near_duplicates"].collect()}
    assert {r.doc_id: r.text for r in after["personal_data"].collect()} == {i: replace(t, Surrogates())[0] if t else t for i, t in texts.items()}
    assert all(r.n_chars == len(r.text or "") for r in after["personal_data"].collect())
    assert ids("source_mix") <= ids("personal_data")
    coded = after["byte_pair_encoding"].collect()
    mixed = sorted(r.text or "" for r in after["source_mix"].collect())
    assert sorted(r.decoded for r in coded) == mixed
    assert cp.run(spark, SF).count() == len(coded)
