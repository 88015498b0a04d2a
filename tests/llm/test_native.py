"""URL filter, source mixing and sharding against plain Python."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ruleloom.llm import mixing, url_filter
from ruleloom.llm.mixing import mix, schedule, source_targets, take
from ruleloom.llm.sharding import shard
from ruleloom.llm.url_filter import ALPHABET, SIZE, Rule, judge_urls

RULES = [Rule.parse("block", "net/"), Rule.parse("allow", "example.net/en/"), Rule.parse("block", "example.com/de/"), Rule.parse("allow", "org/fr/")]


def urls():
    rng = random.Random(4)
    out = []
    for _ in range(300):
        host = rng.choice(["", "www.", "m."]) + rng.choice(["abc", "thing", "xy"]) + "." + rng.choice(["example.net", "example.com", "example.org"])
        out.append(f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.randrange(999)}{rng.choice(['', '?q=1', '#t', '.html'])}")
    return out + ["HTTP://WWW.Example.NET/EN/1", "http://example.net/en/", "http://notexample.net", "http://net", "http://net/", "no scheme", "", None, "ftp://a.org:80/fr/x", "http://é.org/fr/ü漢", "http://" + "a" * 60_000 + ".org/fr/"]


def parts(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def codes(u):
    t = u.lower().translate(str.maketrans("123456789", "0" * 9))
    t = "^" * (url_filter.ORDER - 1) + re.sub(r"[^a-z0/.\-_?=&%#:~]", "*", t) + "$"
    return [ALPHABET.index(c) for c in t]


class Model:
    """Witten-Bell interpolation, from counts; contexts of three and more characters only where ``kept`` has them."""

    def __init__(self, texts, kept=()):
        self.kept = kept
        self.n = [collections.Counter() for _ in range(url_filter.ORDER)]
        for u in texts:
            c = codes(u)
            for i in range(url_filter.ORDER - 1, len(c)):
                for k in range(url_filter.ORDER):
                    self.n[k][tuple(c[i - k : i + 1])] += 1
        self.after = [collections.defaultdict(list) for _ in self.n]
        for k, counts in enumerate(self.n):
            for g, n in counts.items():
                self.after[k][g[:-1]].append(n)

    def p(self, gram):
        out = 1.0 / SIZE
        for k in range(url_filter.ORDER):
            ctx = gram[len(gram) - 1 - k : len(gram) - 1]
            if k > 2 and ctx not in self.kept:
                break
            same = self.after[k][ctx]
            c, t = sum(same), len(same)
            if c:
                out = (self.n[k].get(ctx + gram[-1:], 0) + t * out) / (c + t)
        return out


def kept_contexts(texts, most):
    """Contexts of three and four characters that the examples have at least eight times, from a count on at which at most ``most`` are left."""
    counts = collections.Counter()
    for u in texts:
        c = codes(u)
        for i in range(url_filter.ORDER - 1, len(c)):
            for k in (3, 4):
                counts[tuple(c[i - k : i])] += 1
    step = lambda n: math.floor(math.log2(n) * url_filter.STEPS)
    often = {c: step(n) for c, n in counts.items() if n >= url_filter.LEAST_COUNT}
    least = min((b for b in set(often.values()) if sum(x >= b for x in often.values()) <= most), default=1 << 30)
    return {c for c, b in often.items() if b >= least}


@pytest.mark.parametrize("most", [url_filter.MOST_CONTEXTS, 40, 0])
def test_contexts_of_any_order(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_CONTEXTS", most)
    rng = random.Random(1)
    texts = {f"http://{rng.choice(['aa', 'ab', 'news', 'shop'])}.{rng.choice(['org', 'net'])}/{rng.choice(['fr', 'de'])}/{'x' * rng.randrange(9)}{i}": rng.choice(["allow", "block"]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "url string, verdict string")
    table = {r.g: r.ratio for r in url_filter.fit(df, spark).collect()}
    kept = kept_contexts(texts, most)
    assert len(table) == SIZE**3 + SIZE * len(kept) and (len(kept) > 40) == (most > 40)
    m = {v: Model([u for u in texts if texts[u] == v], kept) for v in ("allow", "block")}
    scored = {r.url: r.score for r in url_filter._scores(df, ["url"], url_filter.fit(df, spark)).collect()}
    for u in list(texts)[:20]:
        c = codes(u)
        grams = [tuple(c[i - url_filter.ORDER + 1 : i + 1]) for i in range(url_filter.ORDER - 1, len(c))]
        want = sum(math.log(m["allow"].p(g)) - math.log(m["block"].p(g)) for g in grams) / len(grams)
        assert abs(scored[u] - want) < 1e-6


@pytest.mark.parametrize(("most", "shares"), [(0, 1), (0, 40), (40, 4), (40, 1 << 12)])
def test_contexts_beyond_the_broadcast_table_count(spark, monkeypatch, most, shares):
    rng = random.Random(2)
    texts = [f"http://{rng.choice(['aa', 'ab', 'news', 'shop'])}.{rng.choice(['org/fr', 'net/de'])}/{'x' * rng.randrange(9)}{i}" for i in range(60)]
    texts += ["http://news.xyz/" + "shop" * i for i in range(9)] + ["", None, texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, url string")
    whole = {r.page_id: r for r in judge_urls(df, RULES).collect()}
    monkeypatch.setattr(url_filter, "MOST_CONTEXTS", most)
    monkeypatch.setattr(url_filter, "SHARES", shares)
    assert {r.page_id: r for r in judge_urls(df, RULES).collect()} == whole and len(whole) == len(texts)
    decided = {u: rule_of(*parts(u)).verdict for u in texts if u and rule_of(*parts(u))}
    fold = {r.u: r.f for r in spark.createDataFrame([(u,) for u in decided], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(5)).alias("f")).collect()}
    kept = kept_contexts([u for u in decided if fold[u]], 1 << 20)
    m = {v: Model([u for u in decided if decided[u] == v and fold[u]], kept) for v in ("allow", "block")}
    assert len(kept) > 80
    for i in (0, 1, 64, 68):
        c = codes(texts[i])
        grams = [tuple(c[k - url_filter.ORDER + 1 : k + 1]) for k in range(url_filter.ORDER - 1, len(c))]
        assert abs(whole[i].score - sum(math.log(m["allow"].p(g)) - math.log(m["block"].p(g)) for g in grams) / len(grams)) < 1e-6


def test_rules_scores_and_verdicts(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(urls())] + [(3, urls()[3], "h", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    out = collections.defaultdict(list)
    for r in judge_urls(df, RULES).collect():
        out[r.page_id].append(r)
    assert sum(map(len, out.values())) == len(rows) and len(out[3]) == 2
    for i, u in enumerate(urls()):
        host, path = parts(u)
        rule = rule_of(host, path)
        r = out[i][0]
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    decided = {u: rule_of(*parts(u)).verdict for u in urls() if u and rule_of(*parts(u))}
    fold = {r.u: r.f for r in spark.createDataFrame([(u,) for u in decided], "u string").select("u", F.pmod(F.xxhash64("u"), F.lit(5)).alias("f")).collect()}
    kept = kept_contexts([u for u in decided if fold[u]], url_filter.MOST_CONTEXTS)
    m = {v: Model([u for u in decided if decided[u] == v and fold[u]], kept) for v in ("allow", "block")}
    for i, u in list(enumerate(urls()))[:4] + [(305, urls()[305])]:
        c = codes(u)
        grams = [tuple(c[k - url_filter.ORDER + 1 : k + 1]) for k in range(url_filter.ORDER - 1, len(c))]
        want = sum(math.log(m["allow"].p(g)) - math.log(m["block"].p(g)) for g in grams) / len(grams)
        assert abs(out[i][0].score - want) < 1e-6
    held = [u for u in decided if not fold[u]]
    by_id = {u: out[i][0] for i, u in enumerate(urls())}
    cut = max((r[0].score for r in out.values() if r[0].rule is None and r[0].verdict == "block"), default=-9)
    assert cut <= min((r[0].score for r in out.values() if r[0].rule is None and r[0].verdict == "allow"), default=9)
    assert sum((by_id[u].score > cut) == (decided[u] == "allow") for u in held) >= 0.9 * len(held)


def test_no_examples_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.xyz/"), (None, None)], "page_id long, url string")
    assert [r.rule for r in judge_urls(df, RULES).collect()] == [None, None]
    assert judge_urls(df.where("page_id > 9"), RULES).collect() == []
    assert url_filter.threshold(spark.createDataFrame([], "score double, verdict string")) == 0.0


# --- mixing ------------------------------------------------------------------------------------------


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, repeat=2):
    """Targets by iteration, as the rule is worded."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[n] for n in open_)
        now = {n: left * w[n] / total for n in open_}
        over = [n for n in open_ if now[n] > repeat * sizes[n]]
        if not over:
            return out | now
        for n in over:
            out[n] = float(repeat * sizes[n])
            left -= out[n]
            open_.discard(n)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_the_iteration(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 90, 4000]) for i in range(rng.randrange(1, 12))} | ({None: 70} if seed % 2 else {})
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = filled(sizes)
    for r in source_targets(df).collect():
        assert abs(r.target - want[r.source]) < 1e-6 * max(1.0, want[r.source])


def documents(n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 7, 40, 300]), rng.choice(["hot"] * 5 + ["a", "b", "c", "é", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "x\x1cy\x0bz", "b"), (n + 2, "q " * 20_000, "c"), (7, rows[7][1], rows[7][2])]


def n_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def mixed(rows, block, golden=mixing.GOLDEN, weights=(5.0, 2.0, 1.0)):
    """The words taken of each document, slot by slot: ``{doc_id: taken}`` and the positions of its blocks."""
    streams = collections.defaultdict(list)
    for i, text, source in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], n_words(r[1]))):
        streams[source] += [i] * n_words(text)
    sizes = {s: len(streams.get(s, [])) for s in {r[2] for r in rows}}
    want = filled(sizes)
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    ends, total = [], 0
    for n in names:
        total += math.floor(want[n])
        ends.append(total)
    used, taken, places = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for slot in range(-(-total // block)):
        point = (slot + 1.0) * golden % 1.0 * total
        source = names[next(k for k, e in enumerate(ends) if point < e)]
        twice = streams[source] * 2
        for i in twice[used[source] * block : (used[source] + 1) * block]:
            taken[i] += 1
            places[i].append(slot)
        used[source] += 1
    return taken, places, want


def test_mix_equals_a_walk_through_the_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mixing, "CELL_SLOTS", 8)
    monkeypatch.setattr(mixing, "SLOT_CHUNK", 16)
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 2)
    rows = documents()
    df = spark.createDataFrame([(*r, 1.0, 2, "x") for r in rows], "doc_id long, text string, source string, target double, taken int, place string")
    out = mix(df, block_tokens=64).collect()
    assert sorted((r.doc_id, r.size) for r in out) == sorted((i, n_words(t)) for i, t, _ in rows)
    taken, places, want = mixed(rows, 64)
    per_source, sizes = collections.Counter(), collections.Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and sum(r.taken_by_pass) == r.taken
        per_source[r.source] += r.taken
        sizes[r.source] += r.size
        if r.doc_id != 7:  # a repeated row
            assert (r.taken, r.first_position, r.last_position) == (taken[r.doc_id], min(places[r.doc_id], default=None), max(places[r.doc_id], default=None))
    assert sum(r.taken for r in out if r.doc_id == 7) == taken[7]
    for s in sizes:
        assert abs(per_source[s] - want[s]) <= 4 * 64
    again = mix(df.repartition(3), block_tokens=64).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    assert mix(df.where("doc_id < 0")).collect() == []


def test_the_schedule_decides_what_is_taken(spark, monkeypatch):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string")
    taken = lambda: {(r.doc_id, r.source): (r.taken, r.first_position) for r in mix(df, block_tokens=64).collect()}
    golden = taken()
    monkeypatch.setattr(mixing, "GOLDEN", math.sqrt(2.0) - 1.0)
    other = taken()
    assert golden != other and {k: v[0] for k, v in golden.items()} != {k: v[0] for k, v in other.items()}


def test_schedule_is_whole_and_even(spark):
    t = spark.createDataFrame([("a", 0, 64_000.0), ("b", 1, 32_000.0), ("z", 2, 0.0), (None, 3, 100.0)], "source string, place long, target double")
    rows = sorted(schedule(t, block_tokens=100).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(961))
    owners = [next(k for k, e in ((0, 64_000), (1, 96_000), (3, 96_100)) if (i + 1.0) * mixing.GOLDEN % 1.0 * 96_100 < e) for i in range(961)]
    assert [r.place for r in rows] == owners
    per = collections.Counter(owners)
    for s in per:
        assert [r.block for r in rows if r.place == s] == list(range(per[s]))
    first = collections.Counter(owners[:300])
    assert abs(first[0] - 200) < 5  # low discrepancy: every stretch has the mix


def test_blocks_grow_with_the_words():
    assert mixing.block_size(0) == mixing.block_size(10**7) == 64
    assert mixing.block_size(10**13) == 10**13 // mixing.MOST_SLOTS


def test_take_follows_the_mix(spark):
    rows = [(*r, i, "x") for i, r in enumerate(documents(120))]
    rows += [(5000, "same words here", "a", i, "y") for i in range(40)] + [(5000, "same words there", "b", i, "y") for i in range(40)] + [(None, "k " * 50, None, i, "z") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, `row` string")
    out = take(df)
    assert out.columns == df.columns
    got = out.collect()
    n = collections.Counter((r.doc_id, r.source) for r in got)
    m = collections.defaultdict(int)
    for r in mix(df).collect():
        m[r.doc_id, r.source] += 1 if r.size == 0 else sum(2 * x >= r.size for x in r.taken_by_pass)
    assert {k: v for k, v in m.items() if v} == n
    assert sorted(map(repr, got)) == sorted(map(repr, take(df.repartition(5)).collect()))
    assert take(df.where("doc_id < 0")).collect() == []


# --- sharding ----------------------------------------------------------------------------------------


def test_shards_equal_plain_splitting(spark):
    rng = random.Random(9)
    rows = [(i, "x" * rng.choice([0, 10, 100, 900])) for i in range(500)] + [(3, "y" * 700), (900, None), (None, "é" * 5), (901, "z" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bytes int")
    bits = lambda i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    size = lambda t: len((t or "").encode())

    def place(members, d=0):
        if sum(size(t) for _, t in members) <= 2000 or len({bits(i) for i, _ in members}) == 1 or d == 60:
            return [(i, size(t), d, bits(i)[:d]) for i, t in members]
        halves = [[m for m in members if bits(m[0])[d] == b] for b in "01"]
        return [x for h in halves if h for x in place(h, d + 1)]

    out = shard(df, limit_bytes=2000)
    got = [(r.doc_id, r.bytes, r.depth, r.shard) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(place(rows), key=repr)
    assert {r.doc_id for r in out.where("oversized").collect()} == {901}
    assert {r.shard for r in shard(df, limit_bytes=10**9).collect()} == {""}
    assert shard(df.where("doc_id < 0")).collect() == []


def test_deep_shards_are_found(spark):
    rows = [(i, "x" * 10) for i in range(3000)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=10)
    assert out.count() == 3000 and out.select("shard").distinct().count() == 3000
