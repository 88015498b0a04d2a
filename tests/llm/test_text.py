"""BPE against the tokenizers library, fingerprints and surrogates against brute force."""

import hashlib
import random
import time
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleloom.llm.bpe import Encoder, decode, digests, encode
from ruleloom.llm.fingerprint import Fingerprints, fingerprint_documents, with_next
from ruleloom.llm.pii import Surrogates, check_digit, collisions, find_entities, pseudonymise, replace, replace_in_place
from ruleloom.llm.queries_text import vocabulary

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, fingerprint string, entities string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    return Encoder(vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x85\xa0　'sdtlverm.,!0129abcXYZéß漢字😀̀‍\x00٣²|<>", "<|endoftext|>", "'ll", "  ", "hello"]), max_size=60))
def test_encoding_equals_the_library(library, own, pieces):
    text = "".join(pieces)
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_long_word_is_not_quadratic(own, library):
    word = "".join(random.Random(1).choice("abcdef") for _ in range(60_000))
    assert own.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_memo_is_bounded(own, monkeypatch):
    from ruleloom.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 10)
    e = Encoder(vocabulary())
    for i in range(100):
        e.encode(f"w{i}x y{i}")
    assert len(e) <= 10 and len(e.older) <= 10


def test_encode_and_decode_frames(spark, library):
    docs = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "a b"), (4, "x <|endoftext|> y"), (5, "ab " * 50_000)]
    out = encode(frame(spark, docs), vocabulary())
    rows = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()), key=repr)
    want = sorted(((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in docs), key=repr)
    assert rows == want
    assert sorted(r.decoded for r in decode(out, vocabulary()).collect()) == sorted(t or "" for _, t in docs)
    d = {r.doc_id: r for r in digests(out).collect()}
    assert d[2].n_tokens == 0 and d[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode(frame(spark, docs).where("doc_id > 9"), vocabulary()).collect() == []


TEXTS = ["one two\nthree four five\nsix", "six\none two\nthree four five", "other words here", "", "x" * 5000, "ab\ncd\n" * 3000, "Ünï cödé\n漢字漢字漢字"]


def test_fingerprints_are_homomorphic_and_ignore_order():
    a, b = Fingerprints.of(TEXTS[:1]), Fingerprints.of(TEXTS[1:2])
    assert a.strings() == b.strings()
    whole, part, rest = Fingerprints.of(["p one\nq two\nr three"]), Fingerprints.of(["q two"]), Fingerprints.of(["r three\np one"])
    assert (part + rest).strings() == whole.strings() and (whole - part).strings() == rest.strings()
    assert len(set(Fingerprints.of(TEXTS).strings())) == len(TEXTS) - 1
    assert Fingerprints.parse(whole.strings()).strings() == whole.strings()
    assert Fingerprints.of(TEXTS).strings() == [Fingerprints.of([t]).strings()[0] for t in TEXTS]


def test_likeness():
    rng = random.Random(1)
    words = [f"w{rng.randrange(9999)}" for _ in range(600)]
    a, b, c = " ".join(words), " ".join(words[:450] + [f"v{i}" for i in range(150)]), " ".join(f"u{rng.randrange(9999)}" for _ in range(600))
    fa, fb, fc = (Fingerprints.of([t]) for t in (a, b, c))
    assert fa.likeness(fa)[0] == 1.0
    assert 0.6 < fa.likeness(fb)[0] < 0.9 and fa.likeness(fc)[0] < 0.3
    assert Fingerprints.of([""]).likeness(Fingerprints.of([None]))[0] == 1.0


@pytest.mark.parametrize("n", [30_000, 32_767, 32_768, 65_536, 200_000])
def test_likeness_of_many_equal_lines(n):
    a, b = Fingerprints.of(["the same line\n" * n]), Fingerprints.of(["the same line\n" * (n + 1)])
    assert 0.999 < a.likeness(b)[0] < 1.0


def test_likeness_follows_the_shared_pieces():
    """Against the share of pieces in common, counted piece by piece."""
    from collections import Counter

    from ruleloom.llm import fingerprint

    def pieces(text):
        found = Counter()
        for line in text.encode().split(b"\n"):
            data, start = np.frombuffer(line, np.uint8).astype(np.uint64) + np.uint64(1), 0
            for i in range(len(line)):
                four = np.array([sum(int(data[i - j]) << (16 * j) for j in range(min(i, 3) + 1)) % (1 << 64)], np.uint64)
                if i + 1 == len(line) or fingerprint.mix(four)[0] & fingerprint.PIECE_MASK == 0:
                    found[line[start : i + 1]] += 1
                    start = i + 1
        return found

    rng = random.Random(2)
    line = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(8))
    base = [line() for _ in range(120)]
    for kept in (0, 30, 60, 110):
        other = base[:kept] + [line() for _ in range(120 - kept)]
        p, q = pieces("\n".join(base)), pieces("\n".join(other))
        f, g = Fingerprints.of(["\n".join(base)]), Fingerprints.of(["\n".join(other)])
        assert f.count[0] == sum(p.values())
        apart = sum(n * n for n in (p - q).values()) + sum(n * n for n in (q - p).values())
        want = 1 - apart / (sum(n * n for n in p.values()) + sum(n * n for n in q.values()))
        assert abs(f.likeness(g)[0] - max(0.0, want)) < 0.2


def test_ranges_of_hot_ids_and_many_ranges(spark, monkeypatch):
    from ruleloom.llm import fingerprint

    monkeypatch.setattr(fingerprint, "COARSE", 4)
    rng = random.Random(9)
    docs = [(None, f"null {i}") for i in range(150)] + [(77, f"hot {i % 60}") for i in range(150)] + [(rng.randrange(1000), f"t{i}") for i in range(200)]
    rows = with_next(frame(spark, docs), rows_per_range=10).rdd.glom().collect()
    flat, per_range = [], {}
    for r in (r for part in rows for r in part):
        per_range.setdefault(r["range"], []).append(r)
    ranges = sorted(per_range)
    assert len(ranges) > 30 and max(sum(not r.tail for r in per_range[k]) for k in ranges) < 60
    for k, after in zip(ranges, ranges[1:] + ranges[:1]):
        assert [r.tail for r in per_range[k]] == sorted(r.tail for r in per_range[k]) and per_range[k][-1].tail
        head, tail = per_range[after][0], next(r for r in per_range[k] if r.tail)
        assert (head.doc_id, head.text) == (tail.doc_id, tail.text)
        flat += [r for r in per_range[k] if not r.tail]
    assert sorted((str(i), t) for i, t in docs) == sorted((str(r.doc_id), r.text) for r in flat)
    ids = [-1 if r.doc_id is None else r.doc_id for r in flat]
    assert ids == sorted(ids)


@pytest.mark.parametrize("per_range", [3, 10_000])
def test_edits_and_next_documents(spark, monkeypatch, per_range):
    from ruleloom.llm import fingerprint

    monkeypatch.setattr(fingerprint, "with_next", lambda d, **k: with_next(d, rows_per_range=per_range, **k))
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abc de fgh é 漢 \n".split(" ")) for _ in range(rng.randrange(80)))) for i in rng.sample(range(10_000), 60)] + [(20_000, None), (20_001, ""), (20_002, "z" * 70_000)]
    out = {r.doc_id: r for r in fingerprint_documents(frame(spark, docs)).collect()}
    order = sorted((i, t or "") for i, t in docs)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        f = [Fingerprints.of([x]) for x in (t, e, n)]
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (f[0].strings()[0], f[1].strings()[0])
        assert abs(out[i].near_edited - f[0].likeness(f[1])[0]) < 1e-12 and abs(out[i].near_next - f[0].likeness(f[2])[0]) < 1e-12


def test_single_repeated_and_no_documents(spark):
    one = fingerprint_documents(frame(spark, [(7, "only this text")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint_documents(frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "q")])).count() == 3
    assert fingerprint_documents(frame(spark, [(1, "a")]).where("doc_id > 5")).collect() == []


# --- surrogates --------------------------------------------------------------------------------------

PRIVATE = {
    "email": "anna.meier91@mail7.example.com",
    "phone": "+1 (614) 555-3824",
    "ip": "43.21.141.162",
    "card": "4111 1111 1111 1111",
    "ssn": "123-45-6789",
    "iban": "DE89 3704 0044 0532 0130 00",
    "secret": "04dbebab91ab85687d33eeaaf9ac699e1188f962",
    "ip6": "2001:0db8:0000:0000:0000:ff00:0042:8329",
}


@pytest.mark.parametrize("kind", PRIVATE)
def test_each_kind_is_found_and_replaced_in_format(kind):
    v = PRIVATE[kind]
    text = f"Before {v}, after."
    new, found = replace(text, Surrogates())
    assert [f[0] for f in found] == [kind] and text[found[0][1] : found[0][2]] == v
    s = found[0][3]
    assert v not in new and len(s) == len(v) or kind == "ip"
    assert [c for c in s if not c.isalnum()] == [c for c in v if not c.isalnum()]
    assert [f[0] for f in replace(new, Surrogates())[1]] == [kind]  # still of its type


def test_names_keep_gender_and_script():
    text = "Mrs. Anna Keller met Dr Paul Novak; Иван Петров and Frau Schmidt came. Maria Lopez too."
    new, found = replace(text, Surrogates())
    assert [f[0] for f in found] == ["name"] * 5
    assert "Keller" not in new and "Петров" not in new and "Schmidt" not in new
    from ruleloom.llm.pii import _GIVEN

    assert _GIVEN[found[0][3].split()[0]] == ("latin", "f") and _GIVEN[found[2][3].split()[0]] == ("cyrillic", "m")


def test_surrogates_are_distinct_keyed_and_coreferent():
    s = Surrogates()
    mails = [f"user{i}@x{i % 7}.test.org" for i in range(3000)]
    new = [s.of("email", m) for m in mails]
    assert len(set(new)) == len(set(mails)) and not set(new) & set(mails) and new == [s.of("email", m) for m in mails]
    assert new != [Surrogates(b"other").of("email", m) for m in mails]
    phones = [f"+1 ({i:03d}) 555-{j:04d}" for i in range(20) for j in range(100)]
    assert len({s.of("phone", p) for p in phones}) == len(phones)
    cards = [str(4000000000000000 + i) for i in range(2000)]
    good = [c[:-1] + str(check_digit(list(c[:-1]))) for c in cards]
    for group in (cards, good):
        out = [s.of("card", c) for c in group]
        assert len(set(out)) == len(set(group))
    assert all(int(c[-1]) == check_digit(list(c[:-1])) for c in (s.of("card", g) for g in good))
    small = [str(i) for i in range(10)]
    assert {s.classes(d, "t") for d in small} == set(small) and all(s.classes(d, "t") != d for d in small)


def test_family_names_have_one_surrogate_for_all_titles_and_none_is_shared():
    s = Surrogates()
    names = [a + b for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy"]
    new = {n: {replace(f"{title} {n} came", s)[1][0][3] for title in ("Mr", "Mrs", "Dr")} | {replace(f"Paul {n} came", s)[0].split()[1]} for n in names}
    assert all(len(x) == 1 for x in new.values())
    assert len(set.union(*new.values())) == len(names) and not any(n in x for n, x in new.items())


def test_surrogates_stay_among_their_form():
    from ruleloom.llm.pii import NAMES, _GIVEN, kept_labels, kept_octets

    s = Surrogates()
    letters = "0123456789abcdefghijABCDEFGHIJ"
    short = [a + b for a in letters for b in letters]
    for kind in ("secret", "ip6"):
        assert len({s.of(kind, x) for x in short}) == len(short)
    rng = random.Random(5)
    ips = {".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(4000)} | {f"10.0.{i}.{j}" for i in range(20) for j in range(20)}
    assert all(kept_octets(s.of("ip", x)) == kept_octets(x) for x in ips) and len({s.of("ip", x) for x in ips}) == len(ips)
    mails = [f"a@exampl{c}.com" for c in "aeiouy"]
    assert len({s.of("email", m) for m in mails}) == 6 and all(kept_labels(s.of("email", m)) == kept_labels(m) for m in mails)
    assert sum(map(len, NAMES.values())) == len(_GIVEN)


@pytest.mark.parametrize("n", [512, 513, 5000, 300_000])
def test_secrets_are_replaced_to_their_end(n):
    rng = random.Random(n)
    for token in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789XYZ") for _ in range(n)), "".join(rng.choice("0123456789abcdef") for _ in range(n))):
        for text in (f"password = {token} end", *([f"see {token} end"] if set(token) <= set("0123456789abcdef") else [])):
            new, found = replace(text, Surrogates())
            at = text.index(token)
            assert [(k, a, b) for k, a, b, _ in found] == [("secret", at, at + n)] and len(new) == len(text)
            assert all(token[i : i + 12] not in new for i in range(0, n - 12, 97)) and token[-12:] not in new
            other = replace(text.replace(token, token[:-1] + ("a" if token[-1] != "a" else "b")), Surrogates())[0]
            assert other != new


def test_names_of_one_person_stay_one_person():
    s = Surrogates()
    text = "John Smith came. Mr Smith left; Dr Smith and Ms Smith's dog. Smith and John. Blacksmith, Smithers, a john."
    new, found = replace(text, s)
    words = {text[a:b]: x for _, a, b, x in found}
    assert [text[a:b] for _, a, b, _ in found] == ["John Smith", "Smith", "Smith", "Smith", "Smith"]
    assert words["John Smith"].split(" ")[1] == words["Smith"] and "Blacksmith, Smithers, a john." in new
    assert replace("John Smith came. Smith and John.", s)[0].count(words["John Smith"].split(" ")[0]) == 2
    assert replace("Dr. The patient said the word. The end", s)[0].endswith("said the word. The end")


@pytest.mark.parametrize("name", ["O'Brien", "Łucja Wójcik", "McDonald", "SMITH", "von der Leyen", "Juan Carlos García López", "Δημήτρης Παπάς", "Müller-Lüdenscheidt", "A" + "b" * 20_000])
def test_whole_names_go(name):
    text = f"Then Mr {name} and Mrs {name} left."
    new, found = replace(text, Surrogates())
    assert [text[a:b] for _, a, b, _ in found] == [name, name] and found[0][3] == found[1][3]
    kept = set(name.split(" ")) & set(found[0][3].split(" "))
    assert kept <= {"von", "der"} and len(new) <= len(text) + 20


def test_no_entity_is_its_own_surrogate():
    s = Surrogates()
    for text in ("write 李雷@example.com now", "mail žőę@example.org", "mail a@b.cc", "token: __________", "password = ________x", "ip 10.0.0.1"):
        new, found = replace(text, s)
        assert all(text[a:b] != x for _, a, b, x in found)
        assert (new == text) == text.endswith("__________")
    assert unicodedata.name(replace("李@example.com", s)[0][0]).startswith("CJK")


def test_hard_texts_take_linear_time():
    for text in ("a@" + "b." * 50_000 + "1", "x@" * 50_000, "a" * 300_000, "Mr " * 50_000, "1-" * 100_000, "+1 " * 50_000):
        start = time.perf_counter()
        replace(text, Surrogates())
        assert time.perf_counter() - start < 5


class Forgetful(Surrogates):
    """Takes two steps to tell names apart."""

    def _of(self, kind, text):
        return {"Anna": "Zoe", "Mary": "Zoe", "Zoe": "Yvonne"}.get(text, super()._of(kind, text)) if kind == "name" else super()._of(kind, text)


def test_clashes_are_found_and_resolved(spark):
    docs = frame(spark, [(1, "Ms Anna"), (2, "Ms Mary"), (3, "Mrs Anna"), (4, "x")])
    out = pseudonymise(docs, make=Forgetful)
    new = {r.doc_id: r.text for r in out.collect()}
    assert new == {1: "Ms Zoe", 2: "Ms Yvonne", 3: "Mrs Zoe", 4: "x"} and collisions(out).count() == 0
    broken = type("Broken", (Surrogates,), {"_of": lambda self, kind, text: "Zoe"})
    with pytest.raises(RuntimeError):
        pseudonymise(docs, make=broken)


def test_a_whole_corpus_has_one_surrogate_for_each_original(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = pseudonymise(docs).collect()
    texts, pairs = {r.doc_id: r.text for r in docs.collect()}, set()
    for r in out:
        text, at = texts[r.doc_id], 0
        rebuilt = []
        for e in r.entities:
            assert text[e.start : e.end] == e.original != e.surrogate and e.start >= at
            rebuilt += [text[at : e.start], e.surrogate]
            at = e.end
            pairs.add((e.kind, e.original, e.surrogate))
        assert "".join(rebuilt) + (text or "")[at:] == (r.text or "")
    assert len(pairs) >= 10
    assert len({p[:2] for p in pairs}) == len({(k, x) for k, _, x in pairs}) == len(pairs)


def test_clean_text_is_untouched():
    for t in ("Version 2.0, January 2004", "The year 1999 had 365 days; 12,345 of 67.890.", "a = b: c", "Nothing private here. He said 10.5% on 2024-01-02."):
        assert find_entities(t) == [] and replace(t, Surrogates())[0] == t


def test_frames_of_surrogates(spark):
    docs = [(1, "mail a.b@c.example.com or a.b@c.example.com"), (2, None), (3, ""), (None, "call +1 (614) 555-3824"), (1, "mail a.b@c.example.com"), (4, "x" * 200_000 + " 43.21.141.162")]
    out = pseudonymise(frame(spark, docs))
    rows = out.collect()
    assert len(rows) == 6 and collisions(out).count() == 0
    mails = {e.surrogate for r in rows for e in r.entities if e.kind == "email"}
    assert len(mails) == 1 and sum(len(r.entities) for r in rows) == 5
    assert [r.text for r in rows if r.doc_id == 2] == [None]
    same = replace_in_place(frame(spark, docs))
    assert same.columns == frame(spark, docs).columns
    assert sorted(map(repr, (r.text for r in same.collect()))) == sorted(map(repr, (r.text for r in rows)))
    assert pseudonymise(frame(spark, docs).where("doc_id > 99")).collect() == []


def test_numpy_is_quiet():
    with np.errstate(all="raise"):
        Fingerprints.of(["abc def"]).likeness(Fingerprints.of(["xyz"]))
