"""Personal data: every detected entity gets a keyed surrogate of its own type and format.

A surrogate is the image of the entity under a keyed permutation of all strings
of the same format (the same signs and, letter by letter, the same class: digit,
hex digit, small or capital vowel or consonant of one script; or the same gendered
list of given names; family names have one permutation for all titles).  So equal
entities get equal surrogates in every document (coreference), and different ones get
different ones (distinctness), without any table of the corpus.  The permutation is a
Feistel network ``f`` turned into the cyclic shift ``f^-1(f(x) + 1)``, which maps nothing
to itself; where it leaves the entities of the same form (say from no hex number to
one), it is applied again until it is back among them.  Card numbers keep
their leading digit and whether their check digit is right; addresses of a
network keep their class; mail addresses keep their reserved or top-level domain.

Names are found after a title or with a listed given name before them; the words of a
name that is found are then replaced wherever the text has them.

The result is checked over the whole corpus by one shuffle of the entities alone: no
two originals of a kind share a surrogate (distinctness), and none has two
(coreference).  Originals that clash, which only a faulty permutation could
make, are sent further along their permutation until none do.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm import scratch
from ruleloom.llm.batches import bound, small

DEFAULT_KEY = b"ruleloom surrogate key"
ROUNDS = 8
#: Letters that are permuted at once; those of a longer entity follow block by block.
BLOCK = 512
#: Given names by script and gender; the surrogate of one is another of the same list.
NAMES = {
    ("latin", "f"): "Alice Anna Amelia Beatrice Carla Camille Charlotte Claire Clara Daniela Elena Elise Emily Emma Erika Eva Grace Hannah Helena Ines Isabel Jana Julia Karin Laura Lena Louise Lucia Maria Marta Mary Monika Nina Olivia Paula Rosa Sarah Sofia Sophie Teresa Valerie".split(),
    ("latin", "m"): "Adam Alberto Andreas Antoine Bernard Carlos Daniel David Diego Edward Erik Felix Francisco Frank Georg Hans Henri Jack James Jan Javier John Jonas Jorge Karl Lucas Luis Marc Martin Michael Miguel Oliver Pablo Paul Peter Philippe Pierre Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Николай Павел Сергей Юрий".split(),
}
#: Titles that announce a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Herrn Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Господин Госпожа".split()
#: Small words that may stand before a family name, and stay.
PARTICLES = "van von der den de del della di da du la le dos das ten ter zu zur al el bin ben".split()
#: Letter classes that a surrogate keeps.
CLASSES = ("0123456789", "aeiouy", "AEIOUY", "bcdfghjklmnpqrstvwxz", "BCDFGHJKLMNPQRSTVWXZ", "àâäáãåæèéêëìíîïòóôöõøùúûüýÿ", "ÀÂÄÁÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØÙÚÛÜÝŸ", "çñßšž", "ÇÑŠŽ", "аеёиоуыэюя", "АЕЁИОУЫЭЮЯ", "бвгджзйклмнпрстфхцчшщъь", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ")
CLASS_OF = {c: s for s in CLASSES for c in s}
#: Clashing originals that the driver sends to executors at most; more means that the permutation is broken.
MOST_CLASHES = 1 << 16
CHECK_ROUNDS = 8
HEX_LOW, HEX_HIGH = "0123456789abcdef", "0123456789ABCDEF"
RESERVED = {"example.com", "example.org", "example.net"}



@lru_cache(maxsize=None)
def class_of(c: str) -> str | None:
    """The letters or digits that may stand for ``c``, of any script; null for other signs.

    Characters outside the listed classes stand for each other within 128 code points
    of one category, so that script and case stay.
    """
    if c in CLASS_OF or not c.isalnum():
        return CLASS_OF.get(c)
    start, kind = ord(c) & ~127, unicodedata.category(c)
    return "".join(x for x in map(chr, range(start, start + 128)) if x not in CLASS_OF and x.isalnum() and unicodedata.category(x) == kind)


def _letters(test: Callable[[str], bool]) -> str:
    """The Latin, Greek and Cyrillic letters of one case, as ranges of a pattern."""
    own = [c for c in [*range(0x41, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)] if test(chr(c)) and chr(c).isalpha()]
    first = [c for c in own if c - 1 not in own or c == own[0]]
    last = [c for c in own if c + 1 not in own]
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in zip(first, last))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Detectors in order of precedence; the group "v" is what is replaced.
DETECTORS: list[tuple[str, str]] = [
    ("secret", r"(?i:\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passwd|password|pwd)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<v>(?=[_\-./+]*[A-Za-z0-9])[A-Za-z0-9_\-./+]{8,})"),
    ("secret", r"(?<![A-Za-z0-9])(?P<v>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"),
    ("email", r"(?<![\w.+%-])(?P<v>[\w.+%-]+@(?:[A-Za-z0-9][A-Za-z0-9-]*+(?<!-)\.)+[A-Za-z]{2,})(?![A-Za-z0-9-])"),
    ("iban", r"\b(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"),
    ("ssn", r"(?<![0-9-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    ("card", r"(?<![0-9.-])(?P<v>[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    ("phone", r"(?<![\w+])(?P<v>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"),
    ("ip", rf"(?<![0-9.])(?P<v>{_OCTET}(?:\.{_OCTET}){{3}})(?![0-9.]*[0-9])"),
    ("ip6", r"(?<![\w:])(?P<v>(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(?![\w:])"),
]
_COMPILED = [(kind, re.compile(p)) for kind, p in DETECTORS]
_ANY = re.compile(r"[0-9@:=]")
_UPPER, _LOWER = _letters(str.isupper), _letters(str.islower)
_PLAIN = rf"[{_UPPER}](?:['’][{_UPPER}])?[{_LOWER}]+(?:[{_UPPER}][{_LOWER}]+)*"
_NAME = rf"{_PLAIN}(?:-{_PLAIN})*"
_LOUD = rf"(?!(?:{'|'.join(TITLES)})\b)(?:{_NAME}|[{_UPPER}](?:['’]?[{_UPPER}])+)(?![{_LOWER}])"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}) )*"
_GIVEN = {n: k for k, names in NAMES.items() for n in names}
_TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? (?P<v>{_SMALL}{_LOUD}(?: {_SMALL}{_LOUD})*)")
_NAMED = re.compile(rf"\b(?P<v>(?:{'|'.join(_GIVEN)}) {_SMALL}{_NAME})\b")


class Surrogates:
    """Keyed permutations of formats; ``further`` says which originals go how many steps further along theirs."""

    def __init__(self, key: bytes = DEFAULT_KEY, further: dict[tuple[str, str], int] | None = None):
        self.key, self.further = key, further or {}
        self.of = lru_cache(maxsize=50_000)(self._steps)

    def _steps(self, kind: str, text: str) -> str:
        new = self._of(kind, text)
        for _ in range(self.further.get((kind, text), 0)):
            new = self._of(kind, new)
        return new

    def _draw(self, tweak: str, i: int, value: int, bits: int) -> int:
        h = hashlib.blake2b(f"{i}:{value}:{tweak}".encode("utf-8", "surrogatepass"), key=self.key[:64], digest_size=min(64, bits // 8 + 9))
        out = h.digest()
        while len(out) * 8 < bits + 64:
            out += hashlib.blake2b(out, key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(out, "big")

    def _feistel(self, x: int, a: int, b: int, tweak: str, back: bool) -> int:
        """A permutation of ``range(a * b)``."""
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2 == 0:
                left = (left + sign * self._draw(tweak, i, right, a.bit_length())) % a
            else:
                right = (right + sign * self._draw(tweak, i, left, b.bit_length())) % b
        return left * b + right

    def permute(self, digits: list[int], radix: list[int], tweak: str) -> list[int]:
        """A mixed-radix number to another of the same radices, never to itself if there is another."""
        half = len(digits) // 2
        a = b = 1
        for r in radix[:half]:
            a *= r
        for r in radix[half:]:
            b *= r
        if a * b == 1:
            return digits
        x = 0
        for d, r in zip(digits, radix):
            x = x * r + d
        y = self._feistel((self._feistel(x, a, b, tweak, False) + 1) % (a * b), a, b, tweak, True)
        out = []
        for r in reversed(radix):
            y, d = divmod(y, r)
            out.append(d)
        return out[::-1]

    def classes(self, text: str, kind: str, fixed: int = 0, alphabet: Callable[[str], str | None] = class_of) -> str:
        """Letter by letter within its class; the first ``fixed`` characters and all others stay."""
        at = [i for i, c in enumerate(text) if i >= fixed and alphabet(c)]
        sets = [alphabet(text[i]) for i in at]
        tweak = kind + "|" + "".join(s[0] if i >= fixed and (s := alphabet(c)) else "=" + c for i, c in enumerate(text))
        digits, radix = [s.index(text[i]) for s, i in zip(sets, at)], list(map(len, sets))
        new = self.permute(digits[:BLOCK], radix[:BLOCK], tweak)
        if len(at) > BLOCK:  # each block by a permutation that the ones before it choose
            before = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass"), key=self.key[:64])
            for i in range(BLOCK, len(at), BLOCK):
                before.update(repr(digits[i - BLOCK : i]).encode())
                new += self.permute(digits[i : i + BLOCK], radix[i : i + BLOCK], before.hexdigest())
        out = list(text)
        for i, s, d in zip(at, sets, new):
            out[i] = s[d]
        return "".join(out)

    def _among(self, text: str, form: Callable[[str], object], step: Callable[[str], str]) -> str:
        """The next string of the same form under a permutation of more: a permutation of those of each form."""
        of, new = form(text), step(text)
        while form(new) != of:
            new = step(new)
        return new

    def _of(self, kind: str, text: str) -> str:
        if kind == "card":
            return self._card(text)
        if kind == "phone":
            return self.classes(text, kind, fixed=re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|", text).end())
        if kind == "ip":
            keep = kept_octets(text)

            def step(t: str) -> str:
                o = list(map(int, t.split(".")))
                return ".".join(map(str, o[:keep] + self.permute(o[keep:], [256] * (4 - keep), f"ip|{o[:keep]}")))

            return self._among(text, kept_octets, step)
        if kind in ("ip6", "secret"):
            hexa, fixed = secret_form(text)
            if hexa:
                return self._among(text, secret_form, lambda t: self.classes(t, kind, alphabet=lambda c: hexa if c in hexa else None))
            return self._among(text, secret_form, lambda t: self.classes(t, kind, fixed=fixed))
        if kind == "iban":
            return self.classes(text, kind, fixed=2)
        if kind == "email":
            return self._among(text, kept_labels, lambda t: self._email(t, kept_labels(text)))
        if kind == "name":
            return " ".join(self._name(w) for w in text.split(" "))
        return self.classes(text, kind)

    def _email(self, text: str, kept: int) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        head = ".".join(labels[:-kept])
        joined = self.classes(local + "@" + head, f"email|{'.'.join(labels[-kept:])}|{len(local)}")
        return ".".join(filter(None, [joined, *labels[-kept:]])) if head else joined + ".".join(labels[-kept:])

    def _name(self, word: str) -> str:
        if word in PARTICLES:
            return word
        group = _GIVEN.get(word)
        if group:
            names = NAMES[group]
            return names[self.permute([0, names.index(word)], [1, len(names)], f"given|{group}")[1]]
        # a name of a list stands for names of lists only
        return self._among(word, _GIVEN.__contains__, lambda w: self.classes(w, "family"))

    def _card(self, text: str) -> str:
        digits = [c for c in text if c.isdigit()]
        off = (int(digits[-1]) - check_digit(digits[:-1])) % 10
        new = [int(c) for c in digits[1:-1]]
        new = digits[:1] + list(map(str, self.permute(new, [10] * len(new), f"card|{digits[0]}|{off}|{len(digits)}")))
        new.append(str((check_digit(new) + off) % 10))
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)


def kept_octets(ip: str) -> int:
    """How many octets name the network that a surrogate keeps."""
    o = ip.split(".")
    return 2 if o[:2] == ["192", "168"] else 1 if o[0] in ("10", "127") else 0


def kept_labels(email: str) -> int:
    """How many labels of the domain a surrogate keeps."""
    return 2 if ".".join(email.rpartition("@")[2].split(".")[-2:]).lower() in RESERVED else 1


def secret_form(text: str) -> tuple[str | None, int]:
    """The hex digits that a text is made of, if it is, and how many characters tell its issuer."""
    body = text.replace(":", "")
    hexa = HEX_LOW if all(c in HEX_LOW for c in body) else HEX_HIGH if all(c in HEX_HIGH for c in body) else None
    return hexa, 4 if re.match(r"AKIA|gh[pousr]_", text) else 0


def check_digit(payload: list[str]) -> int:
    """The digit that makes the number pass the modulus-10 test."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in order, without overlaps; earlier detectors win."""
    found: list[tuple[int, int, str]] = []
    if _ANY.search(text):
        for kind, pattern in _COMPILED:
            if kind in ("email",) and "@" not in text or kind == "ip6" and ":" not in text:
                continue
            for m in pattern.finditer(text):
                found.append((*m.span("v"), kind))
    names = [m.span("v") for pattern in (_TITLED, _NAMED) for m in pattern.finditer(text)]
    found += [(*at, "name") for at in names]
    if names:
        found += [(*m.span(), "name") for m in _repeats(text, {w for a, b in names for w in text[a:b].split(" ")})]
    taken: list[tuple[int, int, str]] = []
    if len(found) > 1:
        used = bytearray(len(text))
        for e in found:  # precedence is the order of detection
            if not any(used[e[0] : e[1]]):
                used[e[0] : e[1]] = b"\1" * (e[1] - e[0])
                taken.append(e)
        return sorted(taken)
    return found


def _repeats(text: str, words: set[str]) -> Iterator[re.Match]:
    """Where the words of found names stand, but for those that the text also has in small letters."""
    own = sorted((w for w in words if w not in PARTICLES and not re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", text)), key=len, reverse=True)
    return re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, own))})(?!\w)", text) if own else iter(())


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and ``(kind, start, end, surrogate)`` by places in the old text.

    What has no other string of its form (say ``token: ____``) is no entity.
    """
    out, entities, at = [], [], 0
    for start, end, kind in find_entities(text):
        new = surrogates.of(kind, text[start:end])
        if new == text[start:end]:
            continue
        out += [text[at:start], new]
        entities.append((kind, start, end, new))
        at = end
    return ("".join(out) + text[at:] if out else text), entities


ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original", pa.string()), ("surrogate", pa.string())])
ENTITIES = "array<struct<kind string, start int, end int, original string, surrogate string>>"


def _replaced(docs: DataFrame, text_col: str, name: str, key: bytes, make: Callable[..., Surrogates]) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and the entities in a new column ``name``, checked and resolved."""
    bound(docs.sparkSession)
    texts = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema = texts.withColumn(name, F.lit(None).cast(ENTITIES)).schema
    further: dict[tuple[str, str], int] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = make(key, further)
        for batch in small(batches):
            at = batch.schema.get_field_index(text_col)
            new, found = [], []
            for text in batch.column(at).to_pylist():
                changed, entities = replace(text, surrogates) if text else (text, [])
                new.append(changed)
                found.append([{"kind": k, "start": s, "end": e, "original": text[s:e], "surrogate": x} for k, s, e, x in entities])
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(ENTITY))], [*batch.schema.names, name])

    for _ in range(CHECK_ROUNDS):
        out = scratch.cut(texts.mapInArrow(run, schema), "surrogates")
        clashes = collisions(out, name)
        if clashes.isEmpty():
            return out
        # the least original keeps the surrogate, the others go on
        keep = clashes.groupBy("kind", "surrogate").agg(F.min("original").alias("least"))
        moved = clashes.join(keep, ["kind", "surrogate"]).where("original <> least").select("kind", "original").distinct().limit(MOST_CLASHES + 1).collect()
        if len(moved) > MOST_CLASHES:
            break
        for r in moved:
            further[r.kind, r.original] = further.get((r.kind, r.original), 0) + 1
        scratch.drop(out)
    raise RuntimeError("surrogates clash: the permutation is no permutation")


def collisions(pseudonymised: DataFrame, entities_col: str = "entities") -> DataFrame:
    """``(kind, surrogate, original)`` where several originals of a kind share a surrogate; none is expected.

    Equal originals have equal surrogates in every text, as a surrogate depends on the
    original, its kind and the key alone.
    """
    e = pseudonymised.select(F.explode(F.col(f"`{entities_col}`")).alias("e")).select("e.kind", "e.surrogate", "e.original").distinct()
    shared = e.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return e.join(shared, ["kind", "surrogate"]).select("kind", "surrogate", "original")


def pseudonymise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: bytes = DEFAULT_KEY, make: Callable[..., Surrogates] = Surrogates) -> DataFrame:
    """Per input row: doc_id, text with surrogates, entities (kind, start, end, original, surrogate).

    Places are code points of the old text.  Defined cases: a null text stays
    null and has no entities, as an empty one; texts of any length are read whole;
    overlapping finds give way to the earlier detector; repeated rows and null ids
    are kept; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _replaced(rows, "text", "entities", key, make)


def replace_in_place(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` (and its new length in ``length_col``); all other columns as they are.

    Defined cases are those of :func:`pseudonymise`; other columns may have any names.
    """
    name = "entities"
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    out = _replaced(docs, text_col, name, key, Surrogates).drop(name)
    if length_col:
        out = out.withColumn(length_col, F.length(f"`{text_col}`").cast(docs.schema[length_col].dataType))
    return out
