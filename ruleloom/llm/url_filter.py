"""URL filter: two variable-order Markov models of characters, as DataFrame operations only.

URLs that a host/path rule decides are the examples.  For accepted and for
rejected URLs characters are counted after contexts of up to ``ORDER - 1`` characters:
after all of two, and after longer ones where the examples have them often enough.
Each order is interpolated with the one below by Witten-Bell weights, down to a uniform
distribution.  A URL's score is the mean over its characters of
``log P(accepted) - log P(rejected)``, each after the longest context that is kept;
above a calibrated threshold it is allowed.

The score is a sum of table entries: the log-ratio after two characters, and for each
longer context what it changes.  The alphabet is fixed, so the entries of the at most
``MOST_CONTEXTS`` longer contexts that the examples have most, and of fewer than ``SHARES``
that the scored URLs have most besides, are a table of at most ``(len(ALPHABET)**2 +
MOST_CONTEXTS + SHARES) * len(ALPHABET)`` rows whatever the input, which is why it may be
broadcast.  The entries of all other contexts are joined by their grams; every context
that is frequent enough counts, by either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import scratch

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: One digit stands for all, * for every other character, ^ begins, $ ends.
ALPHABET = LETTERS + "0" + "/.-_?=&%#:~" + "*^$"
SIZE = len(ALPHABET)
#: Characters of the longest gram: the last, and its context.
ORDER = 5
#: Longer contexts are part of the models from this many occurrences on.
LEAST_COUNT = 8
#: Of them so many, those of the highest counts, are broadcast; the others are joined.
MOST_CONTEXTS = 1 << 13
#: Of the others, those with over one in so many of their occurrences in the scored URLs are broadcast too.
SHARES = 1 << 12
#: Steps of a doubling in which counts are told apart for that.
STEPS = 64
BINS = 400
SPAN = 4.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path`` (up to ``?``, ``#`` or the end)."""
    rows = pages.withColumn("__u", F.coalesce(F.col(url_col).cast("string"), F.lit(""))).withColumn("__at", F.locate("://", F.col("__u")))
    rest = F.when(F.col("__at") > 0, F.expr("substring(__u, __at + 3)")).otherwise(F.lit(""))
    rows = rows.withColumn("__rest", rest)
    host = F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), LETTERS.upper(), LETTERS)
    return rows.withColumn("host", host).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)).drop("__u", "__at", "__rest")


def fitting_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def symbols(url: Column) -> Column:
    """The URL as an array of symbol numbers between ``ORDER - 1`` begins and an end."""
    text = F.translate(F.lower(url), "123456789", "000000000")
    text = F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(text, r"[^a-z0/.\-_?=&%#:~]", "*"), F.lit("$"))
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def first_code(length: int) -> int:
    """Where the numbers of grams of this length begin, from 3 on."""
    return sum(SIZE**k for k in range(3, length))


def with_grams(rows: DataFrame, *keys: str, shortest: int = 3) -> DataFrame:
    """``(*keys, g)``: for each character of ``url`` the numbers of itself with the two and more before it, from ``shortest`` characters on."""
    codes = F.col("__codes")

    def grams(i: Column) -> Column:
        at = lambda back: F.get(codes, i - back).cast("long")
        each = []
        for length in range(shortest, ORDER + 1):
            value = at(length - 1)
            for back in range(length - 2, -1, -1):
                value = value * SIZE + at(back)
            each.append(value + first_code(length))
        return F.array(*each)

    every = F.flatten(F.transform(F.sequence(F.lit(ORDER - 1), F.size(codes) - 1), grams))
    return rows.withColumn("__codes", symbols(F.col("url"))).select(*keys, F.explode(every).alias("g"))


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("double")


def _mixed(n: str, c: str, t: str, low: Column) -> Column:
    """Witten-Bell: a count after its context, interpolated with the lower order."""
    return F.when(_z(c) > 0, (_z(n) + _z(t) * low) / (_z(c) + _z(t))).otherwise(low)


def _after_two(counts: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """``(g, name)``: probabilities over the whole grid of trigrams."""
    grid = spark.range(SIZE**3).withColumnRenamed("id", "g")
    x, bi = F.col("g") % SIZE, F.col("g") % (SIZE * SIZE)
    one = counts.groupBy(x.alias("x")).agg(F.sum("n").alias("n1"))
    all_one = one.agg(F.sum("n1").alias("c0"), F.count("*").alias("t0"))
    two = counts.groupBy(bi.alias("bi")).agg(F.sum("n").alias("n2"))
    ctx_two = two.groupBy(F.floor(F.col("bi") / SIZE).alias("c2k")).agg(F.sum("n2").alias("c2"), F.count("*").alias("t2"))
    ctx_three = counts.groupBy(F.floor(F.col("g") / SIZE).alias("c3k")).agg(F.sum("n").alias("c3"), F.count("*").alias("t3"))
    zero = F.broadcast(all_one.select(F.coalesce("c0", F.lit(0)).alias("c0"), "t0", F.lit(0).alias("__one")))
    p = grid.withColumn("x", x).withColumn("bi", bi).withColumn("c2k", F.floor(bi / SIZE)).withColumn("c3k", F.floor(F.col("g") / SIZE)).withColumn("__one", F.lit(0))
    p = p.join(zero, "__one").join(F.broadcast(one), "x", "left").join(F.broadcast(two), "bi", "left").join(F.broadcast(ctx_two), "c2k", "left").join(F.broadcast(ctx_three), "c3k", "left").join(F.broadcast(counts), "g", "left")
    p = p.withColumn("p1", _mixed("n1", "c0", "t0", F.lit(1.0 / SIZE)))
    p = p.withColumn("p2", _mixed("n2", "c2", "t2", F.col("p1")))
    return p.select("g", _mixed("n", "c3", "t3", F.col("p2")).alias(name))


def _kept_contexts(contexts: DataFrame) -> tuple[DataFrame, bool]:
    """Of rows with ``(length, context, n)`` those that occur often, and whether any of them is not ``frequent``.

    ``frequent`` are at most ``MOST_CONTEXTS``.  Often or frequent, a context comes with its shorter end, as that is at least as frequent.
    """
    often = contexts.where(F.col("n") >= LEAST_COUNT).withColumn("bin", F.floor(F.log2("n") * STEPS).cast("int"))
    found = {r["bin"]: r["n"] for r in often.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # at most 64 * STEPS rows
    least, held = 1 << 30, 0
    for b in sorted(found, reverse=True):
        if held + found[b] > MOST_CONTEXTS:
            break
        least, held = b, held + found[b]
    return often.withColumn("frequent", F.col("bin") >= least).drop("n", "bin"), held < sum(found.values())


def fit_whole(examples: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    """``(g, ratio)`` from ``(url, verdict)`` with verdict allow or block: all trigrams, and the changes by longer grams.

    The first table has the trigrams and the frequent contexts and may be broadcast; the second has all others, if there are any.
    """
    verdicts = ("allow", "block")
    seen = with_grams(examples, "verdict").groupBy("g").agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in verdicts))
    length = F.lit(3)
    for k in range(4, ORDER + 1):
        length = F.when(F.col("g") >= first_code(k), k).otherwise(length)
    starts = F.create_map(*(F.lit(x) for k in range(3, ORDER + 1) for x in (k, first_code(k))))
    seen = seen.withColumn("length", length).withColumn("gram", F.col("g") - F.element_at(starts, F.col("length")))
    seen = scratch.cut(seen.select("length", "gram", *(f"n_{v}" for v in verdicts)), "grams")
    three = [_after_two(seen.where((F.col("length") == 3) & (F.col(f"n_{v}") > 0)).select(F.col("gram").alias("g"), F.col(f"n_{v}").alias("n")), spark, v) for v in verdicts]
    lower = scratch.cut(three[0].join(three[1], "g"), "after-two")
    log_ratio = lambda a, b: F.log(a) - F.log(b)
    table = lower.select("g", log_ratio("allow", "block").alias("ratio"), F.lit(True).alias("frequent"))
    context = F.floor(F.col("gram") / SIZE).alias("context")
    sums = [f(v) for v in verdicts for f in (lambda v: F.sum(f"n_{v}").alias(f"c_{v}"), lambda v: F.count_if(F.col(f"n_{v}") > 0).alias(f"t_{v}"))]
    per_context = scratch.cut(seen.where("length > 3").groupBy("length", context).agg(*sums).withColumn("n", F.col("c_allow") + F.col("c_block")), "contexts")
    often, more = _kept_contexts(per_context)
    kept = scratch.cut(often, "kept")
    written = [seen, lower, per_context, kept]
    for k in range(4, ORDER + 1):
        rows = kept.where(F.col("length") == k).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1)))).withColumn("gram", F.col("context") * SIZE + F.col("x"))
        # by shuffles: Spark would take the few bytes of a written table for few rows and broadcast it
        rows = rows.withColumn("g", F.col("gram") % SIZE ** (k - 1)).join(lower.hint("shuffle_merge"), "g")
        rows = rows.join(seen.where(F.col("length") == k).drop("length").hint("shuffle_merge"), "gram", "left")
        for v in verdicts:
            rows = rows.withColumn(f"p_{v}", _mixed(f"n_{v}", f"c_{v}", f"t_{v}", F.col(v)))
        rows = scratch.cut(rows.select("gram", "p_allow", "p_block", "allow", "block", "frequent"), "longer")
        written.append(rows)
        table = table.union(rows.select(F.col("gram") + first_code(k), log_ratio("p_allow", "p_block") - log_ratio("allow", "block"), "frequent"))
        lower = rows.select(F.col("gram").alias("g"), F.col("p_allow").alias("allow"), F.col("p_block").alias("block"))
    table = scratch.cut(table, "ratios")
    scratch.drop(*written)
    return table.where("frequent").drop("frequent"), table.where("not frequent").drop("frequent") if more else None


def fit(examples: DataFrame, spark: SparkSession) -> DataFrame:
    """The table of :func:`fit_whole` that may be broadcast."""
    return fit_whole(examples, spark)[0]


def _context(g: Column) -> Column:
    """Number of the context of a gram of any length, below ``first_code(ORDER + 1) / SIZE``."""
    return F.floor(g / SIZE)


def _grams_of(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``(row, g, context)``: the longer grams of ``urls`` whose context ``table`` has.

    That is read from one bit for each possible context, 64 a row, so at most 46,000 rows are broadcast.
    """
    word, place = F.shiftright("context", 6).alias("word"), F.col("context").bitwiseAND(63).cast("int")
    bits = table.select(_context(F.col("g")).alias("context")).groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    grams = with_grams(urls, "row", shortest=4).withColumn("context", _context(F.col("g"))).withColumn("word", word)
    return grams.join(F.broadcast(bits), "word").where(F.getbit("bits", place) == 1).select("row", "g", "context")


def _dealt(urls: DataFrame, table: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``table`` with the contexts that make up much of what ``urls`` have of ``rest``, and ``rest`` without them.

    The ratios stay what they are; but none of the contexts that are left has so many grams that one task would have them all to join.
    """
    counts = scratch.cut(_grams_of(urls, rest).groupBy("context").agg(F.count("*").alias("n")), "rest-contexts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    many = F.broadcast(counts.where(F.col("n") * SHARES > total).select("context"))  # fewer than SHARES rows
    rest = rest.withColumn("context", _context(F.col("g")))
    table = scratch.cut(table.unionByName(rest.join(many, "context", "left_semi").drop("context")), "broadcast-ratios")
    rest = scratch.cut(rest.join(many, "context", "left_anti").drop("context"), "joined-ratios")
    scratch.drop(counts)
    return table, rest


def _scores(urls: DataFrame, keys: list[str], table: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """Mean log-ratio of each row of distinct ``keys``, of which one is ``url``, and with a ``rest`` of the table one is ``row``, a number of its own."""
    characters = F.sum((F.col("g") < first_code(4)).cast("long")).alias("__n")
    total = F.sum(F.col("ratio").cast("decimal(30,12)")).cast("decimal(30,12)").alias("__total")
    scored = with_grams(urls, *keys).join(F.broadcast(table), "g").groupBy(*keys).agg(total, characters)
    if rest is not None:
        more = _grams_of(urls, rest).join(rest.hint("shuffle_merge"), "g").groupBy("row").agg(total.alias("__more"))
        scored = scored.join(more.hint("shuffle_merge"), "row", "left").withColumn("__total", F.col("__total") + F.coalesce("__more", F.lit(0).cast("decimal(30,12)")))
    return scored.select(*keys, (F.col("__total").cast("double") / F.col("__n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """Cut with the least sum of both error rates on ``(score, verdict)``, from a histogram of ``BINS`` bins."""
    b = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1)).alias("b")
    rows = scored.groupBy(b, "verdict").agg(F.count("*").alias("n")).collect()  # at most 2 * BINS rows
    allow, block = [0] * BINS, [0] * BINS
    for r in rows:
        (allow if r.verdict == "allow" else block)[r.b] += r.n
    if not sum(allow) or not sum(block):
        return 0.0
    lost, best, cuts = 0, None, []
    passed = sum(block)
    for i in range(BINS + 1):
        error = lost / sum(allow) + passed / sum(block)
        if best is None or error < best - 1e-12:
            best, cuts = error, [i]
        elif abs(error - best) <= 1e-12:
            cuts.append(i)
        if i < BINS:
            lost, passed = lost + allow[i], passed - block[i]
    middle = (cuts[0] + cuts[-1]) / 2  # ties: the middle of the gap
    return middle / BINS * 2 * SPAN - SPAN


def judge_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", folds: int = 5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    The longest rule that fits (its host or a subdomain, and the start of the
    path) decides; all other URLs are allowed if their score is above a threshold
    that is calibrated on the one in ``folds`` of the rule-decided distinct URLs
    that the models did not learn from.

    Defined cases: a null URL or one without ``://`` has an empty host and path,
    fits no rule and is scored as its text (null: as an empty text); without
    examples of one verdict the threshold is 0; URLs of any length are read whole;
    repeated rows give repeated equal rows; an empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")))
    text, verdict = fitting_rule(rules)
    rows = rows.withColumn("rule", text).withColumn("by_rule", verdict)
    rows = rows.withColumn("url", F.coalesce("url", F.lit(""))).groupBy("page_id", "url", "host", "path", "rule", "by_rule").agg(F.count("*").alias("copies"))
    rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    decided = rows.where("by_rule is not null").groupBy("url", F.col("by_rule").alias("verdict")).agg(F.min("row").alias("row"))
    held = F.pmod(F.xxhash64("url"), F.lit(folds)) == 0
    table, rest = fit_whole(decided.where(~held), spark)
    if rest is not None:
        table, rest = _dealt(rows, table, rest)
    cut = threshold(_scores(decided.where(held), ["row", "url", "verdict"], table, rest))
    keys = ["row", "page_id", "url", "host", "path", "rule", "by_rule", "copies"]
    scored = _scores(rows, keys, table, rest)
    out = scored.withColumn("verdict", F.coalesce("by_rule", F.when(F.col("score") > cut, "allow").otherwise("block")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("page_id", "host", "path", "rule", "verdict", "score")
