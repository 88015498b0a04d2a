"""Rule registry: correlations, duplicates, transfer to other tickers, export, and promotion."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.operators.events import Component, Event


def jaccard_by_date(rules: DataFrame, least: int = 0) -> DataFrame:
    """``(rule_a, rule_b, jaccard)`` of the pairs ``a < b`` that share a date, from ``(rule_id, dt)``; all others have 0."""
    d = rules.select("rule_id", "dt").distinct()
    n = d.groupBy("rule_id").agg(F.count("*").alias("n"))
    x, y = d.alias("x"), d.alias("y")
    met = x.join(y, (F.col("x.dt") == F.col("y.dt")) & (F.col("x.rule_id") < F.col("y.rule_id"))).groupBy(F.col("x.rule_id").alias("rule_a"), F.col("y.rule_id").alias("rule_b")).agg(F.count("*").alias("shared"))
    p, q = n.alias("p"), n.alias("q")
    out = met.join(p, F.col("rule_a") == F.col("p.rule_id")).join(q, F.col("rule_b") == F.col("q.rule_id")).select("rule_a", "rule_b", "shared", F.col("p.n").alias("na"), F.col("q.n").alias("nb"))
    out = out.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return out.where(F.col("na") + F.col("nb") >= least).select("rule_a", "rule_b", "jaccard")


def gain_correlation(gains: DataFrame, least: int = 10) -> DataFrame:
    """``(rule_a, rule_b, n, spearman)`` of gains summed by date, from ``(rule_id, dt, gain)``.

    Dates of either rule are aligned, a missing side counting 0; dates where both are 0
    are left out, and fewer than ``least`` dates give 0.
    """
    g = gains.groupBy("rule_id", "dt").agg(F.sum("gain").alias("g"))
    ids = g.select("rule_id").distinct()
    p, q = ids.alias("p"), ids.alias("q")
    pairs = p.join(q, F.col("p.rule_id") < F.col("q.rule_id")).select(F.col("p.rule_id").alias("rule_a"), F.col("q.rule_id").alias("rule_b"))  # the result has every pair
    left = pairs.join(g.select(F.col("rule_id").alias("rule_a"), "dt", F.col("g").alias("ga")), "rule_a")
    right = pairs.join(g.select(F.col("rule_id").alias("rule_b"), "dt", F.col("g").alias("gb")), "rule_b")
    both = left.join(right, ["rule_a", "rule_b", "dt"], "full_outer").fillna(0.0, ["ga", "gb"]).where("ga <> 0 or gb <> 0")
    from ruleloom.functions.stats import average_rank

    keys = ("rule_a", "rule_b")
    ranked = both.withColumn("ra", average_rank("ga", *keys)).withColumn("rb", average_rank("gb", *keys))
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("c"))
    return out.select(*keys, "n", F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))).alias("spearman"))


def maxima(matrix: DataFrame, value: str) -> DataFrame:
    """``(rule_id, value)``: each rule's largest value against any other."""
    both = matrix.select(F.col("rule_a").alias("rule_id"), value).union(matrix.select(F.col("rule_b"), value))
    return both.groupBy("rule_id").agg(F.max(value).alias(value))


def mark_duplicates(rules: DataFrame, overlap: DataFrame, threshold: float = 0.70) -> DataFrame:
    """``(rule_id, duplicate_of)``: rules that overlap a strictly better one; of several dominators the one of lowest profit factor."""
    sides = overlap.where(F.col("jaccard") > threshold)
    both = sides.select(F.col("rule_a").alias("rule_id"), F.col("rule_b").alias("other")).union(sides.select("rule_b", "rule_a"))
    pf = rules.select("rule_id", "pf")
    m = both.join(pf, "rule_id").join(pf.select(F.col("rule_id").alias("other"), F.col("pf").alias("other_pf")), "other").where("other_pf > pf")
    dup = m.groupBy("rule_id").agg(F.min_by("other", F.struct("other_pf", "other")).alias("duplicate_of"))
    return rules.select("rule_id").join(dup, "rule_id", "left")


def quantile_of(values: DataFrame, column: str, threshold: float) -> float | None:
    """Share of the values that are at most ``threshold``."""
    return values.where(F.col(column).isNotNull()).agg(F.avg((F.col(column) <= threshold).cast("double"))).first()[0]


def recalibrate(event: Event, source: DataFrame, target: DataFrame) -> Event:
    """The event with every numeric threshold moved to the target's quantile of the source's share; others unchanged."""
    out: list[Component] = []
    for c in event.components:
        if c.kind in ("threshold", "crossing"):
            q = quantile_of(source.select(c.value.alias("x")), "x", float(c.threshold))
            t = None if q is None else target.select(c.value.alias("x")).agg(F.percentile("x", F.lit(q))).first()[0]
            out.append(c if t is None else replace(c, threshold=float(t)))
        else:
            out.append(c)
    return replace(event, components=tuple(out))


def cross_ticker(summary: DataFrame, home: DataFrame, *, floor: float = 1.5, share: float = 0.8) -> DataFrame:
    """``(event_id, ticker, profit_factor, passed)`` on other tickers; passing takes ``max(floor, share * home)``."""
    j = summary.join(home.select("event_id", F.col("ticker").alias("home"), F.col("profit_factor").alias("home_pf")), "event_id").where("ticker <> home")
    return j.select("event_id", "ticker", "profit_factor", (F.col("profit_factor") >= F.greatest(F.lit(floor), share * F.col("home_pf"))).alias("passed"))


def genericity(passed: Column, total: Column) -> Column:
    r = passed / F.nullif(total, F.lit(0))
    return F.when(r >= 1, "GENERIC").when(r >= 2 / 3, "PARTIAL").when(r > 0, "SPECIFIC").otherwise("ISOLATED")


def genericity_of(crossed: DataFrame) -> DataFrame:
    g = crossed.groupBy("event_id").agg(F.sum(F.col("passed").cast("long")).alias("n_passed"), F.count("*").alias("n_tickers"))
    return g.withColumn("genericity", genericity(F.col("n_passed"), F.col("n_tickers")))


def flat_table(crossed: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per rule, a profit-factor column per ticker."""
    return crossed.groupBy("event_id").pivot("ticker", tickers).agg(F.first("profit_factor"))


def ingest(verdicts: DataFrame, ledger: DataFrame, *keys: str) -> DataFrame:
    """Monthly gains of the rules worth keeping."""
    kept = verdicts.where(F.col("verdict").isin("EDGE", "PARTIAL-EDGE")).select(*keys)
    return ledger.join(kept, list(keys), "left_semi").groupBy(*keys, (F.year("fill_dt") * 12 + F.month("fill_dt")).alias("month")).agg(F.sum("net_pct_gain").alias("gain"), F.count("*").alias("n"))


def regime_type(dependency: Column, avoid: Column) -> Column:
    """Conditional on regimes to avoid, specific if concentrated in few months, else agnostic."""
    return F.when(F.size(avoid) > 0, "conditional").when(dependency > 0.30, "specific").otherwise("agnostic")


def evidence_grade(verdict: Column, profit_factor: Column, dsr: Column) -> Column:
    """The grade of a rule that comes without one. What a strong edge takes."""
    strong = F.coalesce((dsr >= 1.5) & (profit_factor >= 3.0), F.lit(False))
    return F.when(verdict == "EDGE", F.when(strong, "A").otherwise("B+")).when(verdict == "PARTIAL-EDGE", "B").otherwise("C")


def diagnostics_vs_verdict(contracts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``(ticker, event_id, grade, diagnostic, verdict)``: a row for each diagnostic of a contract, one without any for none."""
    rows = contracts.select("ticker", "event_id", "grade", F.explode_outer("diagnostics").alias("diagnostic"))
    return rows.join(verdicts.select("ticker", "event_id", "verdict"), ["ticker", "event_id"])


def lottery_only(verdicts: DataFrame, reason: str) -> DataFrame:
    """``(ticker, event_id, n_reasons, lottery_only)`` of partial edges: whether the rotations of the search are all that stands against them."""
    rows = verdicts.where("verdict = 'PARTIAL-EDGE'")
    return rows.select("ticker", "event_id", F.size("reasons").alias("n_reasons"), F.when(F.size("reasons") == 1, F.get("reasons", F.lit(0)).startswith(reason)).otherwise(False).alias("lottery_only"))


def fold_stability(folds: DataFrame, *keys: str, cap: float = 10.0) -> DataFrame:
    """Mean less sample deviation of the folds' capped profit factors."""
    v = F.least(F.col("pf"), F.lit(cap))
    return folds.groupBy(*keys).agg(F.avg(v).alias("m"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("s"), F.count("*").alias("folds")).select(*keys, "folds", (F.col("m") - F.col("s")).alias("score"))


def promotion_gate(rules: DataFrame, *, least_stability: float | None = None) -> DataFrame:
    """Adds ``blocked`` (reasons) and ``promoted``: no duplicates, isolated or inconsistent rules."""
    tests = [("duplicate", F.col("duplicate_of").isNotNull()), ("isolated", F.col("genericity") == "ISOLATED"), ("inconsistent", F.col("verdict") == "NON-EDGE")]
    if least_stability is not None:
        tests.append(("unstable", F.col("score") < least_stability))
    out = rules.withColumn("blocked", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in tests))))
    return out.withColumn("promoted", F.size("blocked") == 0)


def build_registry(verdicts: DataFrame, trades: DataFrame, crossed: DataFrame, *, duplicate_from: float = 0.70, least_stability: float | None = None) -> dict[str, DataFrame]:
    """The registry of a session's validated rules.

    ``verdicts`` has ticker, event_id, verdict, profit_factor, dsr and dependency, ``trades`` the
    ledger, ``crossed`` the results on other tickers.  Returns ``rules`` (with duplicates,
    genericity, grade, regime type, and whether they are promoted), ``overlap``, ``correlation`` and ``monthly``.
    """
    kept = verdicts.where(F.col("verdict").isin("EDGE", "PARTIAL-EDGE")).withColumn("rule_id", F.concat_ws("/", "ticker", "event_id"))
    own = trades.withColumn("rule_id", F.concat_ws("/", "ticker", "event_id")).join(kept.select("rule_id"), "rule_id", "left_semi")
    gains = own.select("rule_id", F.col("fill_dt").alias("dt"), F.col("net_pct_gain").alias("gain"))
    overlap = jaccard_by_date(gains)
    duplicates = mark_duplicates(kept.select("rule_id", F.col("profit_factor").alias("pf")), overlap, duplicate_from)
    transfer = genericity_of(crossed).select("event_id", "n_passed", "n_tickers", "genericity")
    grade = evidence_grade(F.col("verdict"), F.col("profit_factor"), F.col("dsr"))
    none = F.array().cast("array<string>")
    avoid = F.coalesce("avoid", none) if "avoid" in verdicts.columns else none
    rules = kept.join(duplicates, "rule_id", "left").join(transfer, "event_id", "left")
    rules = rules.withColumn("grade", grade).withColumn("regime_type", regime_type(F.col("dependency"), avoid))
    return {
        "rules": promotion_gate(rules, least_stability=least_stability),
        "overlap": overlap,
        "correlation": gain_correlation(gains),
        "monthly": own.groupBy("rule_id", (F.year("fill_dt") * 12 + F.month("fill_dt")).alias("month")).agg(F.sum("net_pct_gain").alias("gain"), F.count("*").alias("n")),
    }


def monitoring_manifest(rules: DataFrame, exported: DataFrame) -> DataFrame:
    """Rules with the file they were exported to, if any."""
    return rules.join(exported.select("ticker", "event_id", "path"), ["ticker", "event_id"], "left")


def equal_signals(a: DataFrame, b: DataFrame) -> bool:
    """Whether two signal tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def redundancy(signals: DataFrame, values: DataFrame, *, jaccard_max: float = 0.85, corr_max: float = 0.95, least: int = 30) -> DataFrame:
    """``(a, b, jaccard, corr, redundant)`` of events by shared bars and of their values by correlation.

    ``signals`` has ``(event_id, ticker, rn)``, ``values`` ``(event_id, ticker, rn, v)``.
    """
    from ruleloom.operators.gate import overlaps

    j = overlaps(signals).groupBy("a", "b").agg((F.sum("shared") / (F.sum("na") + F.sum("nb") - F.sum("shared"))).alias("jaccard"))
    x, y = values.alias("x"), values.alias("y")
    c = x.join(y, (F.col("x.ticker") == F.col("y.ticker")) & (F.col("x.rn") == F.col("y.rn")) & (F.col("x.event_id") < F.col("y.event_id"))).where("x.v is not null and y.v is not null")
    c = c.groupBy(F.col("x.event_id").alias("a"), F.col("y.event_id").alias("b")).agg(F.count("*").alias("n"), F.corr("x.v", "y.v").alias("corr"))
    out = c.join(j, ["a", "b"], "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0))).withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))
    return out.select("a", "b", "jaccard", "corr", ((F.col("jaccard") >= jaccard_max) | F.coalesce(F.abs("corr") >= corr_max, F.lit(False))).alias("redundant"))


# --- views over a session ----------------------------------------------------------------------------


def conversion_funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """``(stage, n)`` in order."""
    rows = [df.agg(F.lit(i).alias("i"), F.lit(k).alias("stage"), F.count("*").alias("n")) for i, (k, df) in enumerate(stages.items())]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.orderBy("i").drop("i")


def dead_candidates(candidates: DataFrame, contracts: DataFrame) -> DataFrame:
    """Candidates without a contract (dead), with undetermined ones only, or actionable."""
    c = contracts.groupBy("event_id").agg(F.max((F.col("direction") != "undetermined").cast("int")).alias("any"))
    status = F.when(F.col("any").isNull(), "dead").when(F.col("any") == 0, "undetermined_only").otherwise("actionable")
    return candidates.join(c, "event_id", "left").select("event_id", status.alias("status"))


def reasons_by(df: DataFrame, key: str, reasons: str = "reasons") -> DataFrame:
    """``(key, reason, n)``; rows without reasons count under null."""
    return df.select(key, F.explode_outer(reasons).alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))


def duplicate_clusters(dups: DataFrame) -> DataFrame:
    """``(dominant, members)`` of marked duplicates."""
    return dups.where("duplicate_of is not null").groupBy(F.col("duplicate_of").alias("dominant")).agg(F.array_sort(F.collect_set("rule_id")).alias("members"))


def latest(df: DataFrame, *keys: str, order: str) -> DataFrame:
    """One row per key: the last by ``order`` (keep-last made explicit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
