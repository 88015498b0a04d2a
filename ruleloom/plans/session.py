"""A whole session: bars to vetted rules, every stage a Spark job over long tables.

The driver holds specifications (features, events, grids); bars, activations,
returns and trades stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.lineage import written
from ruleloom.operators import alpha, backtest, compose, events, features, gate, registry
from ruleloom.operators.regime import EmaRegime
from ruleloom.plans.settings import Ledger, SessionConfig, TimeBudget, resolve
from ruleloom.sources.bars import bar_hours
from ruleloom.sources.files import save_json, to_yaml


@dataclass
class SessionResult:
    config: SessionConfig
    budget: TimeBudget
    bars: DataFrame
    events: list[events.Event]
    gated: DataFrame
    active: DataFrame
    contracts: DataFrame
    search: DataFrame
    ledger: DataFrame
    oos: DataFrame
    verdicts: DataFrame
    hypotheses: Ledger = field(default_factory=Ledger)

    def edges(self) -> DataFrame:
        return self.verdicts.where("verdict = 'EDGE'")

    def validated(self) -> DataFrame:
        return self.verdicts.where("verdict in ('EDGE', 'PARTIAL-EDGE')")

    def summary(self) -> DataFrame:
        return alpha.summary(self.contracts.join(self.verdicts.select("ticker", "event_id", "verdict", "reasons"), ["ticker", "event_id"], "left"))

    def submissions(self) -> DataFrame:
        """Validated rules with the contract that each comes from, for the registry."""
        return self.validated().join(self.contracts.drop("n", "p", "t", "direction"), ["ticker", "event_id"])

    def by_grade(self, *grades: str) -> DataFrame:
        return self.contracts.where(F.col("grade").isin(*grades))

    def funnel(self) -> DataFrame:
        return registry.conversion_funnel({"events": self.gated, "passed": self.gated.where("passed"), "contracts": self.contracts, "verdicts": self.verdicts, "edges": self.edges()})


def run_session(bars: DataFrame, config: SessionConfig | None = None, *, params: list[backtest.Params] | None = None, manual: list[events.Event] | None = None, most_features: int | None = None, kinds: tuple[str, ...] | None = None, compose_pairs: bool = True, strict: bool = False) -> SessionResult:
    """Mine events of indicator bars, gate them, measure their advantage, test it against rotations, and backtest.

    ``bars`` has ticker, rn, open_dt, prices and indicator columns, for one ticker or
    several that share thresholds.  ``manual`` events skip mining and are kept even if
    they fail the gate.  All planned features, transforms and pairs are mined;
    ``most_features``, ``kinds`` and ``compose_pairs`` narrow that, and the ledger says so.
    """
    sizes = bars.groupBy("ticker").agg(F.count("*").alias("n_bars"))
    n = sizes.agg(F.max("n_bars")).first()[0]
    hours = bar_hours(bars).agg(F.percentile("bar_hours", F.lit(0.5))).first()[0]
    done = resolve(SessionConfig(n_bars=n, measured_bar_hours=hours) if config is None else config, strict=strict)
    c = done.config
    budget = TimeBudget(n, c.train_ratio, purge=max(c.horizons), embargo=c.embargo)
    if "regime" not in bars.columns:
        bars = EmaRegime(stable_window=c.stable_window).classify(bars)
    # every ticker is cut at its own share of its bars
    bars = bars.join(sizes, "ticker").withColumn("split", F.round(F.col("n_bars") * c.train_ratio).cast("long")).withColumn("event_split", F.floor(F.col("n_bars") * c.train_ratio))
    bars = written(bars.drop("n_bars"), "bars")  # each stage reads tables, not the plans that made them
    splits = written(bars.select("ticker", "split", "event_split").distinct(), "splits")
    inner = bars.where(F.col("rn") < F.col("event_split"))
    first_part = lambda rows, cut: rows.join(splits.select("ticker", F.col(cut).alias("__cut")), "ticker").where(F.col("rn") < F.col("__cut")).drop("__cut")
    mined = [x for x in bars.columns if x not in ("split", "event_split")]

    ledger = Ledger(horizons=len(c.horizons))
    if manual is None:
        classified = features.classify(inner.select(*mined))
        whole = features.freeze(inner, features.plan_features(classified, mined))
        plan = whole if most_features is None else whole[:most_features]
        transforms = {f.name: features.catalogue(f, kinds) for f in plan}
        found = events.generate(inner, plan, transforms)
        ledger.features = len(plan)
        ledger.features_left_out = len(whole) - len(plan)
        ledger.transforms_left_out = sum(len(features.catalogue(f)) - len(transforms[f.name]) for f in plan)
        ledger.pairs_left_out = not compose_pairs
    else:
        found = manual
    ledger.events = len(found)
    every = written(events.activations(bars, found), "activations")
    active = first_part(every, "event_split")
    gated = written(gate.gate(active, inner, c.gate), "gated")
    kept = gated.select("ticker", "event_id") if manual is not None else gated.where("passed").select("ticker", "event_id")
    if compose_pairs and manual is None:
        pool = compose.pool(compose.event_table(bars.sparkSession, found), active.join(kept, ["ticker", "event_id"], "left_semi"))
        pairs = compose.candidate_pairs(pool)
        both = compose.compose_pairs(active, inner, pairs, c.gate)
        ledger.pairs = both.count()
        more = [compose.composed(found, r.a, r.b, len(found) + i) for i, r in enumerate(both.where("passed").select("a", "b").distinct().orderBy("a", "b").collect())]
        if more:
            found = found + more
            ledger.composed, ledger.events = len(more), len(found)
            every = every.unionByName(events.activations(bars, more))
            active = first_part(every, "event_split")
            kept = kept.union(gate.gate(active.where(F.col("event_id").isin([e.event_id for e in more])), inner, c.gate).where("passed").select("ticker", "event_id"))
    active = written(active.join(kept, ["ticker", "event_id"], "left_semi"), "active")

    fwd = written(alpha.forward(bars, tuple(c.horizons), split=F.col("split"), purge=budget.purge), "returns")
    inside = first_part(fwd, "split")
    study = written(alpha.rotation_study(active, inside), "study")
    best = written(alpha.derive_target(study, active, first_part(bars, "split"), q=c.fdr_q, auc_p=c.auc_p, mfe_floor=c.mfe_floor), "targets")
    hit = bars.select("ticker", "rn", *(alpha.binary_target(h, c.tp_floor).alias(f"hit_{h}") for h in c.horizons))
    per = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"hit_{h}").alias("hit")) for h in c.horizons))).alias("x")
    target = hit.select("ticker", "rn", per).select("ticker", "rn", "x.h", "x.hit").join(inside.select("ticker", "rn", "h", "fwd"), ["ticker", "rn", "h"])
    stats = None
    for h in c.horizons:  # a handful; each is one aggregate over the events that chose it
        chosen = best.where(F.col("h") == h).select("ticker", "event_id")
        s = alpha.event_stats(active.join(chosen, ["ticker", "event_id"], "left_semi"), target.where(F.col("h") == h)).withColumn("h", F.lit(h))
        stats = s if stats is None else stats.unionByName(s)
    regimes = bars.select("ticker", "rn", "regime")
    breadth = None
    for h in c.horizons:
        on = active.join(best.where(F.col("h") == h).select("ticker", "event_id"), ["ticker", "event_id"], "left_semi")
        r = alpha.regime_breadth(alpha.regime_sensitivity(on, target.where(F.col("h") == h), regimes)).select("ticker", "event_id", "breadth")
        breadth = r if breadth is None else breadth.unionByName(r)
    contracts = best.join(stats.drop("n"), ["ticker", "event_id", "h"], "left").join(breadth, ["ticker", "event_id"], "left")
    none = F.lit(None).cast("double")
    score = alpha.composite(none, F.col("lift"), F.col("cohens_d"), F.col("z"), F.col("breadth"), weak=F.col("weak"), confirmed=F.lit(False))
    notes = [("weak horizon", F.col("weak")), ("at the end of the grid", F.col("at_boundary")), ("little lift", F.col("lift") < (c.min_lift or 0.0)), ("small effect", F.col("cohens_d") < c.min_cohens_d)]
    contracts = contracts.withColumn("diagnostics", F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(False)), F.lit(k)) for k, x in notes))))
    contracts = contracts.withColumn("composite", score)
    contracts = written(contracts.withColumn("grade", alpha.grade(F.col("composite"))), "contracts")
    search = written(alpha.search_null(active, inside, c.alpha), "search")

    promoted = alpha.promoted(contracts, c.min_lift)
    signals = every.join(promoted.select("ticker", "event_id"), ["ticker", "event_id"], "left_semi")
    base = backtest.Params(buy_type="market", sell=max(0.01, c.tp_floor), horizon=int(c.target_h), fee=c.rule_fee)
    grid = params or backtest.seeded(promoted, base, floor=c.tp_floor)
    ledger.cells = len(params) if params else 9
    ledger.contracts = promoted.count()
    verdicts, trades, oos = backtest.discover(bars, signals, grid, n_splits=c.test_splits, min_train=c.min_train_months, embargo=c.rule_embargo, policy=c.policy, tpm=c.rule_tpm)
    verdicts = verdicts.join(search.select("ticker", F.col("p").alias("rotation_p")), "ticker", "left")
    beaten = (F.col("verdict") == "EDGE") & (F.col("rotation_p") > c.alpha)
    verdicts = verdicts.withColumn("reasons", F.when(F.col("verdict").isin("EDGE", "PARTIAL-EDGE") & (F.col("rotation_p") > c.alpha), F.concat("reasons", F.array(F.lit(backtest.ROTATION_REASON)))).otherwise(F.col("reasons")))
    verdicts = written(verdicts.withColumn("verdict", F.when(beaten, "PARTIAL-EDGE").otherwise(F.col("verdict"))), "verdicts")
    return SessionResult(c, budget, bars, found, gated, active, contracts, search, trades, oos, verdicts, ledger)


def run_sessions(tables: dict[str, DataFrame], config: SessionConfig | None = None, **options) -> dict[str, SessionResult]:
    """A session of each table, say of assets whose thresholds must not be shared; one after the other, each a row of Spark jobs."""
    return {name: run_session(bars, config, **options) for name, bars in tables.items()}


def lookup(result: SessionResult, event_id: str) -> dict:
    """Everything of one event: specification, gate row, contract, verdict."""
    spec = next((e for e in result.events if e.event_id == event_id), None)
    one = lambda df: [r.asDict() for r in df.where(F.col("event_id") == event_id).collect()]
    return {"event": spec, "gate": one(result.gated), "contract": one(result.contracts), "verdict": one(result.verdicts)}


def export_rules(result: SessionResult, folder: str | Path) -> list[dict]:
    """A JSON and a YAML file per validated rule, and a manifest of all; replay needs nothing else."""
    specs = {e.event_id: e for e in result.events}
    rows = result.validated().select("ticker", "event_id", "verdict", "profit_factor", "win_rate", "total_trades").orderBy("ticker", "event_id").collect()
    out = []
    for r in rows:
        e = specs[r.event_id]
        doc = {"ticker": r.ticker, "event_id": r.event_id, "expression": e.text(), "verdict": r.verdict, "stats": {"profit_factor": r.profit_factor, "win_rate": r.win_rate, "trades": r.total_trades}, "columns": sorted({s for c in e.components for s in c.feature.sources})}
        stem = Path(folder) / f"{r.ticker}_{r.event_id}".replace(" ", "_")
        save_json(doc | {"spec": e.to_json()}, stem.with_suffix(".json"))
        stem.with_suffix(".yaml").write_text(to_yaml(doc), encoding="utf-8")
        out.append({"ticker": r.ticker, "event_id": r.event_id, "path": str(stem.with_suffix(".json"))})
    save_json({"rules": out}, Path(folder) / "manifest.json")
    return out


def select_seeds(result: SessionResult, most: int = 5, *, max_jaccard: float = 0.85) -> list[events.Event]:
    """The best validated events, one of each family of features, none that overlaps an earlier one by ``max_jaccard``."""
    ranked = result.submissions().orderBy((F.col("verdict") != "EDGE"), F.desc_nulls_last("composite"), "event_id").select("event_id").collect()
    near = {}
    for r in gate.overlaps(result.active, max_jaccard).select("a", "b").distinct().collect():  # pairs of validated events that nearly coincide
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    by_id = {e.event_id: e for e in result.events}
    chosen, families = [], set()
    for event_id in dict.fromkeys(r.event_id for r in ranked):
        family = tuple(sorted({s for c in by_id[event_id].components for s in c.feature.sources}))
        if family not in families and not near.get(event_id, set()) & {e.event_id for e in chosen}:
            chosen.append(by_id[event_id])
            families.add(family)
        if len(chosen) == most:
            break
    return chosen


def confirm(bars: DataFrame, grown: list[events.Event], params: list[backtest.Params], from_dt, **options) -> DataFrame:
    """``(ticker, event_id, verdict, later_gain, confirmed)`` on search and hold-out bars together.

    An event is confirmed by a validated verdict, or by a mean gain above 0 in the test windows' trades from ``from_dt`` on.
    """
    verdicts, _, oos = backtest.discover(bars, events.activations(bars, grown), params, **options)
    later = oos.where(F.col("fill_dt") >= F.lit(from_dt)).groupBy("ticker", "event_id").agg(F.avg("net_pct_gain").alias("later_gain"))
    out = verdicts.join(later, ["ticker", "event_id"], "left")
    ok = F.col("verdict").isin("EDGE", "PARTIAL-EDGE") | F.coalesce(F.col("later_gain") > 0, F.lit(False))
    return out.select("ticker", "event_id", "verdict", "later_gain", ok.alias("confirmed"))


def stepwise(bars: DataFrame, seeds: list[events.Event], plan: list[features.Feature], *, depth: int = 2, retain: float = 0.2, p: gate.GateParams = gate.GateParams(min_tpm=0.25, margin=3.0, min_episodes=4)) -> list[events.Event]:
    """Grow each seed by the child event, found on its active bars alone, that keeps enough of them and passes the gate."""
    grown: list[events.Event] = []
    for seed in seeds:
        now = seed
        for _ in range(depth - 1):
            on = bars.withColumn("__on", F.coalesce(now.column(), F.lit(False)))
            children = events.generate(on.where("__on"), [f for f in plan if f.name not in {c.feature.name for c in now.components}], {f.name: [features.Transform()] for f in plan})
            children = [c for c in children if c.components[0].kind == "threshold"]
            if not children:
                break
            tried = [events.Event(f"{now.event_id}+{c.event_id}", now.components + c.components) for c in children]
            active = events.activations(bars, tried)
            total = on.where("__on").count()
            sizes = active.groupBy("event_id").agg(F.count("*").alias("n")).where(F.col("n") >= retain * total)
            ok = gate.gate(active.join(sizes.select("event_id"), "event_id", "left_semi"), bars, p).where("passed")
            best = ok.groupBy("event_id").agg(F.sum("n_eff").alias("s")).orderBy(F.desc("s"), "event_id").first()
            if best is None:
                break
            now = next(e for e in tried if e.event_id == best.event_id)
        grown.append(now)
    return grown


def holdout(search: DataFrame, later: DataFrame) -> DataFrame:
    """Search bars followed by hold-out bars; of equal times the search copy stays."""
    both = search.withColumn("__o", F.lit(0)).unionByName(later.withColumn("__o", F.lit(1)))
    w = Window.partitionBy("ticker", "open_dt").orderBy("__o")
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__o")
