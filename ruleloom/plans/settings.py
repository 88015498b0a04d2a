"""Session configuration: time budget, derivations between stages, checks, presets. Plain Python, no Spark job.

A field left at ``UNSET`` is derived from the session or from another stage; two
producers of one field keep the more conservative value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from ruleloom.operators.gate import GateParams, poisson_window


class _Unset:
    def __repr__(self) -> str:
        return "UNSET"

    def __bool__(self) -> bool:
        return False


UNSET: Any = _Unset()


def is_set(v: Any) -> bool:
    return v is not UNSET


def coalesce(v: Any, default: Any) -> Any:
    return v if is_set(v) else default


def timeframe_minutes(timeframe: str) -> int:
    m = re.fullmatch(r"(\d+)\s*(m|min|h|d|w)", timeframe.strip().lower())
    if not m:
        raise ValueError(f"not a timeframe: {timeframe!r}")
    return int(m[1]) * {"m": 1, "min": 1, "h": 60, "d": 1440, "w": 10080}[m[2]]


def timeframe_class(timeframe: str) -> str:
    n = timeframe_minutes(timeframe)
    return "daily" if n >= 1440 else "intraday" if n >= 60 else "fast"


#: Horizon grids by class of timeframe.
HORIZONS = {"daily": (1, 2, 3, 5, 7, 10), "intraday": (1, 2, 4, 8, 12, 24), "fast": (1, 2, 5, 10, 20, 50)}


def bars_per_month(timeframe: str) -> float:
    return 30.0 * 1440 / timeframe_minutes(timeframe)


@dataclass(frozen=True)
class TimeBudget:
    """In-sample and out-of-sample bars, what is purged before the split, and the embargo after it."""

    n_bars: int
    train_ratio: float = 0.7
    purge: int = 0
    embargo: int = 0

    @property
    def split(self) -> int:
        return round(self.n_bars * self.train_ratio)

    @property
    def event_split(self) -> int:
        """The event stage cuts down, the alpha stage to the nearest bar."""
        return int(self.n_bars * self.train_ratio)

    @property
    def oos_start(self) -> int:
        return min(self.n_bars, self.split + self.embargo)

    @property
    def has_oos(self) -> bool:
        return self.oos_start < self.n_bars

    def purge_slice(self, h: int) -> tuple[int, int]:
        return (max(0, self.split - min(h, self.purge)), self.split) if self.has_oos else (self.split, self.split)

    def describe(self) -> str:
        return f"{self.n_bars} bars: in-sample [0, {self.split}), purge {self.purge}, out-of-sample [{self.oos_start}, {self.n_bars})"


@dataclass
class Ledger:
    """How many hypotheses each stage tested, and what the caller left out."""

    features: int = 0
    events: int = 0
    pairs: int = 0
    contracts: int = 0
    horizons: int = 1
    cells: int = 1
    composed: int = 0  # of the events, those made of pairs, which are counted there
    features_left_out: int = 0
    transforms_left_out: int = 0
    pairs_left_out: bool = False

    @property
    def alpha_surface(self) -> int:
        return self.contracts * self.horizons

    @property
    def total(self) -> int:
        return self.events - self.composed + self.pairs + self.alpha_surface + self.contracts * self.cells

    def describe(self) -> str:
        return f"{self.events} events, {self.pairs} pairs, {self.alpha_surface} event-horizons, {self.contracts * self.cells} cells: {self.total} hypotheses" + (f"; left out: {', '.join(self.left_out())}" if self.left_out() else "")

    def left_out(self) -> list[str]:
        counts = {"features": self.features_left_out, "transforms of the others": self.transforms_left_out}
        return [f"{n} {k}" for k, n in counts.items() if n] + ["pairs"] * self.pairs_left_out


@dataclass(frozen=True)
class SessionConfig:
    timeframe: str = "1d"
    n_bars: int = 0
    measured_bar_hours: float | None = None
    train_ratio: float = 0.7
    gate: GateParams = GateParams()
    horizons: Any = UNSET
    target_h: Any = UNSET
    delay: Any = UNSET
    stable_window: Any = UNSET
    fee: float = 0.002
    rule_fee: Any = UNSET
    embargo: int = 0
    rule_embargo: Any = UNSET
    rule_tpm: Any = UNSET
    min_train_months: Any = UNSET
    cross_pf_floor: Any = UNSET
    partial_pf: Any = UNSET
    tp_floor: Any = UNSET
    mfe_floor: float = 0.005
    test_splits: int = 4
    alpha: float = 0.05
    bars_per_episode: float = 1.76
    policy: str = "last"  # or consensus
    fdr_q: float = 0.10
    auc_p: float = 0.10
    oos_p: float = 0.10
    min_lift: float | None = None
    min_cohens_d: float = 0.0
    criteria: dict = field(default_factory=dict)


@dataclass
class Finding:
    level: str
    code: str
    text: str


@dataclass
class Resolution:
    config: SessionConfig
    trace: list[tuple[str, Any, str]] = field(default_factory=list)
    findings: list[Finding] = field(default_factory=list)

    @property
    def worst(self) -> str:
        return "FAIL" if any(f.level == "FAIL" for f in self.findings) else "WARN" if self.findings else "OK"

    def to_text(self) -> str:
        return "\n".join([f"configuration: {self.worst}", *(f"  {k} = {v} ({why})" for k, v, why in self.trace), *(f"  {f.level} {f.code}: {f.text}" for f in self.findings)])


#: Field, the fields that it needs, how to derive it, and why.
RULES: list[tuple[str, tuple[str, ...], Any, str]] = [
    ("horizons", ("timeframe",), lambda c: HORIZONS[timeframe_class(c.timeframe)], "grid of the timeframe's class"),
    ("target_h", ("horizons",), lambda c: max(c.horizons), "largest horizon"),
    ("delay", ("timeframe",), lambda c: max(1, round(360 / timeframe_minutes(c.timeframe))), "six hours in bars"),
    ("stable_window", ("timeframe",), lambda c: max(2, round(720 / timeframe_minutes(c.timeframe))), "twelve hours in bars"),
    ("rule_fee", ("fee",), lambda c: c.fee, "fee of the alpha stage"),
    ("rule_embargo", ("embargo",), lambda c: c.embargo, "embargo of the alpha stage"),
    ("rule_tpm", ("gate",), lambda c: c.gate.min_tpm * (c.bars_per_episode if c.gate.counting == "episode" else 1.0), "declared rate in bars"),
    ("min_train_months", ("rule_tpm",), lambda c: poisson_window(10, c.rule_tpm), "ten trades at the declared rate, with 95 % confidence"),
    ("partial_pf", (), lambda c: 1.5, "default"),
    ("cross_pf_floor", ("partial_pf",), lambda c: c.partial_pf, "partial profit factor"),
    ("tp_floor", ("mfe_floor",), lambda c: c.mfe_floor, "floor of the favourable move"),
]


def topological(rules: list[tuple[str, tuple[str, ...], Any, str]]) -> list[str]:
    """Fields in an order in which each comes after those that it needs; a cycle is an error."""
    needs = {r[0]: {n for n in r[1] if any(n == q[0] for q in rules)} for r in rules}
    out: list[str] = []
    while needs:
        ready = [k for k, v in needs.items() if v <= set(out)]
        if not ready:
            raise ValueError(f"rules form a cycle: {sorted(needs)}")
        out += ready
        for k in ready:
            needs.pop(k)
    return out


def resolve(config: SessionConfig, *, strict: bool = True) -> Resolution:
    """Fill what is unset, then check that the stages fit each other; FAIL raises if strict."""
    by_name = {r[0]: r for r in RULES}
    out = Resolution(config)
    for name in topological(RULES):
        if not is_set(getattr(out.config, name)):
            value = by_name[name][2](out.config)
            out.config = replace(out.config, **{name: value})
            out.trace.append((name, value, by_name[name][3]))
    c = out.config
    add = lambda level, code, text: out.findings.append(Finding(level, code, text))
    months = c.n_bars / bars_per_month(c.timeframe) if c.n_bars else None
    if months is not None:
        tests = months - c.min_train_months
        if tests <= 0 or tests / c.test_splits * c.rule_tpm < 10:
            add("FAIL" if tests <= 0 else "WARN", "wf_bucket_too_short", f"{max(tests, 0):.1f} months for {c.test_splits} test windows at {c.rule_tpm:g} trades a month")
        if months * c.train_ratio * c.gate.min_tpm < c.gate.min_episodes:
            add("WARN", "m1_is_window_too_short", f"{c.gate.min_episodes} episodes are not due in-sample")
        if months * (1 - c.train_ratio) / 3 * c.gate.min_tpm < 3:
            add("WARN", "m1_oos_fold_too_short", "fewer than three episodes are due in a fold")
    if c.measured_bar_hours is not None and abs(c.measured_bar_hours * 60 / timeframe_minutes(c.timeframe) - 1) > 0.05:
        add("WARN", "timeframe_mismatch", f"bars are {c.measured_bar_hours:g} hours apart, {c.timeframe} is declared")
    if c.rule_fee != c.fee:
        add("WARN", "fee_mismatch", f"{c.rule_fee:g} in backtests, {c.fee:g} in the alpha stage")
    if c.cross_pf_floor > c.partial_pf:
        add("WARN", "registry_stricter", "transfer asks for more than a partial edge")
    if c.tp_floor < c.mfe_floor:
        add("WARN", "tp_floor", "a take-profit may lie below the favourable move's floor")
    if c.min_train_months >= 600:
        add("FAIL", "rate_unreachable", "ten trades are not due in any window")
    if strict and out.worst == "FAIL":
        raise ValueError(out.to_text())
    return out


#: What each preset asks for. Rates are a month's of daily bars: of active bars, of episodes, and of trades.
PRESETS = {
    "sniper": {"tpm": 1.0, "episode_tpm": 0.3, "rule_tpm": 1.0, "dispersion": 1.0, "margin": 1.05, "min_episodes": 10, "pf": 2.5, "win_rate": 0.60, "score": 0.40, "fill": 0.80, "lift": 0.10, "cohens_d": 0.15, "fdr_q": 0.05, "oos_p": 0.10},
    "balanced": {"tpm": 3.0, "episode_tpm": 1.0, "rule_tpm": 2.5, "dispersion": 2.0, "margin": 1.30, "min_episodes": 10, "pf": 2.0, "win_rate": 0.55, "score": 0.30, "fill": 0.80, "lift": 0.06, "cohens_d": 0.10, "fdr_q": 0.15, "oos_p": 0.20},
    "sweep": {"tpm": 1.0, "episode_tpm": 0.3, "rule_tpm": 1.0, "dispersion": 2.5, "margin": 1.60, "min_episodes": 5, "pf": 1.8, "win_rate": 0.50, "score": 0.25, "fill": 0.70, "lift": 0.05, "cohens_d": 0.05, "fdr_q": 0.25, "oos_p": 0.20},
    "burst": {"tpm": 2.5, "episode_tpm": 1.5, "rule_tpm": 2.0, "dispersion": 5.0, "margin": 3.00, "min_episodes": 10, "pf": 2.0, "win_rate": 0.55, "score": 0.30, "fill": 0.80, "lift": 0.08, "cohens_d": 0.12, "fdr_q": 0.10, "oos_p": 0.10},
}
#: The share of a daily dispersion that faster bars are allowed.
DISPERSION = {"daily": 1.0, "intraday": 0.45, "fast": 0.20}


def scale_tpm(daily: float, timeframe: str) -> float:
    """A monthly rate of daily bars, at the bars a month has."""
    return daily * bars_per_month(timeframe) / 30.0


def scale_dispersion(daily: float, timeframe: str) -> float:
    share = DISPERSION[timeframe_class(timeframe)]
    return daily if share == 1.0 else round(daily * share, 2)


def preset(name: str, timeframe: str = "1d", train_ratio: float = 0.7, *, counting: str = "episode", **changes) -> SessionConfig:
    """A named configuration, scaled to the timeframe; ``changes`` replace any of its numbers."""
    if name not in PRESETS:
        raise ValueError(f"{name!r} is none of {', '.join(PRESETS)}")
    if unknown := set(changes) - set(PRESETS[name]):
        raise ValueError(f"not a number of a preset: {', '.join(sorted(unknown))}")
    p = PRESETS[name] | changes
    rate = scale_tpm(p["episode_tpm" if counting == "episode" else "tpm"], timeframe)
    own = GateParams(min_tpm=rate, max_dispersion=scale_dispersion(p["dispersion"], timeframe), margin=p["margin"], counting=counting, min_episodes=p["min_episodes"])
    return SessionConfig(timeframe=timeframe, train_ratio=train_ratio, gate=own, rule_tpm=scale_tpm(p["rule_tpm"], timeframe), fdr_q=p["fdr_q"], oos_p=p["oos_p"], min_lift=p["lift"], min_cohens_d=p["cohens_d"], criteria={"pf": p["pf"], "wr": p["win_rate"], "score": p["score"], "fill": p["fill"]})
