"""Events: boolean predicates with frozen thresholds, compiled to columns and to SQL text.

A null predicate stays null in an event of one component; an AND of several treats
null as false.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.windows import lag
from ruleloom.operators.features import Feature, Transform

#: Quantiles of a distribution's two tails, and the theoretical z thresholds.
BELOW, ABOVE, ZSCORES = (0.03, 0.05, 0.08, 0.10, 0.15), (0.85, 0.90, 0.92, 0.95, 0.97), (1.0, 1.5, 2.0)


@dataclass(frozen=True)
class Component:
    feature: Feature
    transform: Transform = Transform()
    kind: str = "threshold"  # threshold, crossing, binary, onehot, formula
    direction: str = "below"
    threshold: float | str | None = None

    @property
    def slot(self) -> tuple[str, str]:
        return self.feature.name, self.transform.tag

    @property
    def value(self) -> Column:
        return self.transform.column(self.feature.column())

    def column(self) -> Column:
        if self.kind == "formula":
            return F.coalesce(F.expr(str(self.threshold)).cast("boolean"), F.lit(False))
        if self.kind == "onehot":
            return F.col(self.feature.sources[0]).cast("string") == F.lit(str(self.threshold))
        if self.kind == "binary":
            return F.col(self.feature.sources[0]).cast("double") == F.lit(float(self.threshold))
        x, t = self.value, F.lit(float(self.threshold))
        if self.kind == "crossing":
            before = lag(x)
            return (x < t) & (before >= t) if self.direction == "below" else (x > t) & (before <= t)
        return x < t if self.direction == "below" else x > t

    def text(self) -> str:
        if self.kind == "formula":
            return str(self.threshold)
        if self.kind in ("onehot", "binary"):
            return f"{self.feature.sources[0]} == {self.threshold}"
        x = self.feature.name if self.transform.kind == "identity" else f"{self.transform.kind}({self.feature.name}, {self.transform.size})"
        sign = "<" if self.direction == "below" else ">"
        return f"{x} {'crosses ' if self.kind == 'crossing' else ''}{sign} {float(self.threshold):.6g}"

    def windows(self) -> int:
        """The longest window that this needs."""
        return max([self.transform.size, self.feature.lag, *map(int, re.findall(r"\d+", self.feature.name))], default=0)


@dataclass(frozen=True)
class Event:
    event_id: str
    components: tuple[Component, ...]
    meta: dict = field(default_factory=dict, compare=False)

    def column(self) -> Column:
        if len(self.components) == 1:
            return self.components[0].column()
        out = F.lit(True)
        for c in self.components:
            out = out & F.coalesce(c.column(), F.lit(False))
        return out

    def text(self) -> str:
        return " AND ".join(c.text() for c in self.components)

    def sql(self) -> list[tuple[str, str]]:
        """Select lists in order, each over the one before: feature, transform, condition."""
        features = ", ".join(f"{c.feature.sql()} AS f{i}" for i, c in enumerate(self.components))
        values = ", ".join(f"{c.transform.sql(f'f{i}')} AS v{i}" for i, c in enumerate(self.components))
        before = ", ".join(f"lag(v{i}) OVER (PARTITION BY ticker ORDER BY rn) AS b{i}" for i in range(len(self.components)))
        tests = []
        for i, c in enumerate(self.components):
            t = "NULL" if c.threshold is None else f"'{c.threshold}'" if isinstance(c.threshold, str) else f"{float(c.threshold)!r}::DOUBLE"
            if c.kind == "onehot":
                test = f"f{i}::VARCHAR = {t}"
            elif c.kind == "binary":
                test = f"f{i}::DOUBLE = {t}"
            elif c.kind == "crossing":
                test = f"v{i} < {t} AND b{i} >= {t}" if c.direction == "below" else f"v{i} > {t} AND b{i} <= {t}"
            else:
                test = f"v{i} {'<' if c.direction == 'below' else '>'} {t}"
            tests.append(f"coalesce({test}, false)" if len(self.components) > 1 else test)
        return [("f", features), ("v", values), ("b", before), ("active", " AND ".join(f"({t})" for t in tests))]

    def duckdb(self, source: str) -> str:
        """A whole query that adds ``active`` to the bars in ``source``."""
        (_, f), (_, v), (_, b), (_, test) = self.sql()
        return f"SELECT *, {test} AS active FROM (SELECT *, {b} FROM (SELECT *, {v} FROM (SELECT *, {f} FROM {source})))"

    def dominant_window(self) -> int:
        """The longest window of any component."""
        return max((c.windows() for c in self.components), default=0)

    def to_json(self) -> str:
        return json.dumps({"event_id": self.event_id, "components": [asdict(c) for c in self.components], "meta": self.meta}, default=str)

    @classmethod
    def from_json(cls, text: str) -> Event:
        doc = json.loads(text)
        comps = []
        for c in doc["components"]:
            f = Feature(**c["feature"] | {"sources": tuple(c["feature"]["sources"])})
            comps.append(Component(f, Transform(**c["transform"]), c["kind"], c["direction"], c["threshold"]))
        return cls(doc["event_id"], tuple(comps), doc["meta"])


def is_pointwise(event: Event) -> bool:
    """Whether the event may be built on a part of the bars alone: plain thresholds without transforms or lags."""
    return all(c.kind in ("threshold", "binary", "onehot") and c.transform.kind == "identity" and not c.feature.lag and "_lag" not in c.feature.name for c in event.components)


def formula_event(event_id: str, formula: str) -> Event:
    """A user's SQL condition; null counts as false."""
    return Event(event_id, (Component(Feature(event_id, "identity", ()), kind="formula", threshold=formula),))


def event_id(components: Iterable[Component], i: int) -> str:
    """``EVT-{feature}-{short kind}-{number}``."""
    c = list(components)
    short = {"threshold": "THR", "crossing": "CRS", "binary": "BIN", "onehot": "CAT", "formula": "FRM"}
    return f"EVT-{c[0].feature.name[:20].upper()}-{'AND' if len(c) > 1 else short[c[0].kind]}-{i:04d}"


def thresholds(df: DataFrame, values: dict[str, Column], *, batch: int = 200) -> dict[str, tuple[int, list[float], list[float]]]:
    """For each named value: how many there are, and its exact lower and upper tail quantiles.

    One job per ``batch`` columns, so that no projection grows without bound.
    """
    q = F.array(*map(F.lit, BELOW + ABOVE))
    out = {}
    names = list(values)
    for i in range(0, len(names), batch):
        part = names[i : i + batch]
        wide = df.select(*(values[n].cast("double").alias(f"v{j}") for j, n in enumerate(part)))
        row = wide.agg(*(F.count(f"v{j}").alias(f"n{j}") for j in range(len(part))), *(F.percentile(f"v{j}", q).alias(f"q{j}") for j in range(len(part)))).first()
        for j, n in enumerate(part):
            qs = row[f"q{j}"] or []
            out[n] = (row[f"n{j}"], list(qs[: len(BELOW)]), list(qs[len(BELOW) :]))
    return out


def generate(df: DataFrame, features: list[Feature], transforms: dict[str, list[Transform]], *, binary: Iterable[str] = (), categorical: Iterable[str] = (), most_classes: int = 20, least: int = 10) -> list[Event]:
    """One threshold event per tail quantile of every transformed feature (z-scores also at the theoretical
    ones), a crossing for plain values below; the higher value of binary columns; every class of categories."""
    slots = {f"{f.name}|{t.tag}": (f, t) for f in features for t in transforms[f.name]}
    found = thresholds(df, {k: t.column(f.column()) for k, (f, t) in slots.items()})
    parts: list[Component] = []
    for k, (f, t) in slots.items():
        n, low, high = found[k]
        if n < least:
            continue
        marks = [("below", x) for x in low] + [("above", x) for x in high]
        if t.kind == "zscore":
            marks += [("below", -z) for z in ZSCORES] + [("above", z) for z in ZSCORES]
        for direction, x in marks:
            parts.append(Component(f, t, "threshold", direction, float(x)))
            if t.kind == "identity" and direction == "below":
                parts.append(Component(f, t, "crossing", direction, float(x)))
    for c in binary:
        top = df.agg(F.max(F.col(c).cast("double"))).first()[0]
        parts.append(Component(Feature(c, "identity", (c,)), kind="binary", threshold=top))
    for c in categorical:
        values = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().orderBy(c).limit(most_classes + 1).collect()]
        if len(values) <= most_classes:
            parts += [Component(Feature(c, "identity", (c,)), kind="onehot", threshold=v) for v in values]
    return [Event(event_id((p,), i), (p,)) for i, p in enumerate(parts)]


def activations(df: DataFrame, events: list[Event], *, keep: tuple[str, ...] = ("open_dt",), batch: int = 200) -> DataFrame:
    """Long table ``(ticker, event_id, rn, *keep)``, a row for each bar where an event is active.

    Events are evaluated as columns, ``batch`` per projection, and unpivoted in the same stage.
    """
    out = None
    for i in range(0, len(events), batch):
        part = events[i : i + batch]
        wide = df.select("ticker", "rn", *keep, *(e.column().alias(f"e{j}") for j, e in enumerate(part)))
        on = F.filter(F.array(*(F.when(F.col(f"e{j}"), F.lit(e.event_id)) for j, e in enumerate(part))), lambda x: x.isNotNull())
        rows = wide.select("ticker", F.explode(on).alias("event_id"), "rn", *keep)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no events")
    return out
