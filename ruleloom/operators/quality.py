"""Data quality of candle tables: one aggregate job per section."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.windows import lag

PRICES = ("open", "high", "low", "close")


def schema_counts(df: DataFrame, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """``(column, rows, nulls, not_positive, infinite)``."""
    x = lambda c: F.col(c).cast("double")
    each = [F.struct(F.lit(c).alias("column"), (x(c).isNull() | F.isnan(x(c))).cast("long").alias("a"), F.coalesce((x(c) <= 0).cast("long"), F.lit(0)).alias("b"), F.coalesce((F.abs(x(c)) == float("inf")).cast("long"), F.lit(0)).alias("c")) for c in columns]
    long = df.select(F.explode(F.array(*each)).alias("s")).select("s.*")
    return long.groupBy("column").agg(F.count("*").alias("rows"), F.sum("a").alias("nulls"), F.sum("b").alias("not_positive"), F.sum("c").alias("infinite"))


def magnitudes(df: DataFrame, columns: tuple[str, ...] = PRICES) -> DataFrame:
    """``(magnitude, n, share)`` of all positive prices by power of ten."""
    v = df.select(F.explode(F.array(*(F.col(c).cast("double") for c in columns))).alias("v")).where("v > 0 and v < double('infinity')")
    g = v.groupBy(F.floor(F.log10("v")).cast("int").alias("magnitude")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def scale_is_mixed(mags: DataFrame) -> DataFrame:
    """One row: occupied magnitudes (0.5 % or more), their span, and whether prices live on distant scales."""
    g = mags.where("share >= 0.005").agg(F.count("*").alias("occupied"), (F.max("magnitude") - F.min("magnitude")).alias("span"))
    return g.withColumn("mixed", (F.col("occupied") >= 2) & (F.col("span") >= 2))


def ohlc_violations(df: DataFrame) -> DataFrame:
    """``(check, violations)`` of the six consistency checks."""
    o, h, low, c = map(F.col, PRICES)
    top, bottom = F.greatest(o, h, low, c), F.least(o, h, low, c)
    checks = {"high_below_low": h < low, "high_not_max": h < top, "low_not_min": low > bottom, "close_outside": (c > h) | (c < low), "open_outside": (o > h) | (o < low), "wide_bar": (bottom > 0) & (top / F.nullif(bottom, F.lit(0.0)) > 2)}
    row = df.agg(*(F.coalesce(F.sum(F.coalesce(m, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, m in checks.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in checks))).alias("s")).select("s.*")


def return_outliers(bars: DataFrame, *, z: float = 8.0, high_move: float = 0.5) -> DataFrame:
    """``(ticker, n, median, mad, robust_outliers, extreme_moves)`` of one-bar returns."""
    r = bars.withColumn("r", F.col("close") / F.nullif(lag(F.col("close")), F.lit(0.0)) - 1).where("r is not null")
    m = r.groupBy("ticker").agg(F.percentile("r", F.lit(0.5)).alias("median"))
    r = r.join(F.broadcast(m), "ticker")
    d = r.groupBy("ticker").agg(F.percentile(F.abs(F.col("r") - F.col("median")), F.lit(0.5)).alias("mad"))
    r = r.join(F.broadcast(d), "ticker")
    robust = F.abs(F.col("r") - F.col("median")) / F.nullif(1.4826 * F.col("mad"), F.lit(0.0)) > z
    return r.groupBy("ticker").agg(F.count("*").alias("n"), F.first("median").alias("median"), F.first("mad").alias("mad"), F.sum(F.coalesce(robust, F.lit(False)).cast("long")).alias("robust_outliers"), F.sum((F.abs("r") > high_move).cast("long")).alias("extreme_moves"))


def worst_moves(bars: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` largest one-bar returns per ticker."""
    r = bars.withColumn("before", lag(F.col("close"))).withColumn("r", F.col("close") / F.nullif(F.col("before"), F.lit(0.0)) - 1).where("r is not null and r <> 0")
    w = Window.partitionBy("ticker").orderBy(F.desc(F.abs("r")), "rn")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("ticker", "place", "rn", "open_dt", "before", "close", "r")


def time_continuity(df: DataFrame, order: str) -> DataFrame:
    """``(ticker, duplicates, out_of_order, modal_s, above_modal, suspicious)``; ``order`` is the column of the rows' own order."""
    w = Window.partitionBy("ticker").orderBy(order)
    s = F.unix_micros(F.col("open_dt").cast("timestamp")) / 1e6
    d = df.withColumn("step", s - F.lag(s).over(w))
    first = F.row_number().over(Window.partitionBy("ticker", "open_dt").orderBy(order))
    d = d.withColumn("dup", (first > 1).cast("long"))
    modal = d.where("step > 0").groupBy("ticker", "step").agg(F.count("*").alias("k")).groupBy("ticker").agg(F.min_by("step", F.struct(-F.col("k"), F.col("step"))).alias("modal_s"))
    d = d.join(F.broadcast(modal), "ticker", "left")
    limit = F.greatest(3 * F.col("modal_s"), F.col("modal_s") + 2 * 86400)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return d.groupBy("ticker").agg(F.sum("dup").alias("duplicates"), count(F.col("step") < 0).alias("out_of_order"), F.first("modal_s").alias("modal_s"), count(F.col("step") > F.col("modal_s")).alias("above_modal"), count(F.col("step") > limit).alias("suspicious"))


def overview(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("open_dt").alias("first_dt"), F.max("open_dt").alias("last_dt"), F.datediff(F.max("open_dt"), F.min("open_dt")).alias("days"))


@dataclass
class Finding:
    level: str  # FAIL or WARN
    code: str
    text: str


@dataclass
class QualityReport:
    sections: dict[str, list] = field(default_factory=dict)
    findings: list[Finding] = field(default_factory=list)

    @property
    def worst(self) -> str:
        return "FAIL" if any(f.level == "FAIL" for f in self.findings) else "WARN" if self.findings else "OK"

    def to_text(self) -> str:
        lines = [f"data quality: {self.worst}"]
        for name, rows in self.sections.items():
            lines += [f"-- {name}", *("   " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)]
        return "\n".join(lines + [f"{f.level} {f.code}: {f.text}" for f in self.findings])


def quality_report(bars: DataFrame, *, top: int = 5, high_move: float = 0.5) -> QualityReport:
    """All sections in fixed order; each collects a few rows per ticker or column."""
    mags = magnitudes(bars)
    parts = {"overview": overview(bars), "schema": schema_counts(bars), "scale": mags, "mixed": scale_is_mixed(mags), "ohlc": ohlc_violations(bars), "outliers": return_outliers(bars, high_move=high_move), "worst moves": worst_moves(bars, top), "time": time_continuity(bars, "open_dt")}
    rep = QualityReport({k: v.collect() for k, v in parts.items()})
    add = lambda level, code, text: rep.findings.append(Finding(level, code, text))
    for r in rep.sections["schema"]:
        if r.nulls or r.not_positive or r.infinite:
            add("FAIL" if r.not_positive or r.infinite else "WARN", "schema", f"{r['column']}: {r.nulls} nulls, {r.not_positive} not positive, {r.infinite} infinite")
    if rep.sections["mixed"][0].mixed:
        add("FAIL", "scale_mixed", f"prices span {rep.sections['mixed'][0].span} orders of magnitude")
    for r in rep.sections["ohlc"]:
        if r.violations:
            add("WARN" if r.check in ("open_outside", "wide_bar") else "FAIL", r.check, f"{r.violations} bars")
    for r in rep.sections["outliers"]:
        if r.robust_outliers or r.extreme_moves:
            add("WARN", "outliers", f"{r.ticker}: {r.robust_outliers} robust outliers, {r.extreme_moves} extreme moves")
    for r in rep.sections["time"]:
        if r.duplicates or r.out_of_order:
            add("FAIL", "time", f"{r.ticker}: {r.duplicates} duplicates, {r.out_of_order} out of order")
        if r.suspicious:
            add("WARN", "gaps", f"{r.ticker}: {r.suspicious} suspicious gaps")
    return rep
