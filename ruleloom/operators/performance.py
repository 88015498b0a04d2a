"""Performance of rules over time: equity, drawdown, rolling expectancy, distributions; and a plain HTML page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equity(ledger: DataFrame, *keys: str) -> DataFrame:
    """Running sum of gains in order of exit, and how far it is below its peak so far."""
    w = Window.partitionBy(*keys).orderBy("exit_dt", "signal_rn").rowsBetween(Window.unboundedPreceding, 0)
    e = ledger.withColumn("equity", F.sum("net_pct_gain").over(w))
    return e.withColumn("drawdown", F.col("equity") - F.greatest(F.max("equity").over(w), F.lit(0.0))).select(*keys, "signal_rn", "exit_dt", "equity", "drawdown")


def rolling_expectancy(ledger: DataFrame, *keys: str, days: int = 90, least: int = 5) -> DataFrame:
    """Mean gain of the trades that exited in the ``days`` before, the far end left out."""
    at = F.unix_micros(F.col("exit_dt").cast("timestamp"))
    t = ledger.withColumn("__us", at)
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-(days * 86_400_000_000) + 1, 0)
    return t.select(*keys, "signal_rn", "exit_dt", F.when(F.count("*").over(w) >= least, F.avg("net_pct_gain").over(w)).alias("expectancy"))


def monthly(ledger: DataFrame, *keys: str) -> DataFrame:
    return ledger.groupBy(*keys, F.trunc("fill_dt", "month").alias("month")).agg(F.count("*").alias("n"), F.sum("net_pct_gain").alias("gain"))


def histogram(ledger: DataFrame, *keys: str, low: float = -0.5, high: float = 0.5, bins: int = 20) -> DataFrame:
    """``(bin, n)`` of gains; 0 and ``bins + 1`` hold what lies outside."""
    b = F.least(F.greatest(F.floor((F.col("net_pct_gain") - low) / (high - low) * bins) + 1, F.lit(0)), F.lit(bins + 1)).cast("int")
    return ledger.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))


def kernel_density(ledger: DataFrame, *keys: str, grid: tuple[float, ...]) -> DataFrame:
    """Gaussian kernel density of gains on a small grid, bandwidth by Silverman's rule."""
    s = ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("net_pct_gain").alias("sd"), F.percentile("net_pct_gain", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.least(F.col("sd"), (F.get("q", 1) - F.get("q", 0)) / 1.34)
    s = s.withColumn("h", 0.9 * F.when(spread > 0, spread).otherwise(F.col("sd")) * F.pow("n", F.lit(-0.2))).where("h > 1e-9")
    t = ledger.select(*keys, "net_pct_gain", F.explode(F.array(*map(F.lit, grid))).alias("x")).join(s.select(*keys, "n", "h"), list(keys))
    z = (F.col("x") - F.col("net_pct_gain")) / F.col("h")
    return t.groupBy(*keys, "x").agg((F.sum(F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * 2.5066282746310002)).alias("density"))


def return_distribution(active: DataFrame, bars: DataFrame, h: int = 1) -> DataFrame:
    """Mean and population deviation of ``h``-bar returns, of all bars and of each event's."""
    from ruleloom.functions.windows import lead

    r = bars.select("ticker", "rn", (lead(F.col("close"), h) / F.col("close") - 1).alias("r")).where("r is not null")
    base = r.groupBy("ticker").agg(F.avg("r").alias("base_mean"), F.stddev_pop("r").alias("base_sd"))
    on = active.select("ticker", "event_id", "rn").join(r, ["ticker", "rn"]).groupBy("ticker", "event_id").agg(F.avg("r").alias("event_mean"), F.stddev_pop("r").alias("event_sd"))
    return on.join(base, "ticker")


def svg_line(values: list[float], width: int = 480, height: int = 120) -> str:
    """A polyline of values, scaled to a box."""
    if not values:
        return ""
    low, high = min(values), max(values)
    span = (high - low) or 1.0
    pts = " ".join(f"{i * width / max(1, len(values) - 1):.1f},{height - (v - low) / span * height:.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}"><polyline fill="none" stroke="currentColor" points="{pts}"/></svg>'


def html_table(rows: list, columns: list[str]) -> str:
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r[c])}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def html_report(title: str, sections: dict[str, DataFrame], curves: dict[str, list[float]] | None = None, most_rows: int = 200) -> str:
    """A page without outside resources; each table shows at most ``most_rows`` rows."""
    body = [f"<h1>{html.escape(title)}</h1>"]
    body += [f"<h2>{html.escape(k)}</h2>{svg_line(v)}" for k, v in (curves or {}).items()]
    for k, df in sections.items():
        body.append(f"<h2>{html.escape(k)}</h2>" + html_table(df.limit(most_rows).collect(), df.columns))
    return "<!doctype html><meta charset='utf-8'><style>td,th{padding:2px 8px;text-align:right}</style>" + "".join(body)


def text_report(title: str, sections: dict[str, DataFrame], most_rows: int = 50) -> str:
    lines = [title, "=" * len(title)]
    for k, df in sections.items():
        lines += [f"-- {k}", *("  " + ", ".join(f"{c}={v}" for c, v in r.asDict().items()) for r in df.limit(most_rows).collect())]
    return "\n".join(lines)
