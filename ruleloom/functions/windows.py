"""Window building blocks over bars keyed by ``(ticker, rn)``.

``rn`` is the bar's number within its ticker, from 0; it is the clock of every
window.  A window function that needs ``k`` values gives null before it has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ("ticker",)


def by_bar(*keys: str) -> WindowSpec:
    """All windows share this order, so that Spark plans one exchange and one sort for them."""
    return Window.partitionBy(*(keys or KEYS)).orderBy("rn")


def trailing(k: int, *keys: str) -> WindowSpec:
    return by_bar(*keys).rowsBetween(-(k - 1), 0)


def leading(h: int, *keys: str) -> WindowSpec:
    return by_bar(*keys).rowsBetween(1, h)


def full(c: Column, k: int, agg: Callable[[Column], Column], least: int | None = None) -> Column:
    """Aggregate of the last ``k`` bars where at least ``least`` (default all) of them have a value."""
    w = trailing(k)
    return F.when(F.count(c).over(w) >= (k if least is None else least), agg(c).over(w))


def lag(c: Column, k: int = 1) -> Column:
    return F.lag(c, k).over(by_bar())


def lead(c: Column, k: int = 1) -> Column:
    return F.lead(c, k).over(by_bar())


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def with_rn(df: DataFrame, order: str = "open_dt", *keys: str) -> DataFrame:
    """Adds ``rn``; ties in ``order`` would make it arbitrary, so it must be unique per ticker."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*(keys or KEYS)).orderBy(order)) - 1)


def in_chunks(df: DataFrame, run: Callable, schema: str, *, halo: int, rows: int = 100_000) -> DataFrame:
    """Apply ``run(pandas frame sorted by rn)`` to chunks of each ticker's bars.

    A chunk holds ``rows`` bars of one ticker plus the ``halo`` bars before them,
    whose results are dropped; so a very long ticker spreads over many tasks.
    """
    chunk = F.expr(f"rn div {rows}")
    last = F.expr(f"(rn + {halo}) div {rows}")
    sent = df.withColumn("__chunk", F.explode(F.sequence(chunk, last)))

    def one(pdf):
        pdf = pdf.sort_values("rn", kind="stable")
        mine = int(pdf["__chunk"].iloc[0])
        out = run(pdf.drop(columns="__chunk").reset_index(drop=True))
        return out[(out["rn"] >= mine * rows) & (out["rn"] < (mine + 1) * rows)]

    return sent.groupBy("ticker", "__chunk").applyInPandas(one, schema).where("rn is not null")
