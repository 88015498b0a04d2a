"""Registry of queries: each is a function of (spark, sf_dir), with equivalent SQL where SQL can express it.

The SQL helpers below render the same windows that the operators build, for an
engine that shares no code with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that two engines' last bits do not matter; negative zero becomes zero."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def pick(df: DataFrame, expressions: dict[str, Column], digits: int = 6) -> DataFrame:
    return rounded(df.select("ticker", "rn", *(v.alias(k) for k, v in expressions.items())).withColumn("rn", F.col("rn").cast("long")), digits)


# --- SQL text ----------------------------------------------------------------------------------------


def over(k: int | None = None, lead: int = 0, keys: str = "ticker") -> str:
    frame = "" if k is None else f" ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW" if not lead else f" ROWS BETWEEN 1 FOLLOWING AND {lead} FOLLOWING"
    return f"OVER (PARTITION BY {keys} ORDER BY rn{frame})"


def s_full(x: str, k: int, agg: str, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {over(k)} >= {least or k} THEN {agg}({x}) {over(k)} END"


def s_lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) {over()}"


def s_ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def s_round(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def s_select(bars: str, columns: dict[str, str], source: str = "bars", ctes: str = "", digits: int | dict = 6, where: str = "") -> str:
    """One row per bar: ticker, rn and rounded columns."""
    body = ", ".join(f"{s_round(v, digits)} AS {k}" for k, v in columns.items())
    return f"WITH RECURSIVE {bars}{', ' + ctes if ctes else ''} SELECT ticker, rn::BIGINT AS rn, {body} FROM {source}{' WHERE ' + where if where else ''}"
