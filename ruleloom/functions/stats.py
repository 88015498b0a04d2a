"""Statistics on aggregated rows: distribution functions, corrections and rank correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EULER = 0.5772156649015329


def beta_regularised(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


def t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or df <= 0 or math.isnan(t) or math.isnan(df):
        return None
    return beta_regularised(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_one_sided(t: float | None, df: float | None) -> float | None:
    """Probability of a larger value."""
    p = t_two_sided(t, df)
    return None if p is None else p / 2 if t > 0 else 1 - p / 2


def t_quantile(p: float, df: float) -> float:
    """By bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_one_sided(mid, df) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def min_detectable_effect(na: int, nb: int, alpha: float = 0.05) -> float:
    return t_quantile(1 - alpha, na + nb - 2) * math.sqrt(1 / na + 1 / nb)


def _map(df: DataFrame, t: str, dof: str, out: str, f) -> DataFrame:
    """P-values on aggregate rows, which are few: Arrow batches of two numbers."""
    import pandas as pd

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a.astype(object).where(a.notna(), None), b.astype(object).where(b.notna(), None))], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    p = F.pandas_udf(run, "double")
    return df.withColumn(out, F.nanvl(p(F.col(t).cast("double"), F.col(dof).cast("double")), F.lit(None).cast("double")))


def with_p_two_sided(df: DataFrame, t: str, dof: str, out: str = "p") -> DataFrame:
    return _map(df, t, dof, out, t_two_sided)


def with_p_greater(df: DataFrame, t: str, dof: str, out: str = "p") -> DataFrame:
    return _map(df, t, dof, out, t_one_sided)


def with_t_quantile(df: DataFrame, p: float, dof: str, out: str) -> DataFrame:
    """The ``p`` quantile of Student's t for each number of degrees of freedom, to two digits of it."""
    import pandas as pd

    def run(a: pd.Series) -> pd.Series:
        known = {x: t_quantile(p, x) for x in set(a.dropna().clip(lower=1.0).round(2))}
        return a.clip(lower=1.0).round(2).map(known).astype("float64")

    run.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(run, "double")(F.col(dof).cast("double")))


def welch(na: Column, ma: Column, va: Column, nb: Column, mb: Column, vb: Column, *, pooled: bool = False) -> tuple[Column, Column]:
    """Statistic and degrees of freedom of a two-sample t test from counts, means and variances."""
    if pooled:
        v = ((na - 1) * va + (nb - 1) * vb) / F.nullif(na + nb - 2, F.lit(0))
        return (ma - mb) / F.nullif(F.sqrt(v * (1 / na + 1 / nb)), F.lit(0.0)), (na + nb - 2).cast("double")
    a, b = va / na, vb / nb
    return (ma - mb) / F.nullif(F.sqrt(a + b), F.lit(0.0)), F.pow(a + b, F.lit(2.0)) / F.nullif(F.pow(a, F.lit(2.0)) / (na - 1) + F.pow(b, F.lit(2.0)) / (nb - 1), F.lit(0.0))


def cohens_d(ma: Column, va: Column, mb: Column, vb: Column) -> Column:
    return (ma - mb) / F.nullif(F.sqrt((va + vb) / 2), F.lit(0.0))


def benjamini_hochberg(df: DataFrame, p: str, q: float, *keys: str, out: str = "significant") -> DataFrame:
    """True up to the largest rank ``i`` with ``p <= i / m * q``; null p is never significant."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__m", F.count(p).over(w)).withColumn("__i", F.when(F.col(p).isNotNull(), F.row_number().over(w.orderBy(F.asc_nulls_last(p)))))
    last = F.max(F.when(F.col(p) <= F.col("__i") / F.col("__m") * q, F.col("__i"))).over(w)
    return ranked.withColumn(out, F.coalesce(F.col("__i") <= last, F.lit(False))).drop("__m", "__i")


def average_rank(c: str, *keys: str) -> Column:
    """Rank from 1, ties sharing their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """``(*keys, n, ic, t, p)``: rank correlation of the rows where both are present, and its two-sided p."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__x", average_rank(x, *keys)).withColumn("__y", average_rank(y, *keys))
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("ic"))
    out = out.withColumn("t", F.col("ic") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("ic") * F.col("ic"), F.lit(0.0)))).withColumn("__df", F.col("n") - 2)
    return with_p_two_sided(out, "t", "__df").drop("__df")


def deflated_sharpe(sr: float, trials: int, n: int) -> float | None:
    if n <= 1 or trials < 1:
        return None
    inner = 1 - EULER * math.log(trials) / math.log(n)
    return sr * math.sqrt(inner) if inner > 0 else None
