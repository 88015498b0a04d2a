"""File, database and configuration sources and sinks."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", schema: str | None = None) -> DataFrame:
    """Header row; types from ``schema``, or inferred by one more pass if there is none."""
    r = spark.read.option("header", True).option("sep", sep)
    return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """Spark has no Excel reader: a workbook is read on the driver, where it fits by its format."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_jdbc(spark: SparkSession, url: str, dbtable: str, *, symbol: str | None = None, symbol_col: str = "symbol", partition_col: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of candles; the symbol filter is pushed to the database, and a range column splits the read."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", dbtable).options(**options)
    if partition_col and bounds:
        r = r.option("partitionColumn", partition_col).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    df = r.load()
    return df.where(F.col(symbol_col) == symbol) if symbol is not None else df


def write_table(df: DataFrame, path: str, *, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Parquet, CSV (arrays and maps as JSON text) or, where a driver engine exists, Excel; else CSV."""
    if kind == "xlsx":
        try:
            df.toPandas().to_excel(path, index=False)
            return path
        except (ImportError, ModuleNotFoundError):
            kind, path = "csv", path.removesuffix(".xlsx") + ".csv"
    w = df.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def load_config(source: dict | str | Path | None) -> dict[str, Any]:
    """A mapping, or a JSON or YAML file (YAML needs its library, or the plain subset that :func:`to_yaml` writes)."""
    if source is None:
        return {}
    if isinstance(source, dict):
        return dict(source)
    text = Path(source).read_text(encoding="utf-8")
    if str(source).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return from_yaml(text)
    return yaml.safe_load(text) or {}


def yaml_value(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return json.dumps(v, ensure_ascii=False)


def to_yaml(doc: dict[str, Any], indent: int = 0) -> str:
    """Nested mappings in block style; lists and texts as JSON, which YAML contains."""
    pad, out = "  " * indent, []
    for k, v in doc.items():
        out.append(f"{pad}{k}:\n{to_yaml(v, indent + 1)}" if isinstance(v, dict) and v else f"{pad}{k}: {yaml_value(v)}\n")
    return "".join(out)


def from_yaml(text: str) -> dict[str, Any]:
    """Reads what :func:`to_yaml` writes."""
    root: dict[str, Any] = {}
    stack = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = (len(line) - len(line.lstrip())) // 2
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = json.loads(value)
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def save_json(doc: dict[str, Any], path: str | Path) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(doc, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return p


def load_json(path: str | Path) -> dict[str, Any]:
    return json.loads(Path(path).read_text(encoding="utf-8"))
