"""Shared scratch tables: the only place where an operator cuts its lineage.

Tables go to the folder named by ``spark.checkpoint.dir``, which every executor
and the driver can reach, so a lost executor costs nothing that is written here.
Only in local mode, where driver and executors are one process, may the setting be
missing; then a private folder is made.  An operator drops the tables that its result
does not read; the others go when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it has ended; a table that is written needs none of them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_fallback: str | None = None
_written: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    global _fallback
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="ruleloom-scratch-")
    return _fallback


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{root(spark)}/ruleloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    where, files = _path(spark, path)
    files.deleteOnExit(where)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)
    _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` has written; frames that read them end with this."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def mark() -> int:
    """How many tables are written and not dropped."""
    return len(_written)


def drop_since(mark: int, kept: DataFrame) -> DataFrame:
    """Delete the tables written since ``mark`` but for ``kept``, which reads none of them."""
    for path in [p for p in _written[mark:] if p != kept._scratch_path]:
        _delete(kept.sparkSession, path)
    return kept
