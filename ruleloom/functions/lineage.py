"""Cutting lineage between the stages of a session.

A stage's table is written to the folder that the session names in
``spark.checkpoint.dir``, which all executors share, and read back.  Only in local
mode may the setting be missing; then a private folder is made.  Plans stay small, a
lost executor costs nothing that is written, and the tables go when the driver's
JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_private: list[str] = []


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _private:
            _private.append(tempfile.mkdtemp(prefix="ruleloom-"))
        top = _private[0]
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
