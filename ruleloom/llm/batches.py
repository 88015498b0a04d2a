"""Arrow batches of bounded size, so that few texts are in memory at one time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 512
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound(spark: SparkSession) -> None:
    """Rows per Arrow batch of this session, where nobody has set them: Spark's 10,000 are too many for whole texts."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")


def small(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
