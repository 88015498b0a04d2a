import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Two tickers of 600 daily bars; a low ``feat`` is followed by a rise."""
    import numpy as np
    import pandas as pd

    frames = []
    for i, ticker in enumerate(("AAA", "BBB")):
        rng = np.random.default_rng(7 + i)
        n = 600
        feat = rng.random(n)
        step = np.concatenate([[0.0], -0.03 * (feat[:-1] - 0.5) + rng.normal(0, 0.004, n - 1)])
        close = 100 * np.exp(np.cumsum(step))
        open_ = np.concatenate([[100.0], close[:-1]])
        high, low = np.maximum(open_, close) * 1.002, np.minimum(open_, close) * 0.998
        frames.append(pd.DataFrame({"ticker": ticker, "open_dt": pd.date_range("2020-01-01", periods=n), "open": open_, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, n).astype(float), "feat": feat}))
    from pyspark.sql import functions as F

    from ruleloom.functions.windows import with_rn

    df = spark.createDataFrame(pd.concat(frames)).withColumn("open_dt", F.col("open_dt").cast("timestamp_ntz"))
    return with_rn(df).cache()
