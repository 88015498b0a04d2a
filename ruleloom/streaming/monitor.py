"""Live rules: candles in a stream are tested by published events (an extension; batch is the contract).

State per ticker is the last bars that the longest window needs, so it is bounded by
the rules and not by the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BAR = "ticker string, open_dt timestamp, open double, high double, low double, close double, volume double"


def monitor(candles: DataFrame, rules: dict[str, str], *, keep: int = 200, late: str = "1 day") -> DataFrame:
    """``(ticker, open_dt, rule)`` of bars where a rule holds.

    ``rules`` maps a name to a pandas expression over the bar's columns and
    ``close_sma``, the mean of the last ``keep`` closes.  Candles that come more than
    ``late`` behind the stream are dropped by the watermark.
    """
    columns = ["open_dt", "open", "high", "low", "close", "volume"]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True)[columns].sort_values("open_dt")
        old = pd.DataFrame(list(state.get[0]), columns=columns) if state.exists else new.iloc[:0]
        if len(old):
            old["open_dt"] = pd.to_datetime(old["open_dt"])
        bars = pd.concat([old, new], ignore_index=True) if len(old) else new
        bars = bars.drop_duplicates("open_dt", keep="first").sort_values("open_dt").reset_index(drop=True)
        bars["close_sma"] = bars["close"].rolling(keep, min_periods=1).mean()
        fresh = bars["open_dt"].isin(set(new["open_dt"])) & ~bars["open_dt"].isin(set(old["open_dt"]))
        tail = bars[columns].tail(keep)
        state.update(([tuple([r[0].isoformat(), *map(float, r[1:])]) for r in tail.itertuples(index=False)],))
        hits = [pd.DataFrame({"ticker": key[0], "open_dt": bars.loc[fresh & bars.eval(e).astype(bool), "open_dt"], "rule": n}) for n, e in rules.items()]
        yield pd.concat(hits, ignore_index=True)

    return (
        candles.withWatermark("open_dt", late)
        .groupBy("ticker")
        .applyInPandasWithState(step, "ticker string, open_dt timestamp, rule string", "bars array<struct<open_dt:string,open:double,high:double,low:double,close:double,volume:double>>", "append", "NoTimeout")
    )
