"""The flagship: bars to a gated event and its forward advantage, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators import alpha, events, features, gate
from ruleloom.plans.q_events import _MET, BASE5, kpi
from ruleloom.plans.registry import over, query, rounded
from ruleloom.sources.bars import order_bars

#: A close that is low against its 20-bar mean, by rank over 48 bars.
EVENT = events.Event("LOW-RANK", (events.Component(features.Feature("spread_close_sma20", "spread", ("close", "close_sma_20")), features.Transform("pctrank", 48), threshold=0.1),))


@query(
    "flagship_event_study",
    f"""WITH {BASE5}, ev AS (SELECT ticker, 'LOW-RANK' AS event_id, rn, open_dt, active FROM ({EVENT.duckdb('k')})), a AS (SELECT ticker, event_id, rn, open_dt FROM ev WHERE active), {_MET},
f AS (SELECT ticker, rn, ln(lead(close, 5) {over()} / close) AS r FROM bars), ba AS (SELECT ticker, avg(r) AS base FROM f WHERE r IS NOT NULL GROUP BY 1), x AS (SELECT a.ticker, count(*) AS n, avg(r) AS mu FROM a JOIN f USING (ticker, rn) WHERE r IS NOT NULL GROUP BY 1)
SELECT h.ticker, h.event_id, n_episodes::BIGINT AS n_episodes, round(episode_tpm, 6) AS episode_tpm, round(episode_dispersion, 6) AS episode_dispersion, NOT (episode_tpm < 0.5 OR n_episodes < 10 OR coalesce(episode_dispersion > lim, false)) AS passed, x.n::BIGINT AS n, round(mu - base, 6) + 0.0::DOUBLE AS delta
FROM h JOIN x USING (ticker) JOIN ba USING (ticker)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = kpi(order_bars(spark, sf_dir))
    active = events.activations(bars, [EVENT])
    gated = gate.gate(active, bars).select("ticker", "event_id", "n_episodes", "episode_tpm", "episode_dispersion", "passed")
    measured = alpha.excess(active, alpha.forward(bars, (5,))).select("ticker", "event_id", "n", "delta")
    return rounded(gated.join(measured, ["ticker", "event_id"])).withColumn("n", F.col("n").cast("long"))
