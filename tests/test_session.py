"""Whole sessions, files, and streams."""

import json

import pandas as pd
from pyspark.sql import functions as F

from ruleloom.operators import backtest, events, features
from ruleloom.plans.session import export_rules, holdout, lookup, run_session, stepwise
from ruleloom.plans.settings import SessionConfig
from ruleloom.operators.gate import GateParams
from ruleloom.sources import bars as src
from ruleloom.sources import files
from ruleloom.streaming.monitor import monitor

CONFIG = SessionConfig(gate=GateParams(min_tpm=0.5, min_episodes=5), horizons=(1, 2, 3), min_train_months=6)


def test_session_finds_the_planted_edge(spark, walk, tmp_path):
    e = events.Event("LOW", (events.Component(features.Feature("feat", "identity", ("feat",)), threshold=0.1),))
    r = run_session(walk, CONFIG, manual=[e], params=[backtest.Params(buy_type="market", sell=0.05, horizon=1, fee=0.0005)])
    verdicts = {x.ticker: x for x in r.verdicts.collect()}
    assert verdicts["AAA"].verdict != "NON-EDGE" and verdicts["AAA"].profit_factor > 2
    c = r.contracts.where("ticker = 'AAA'").first()
    assert c.direction == "long" and c.h == 1
    assert r.search.where("ticker = 'AAA'").first().p < 0.05
    found = lookup(r, "LOW")
    assert found["event"].event_id == "LOW" and len(found["verdict"]) == 2
    manifest = export_rules(r, tmp_path)
    doc = files.load_json(manifest[0]["path"])
    assert events.Event.from_json(doc["spec"]).text() == e.text()
    assert files.from_yaml((tmp_path / f"{manifest[0]['ticker']}_LOW.yaml").read_text())["event_id"] == "LOW"
    assert r.funnel().count() == 5


def test_mining_session_runs(spark, walk):
    r = run_session(walk.where("rn < 300"), CONFIG, most_features=3, kinds=("identity",))
    assert r.hypotheses.events == len(r.events) > 0
    assert r.summary().count() == r.contracts.count()


def test_session_mines_the_whole_plan_and_reports_what_is_left_out(spark, walk, monkeypatch):
    from ruleloom.plans import session

    wide = walk.where("rn < 300").select("*", *(((F.col("feat") + i / 100) % 1).alias(f"x{i}") for i in range(45)))
    asked, real = [], session.events.generate

    def generate(bars, plan, transforms):
        asked.append((plan, transforms))
        return real(bars, plan[:2], {f.name: [features.Transform()] for f in plan[:2]})

    monkeypatch.setattr(session.events, "generate", generate)
    r = run_session(wide, CONFIG)
    plan, transforms = asked[0]
    assert len(plan) == r.hypotheses.features > 40 and {f"x{i}" for i in range(45)} <= {s for f in plan for s in f.sources}
    assert {t.kind for x in transforms.values() for t in x} == {"identity", "pctrank", "zscore", "delta"}
    assert r.hypotheses.left_out() == [] and "left out" not in r.hypotheses.describe()
    assert r.hypotheses.pairs > 0
    few = run_session(wide, CONFIG, most_features=3, kinds=("identity",), compose_pairs=False).hypotheses
    assert few.features == 3 and few.features_left_out == len(plan) - 3 and few.transforms_left_out > 0 and few.pairs_left_out
    assert f"left out: {len(plan) - 3} features" in few.describe()


def test_stepwise_and_holdout(spark, walk):
    f = features.Feature("feat", "identity", ("feat",))
    v = features.Feature("volume", "identity", ("volume",))
    seed = events.Event("S", (events.Component(f, threshold=0.5),))
    grown = stepwise(walk, [seed], [v])
    assert len(grown) == 1 and grown[0].components[0] == seed.components[0]
    both = holdout(walk.where("rn < 400"), walk.where("rn >= 350").withColumn("close", F.lit(1.0)))
    assert both.count() == 1200 and both.where("rn = 360 and close = 1.0").count() == 0


def test_files_round_trip(spark, walk, tmp_path):
    small = walk.where("rn < 5").select("ticker", "rn", "close")
    files.write_table(small.withColumn("a", F.array("rn")), str(tmp_path / "c"), kind="csv")
    assert files.read_csv(spark, str(tmp_path / "c"), schema="ticker string, rn long, close double, a string").count() == 10
    files.write_table(small, str(tmp_path / "p"), partition_by=("ticker",))
    assert files.read_parquet(spark, str(tmp_path / "p")).count() == 10
    doc = {"a": 1, "b": {"c": [1, 2], "d": None, "e": "x: y"}, "f": True}
    assert files.from_yaml(files.to_yaml(doc)) == doc
    (tmp_path / "k.json").write_text(json.dumps(doc))
    assert files.load_config(tmp_path / "k.json") == doc and files.load_config(None) == {}


def test_time_axis(spark):
    df = spark.createDataFrame([(1_600_000_000_000 + i * 3_600_000,) for i in range(5)], "t long")
    assert src.epoch_unit(df, "t") == "ms"
    out = src.normalise_axis(df, "t")
    assert str(out.agg(F.min("open_dt")).first()[0]) == "2020-09-13 12:26:40"
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert [r.x for r in src.no_nan(bad).collect()] == [None, None, 1.0]


def test_monitor_streams_each_bar_once(spark, tmp_path):
    times = pd.date_range("2024-01-01", periods=6, freq="h")
    rows = pd.DataFrame({"ticker": "A", "open_dt": times, "open": 1.0, "high": 1.0, "low": 1.0, "close": [1.0, 2.0, 3.0, 2.0, 1.0, 5.0], "volume": 1.0})
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    schema = "ticker string, open_dt timestamp, open double, high double, low double, close double, volume double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = monitor(stream, {"up": "close > close_sma"}, keep=3).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = [r.open_dt.hour for r in spark.sql("SELECT open_dt FROM hits ORDER BY open_dt").collect()]
    finally:
        q.stop()
    assert got == [1, 2, 5]
