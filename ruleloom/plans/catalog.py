"""Registered queries and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from ruleloom.plans.registry import QUERIES, SQL

MODULES = ("q_indicators", "q_regime", "q_events", "q_alpha", "q_backtest", "q_reports", "q_sessions", "q_flagship")
for _m in MODULES:
    importlib.import_module(f"ruleloom.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_event_study"](spark, sf_dir)
