"""Queries of the operators that train a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.lm_score import score_documents
from ruleloom.llm.pii import pseudonymise
from ruleloom.llm.toxicity import fit_toxicity, score_toxicity


def op10_toxicity_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(docs, labels))


def op5_surrogate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = F.transform("entities", lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end"), e["surrogate"].alias("surrogate")))
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kept.alias("entities"))


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
