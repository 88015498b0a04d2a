"""Corpus pipeline: drop toxic documents, keep one of each near-duplicate group, replace
personal data, mix the sources to their weights, and encode what is left.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm import scratch
from ruleloom.llm.bpe import encode
from ruleloom.llm.mixing import take
from ruleloom.llm.ngram_join import keep_one
from ruleloom.llm.pii import replace_in_place
from ruleloom.llm.queries_text import vocabulary
from ruleloom.llm.toxicity import drop_toxic, fit_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trees do not predict toxic; labels come from the tables of ``sf_dir``."""
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by Jaccard 0.8 on five-word shingles."""
    return keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; ``n_chars`` follows the new text."""
    return replace_in_place(docs, length_col="n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    return take(docs)


def byte_pair_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row that is left."""
    return encode(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_pair_encoding", byte_pair_encoding),
]

#: No SQL: trees, keyed surrogates and merges are not expressible; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before = scratch.mark()
        docs = scratch.drop_since(before, scratch.cut(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
