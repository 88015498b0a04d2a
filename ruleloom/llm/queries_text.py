"""Queries of the operators that read or rewrite whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleloom.llm.bpe import digests, encode
from ruleloom.llm.fingerprint import fingerprint_documents


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, which every machine holds."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_byte_pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary(), memo=400_000))


def op8_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
