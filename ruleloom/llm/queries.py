"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from ruleloom.llm import queries_models, queries_native, queries_near, queries_text


def pipeline(spark, sf_dir):
    """The rows of the pipeline at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = {}
    for module in (queries_near, queries_native, queries_text, queries_models):
        found |= {name: f for name, f in vars(module).items() if name.startswith("op") and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))) | {"pipeline": pipeline}


def oracle_sql():
    return {
        "op1_ngram_jaccard_join": queries_near.OP1_SQL,
        "op2_vantage_point_search": queries_near.OP2_SQL,
        "op6_mix_sources": queries_native.OP6_SQL,
        "op9_extendible_sharding": queries_native.OP9_SQL,
    }
