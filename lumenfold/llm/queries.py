"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, conversations, decontaminate, host_rules, html_text, jaccard, language_model, merkle, oracles, quality, repeats, token_ids, toxicity, vectors


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_language_model that SQL can express, for the comparison with SQL alone."""
    return language_model.op6_language_model(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


QUERIES = {
    "op1_embeddings": vectors.op1_embeddings,
    "op2_token_ids": token_ids.op2_token_ids,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_repeats": repeats.op4_repeats,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_language_model": language_model.op6_language_model,
    "op7_html": html_text.op7_html,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality": quality.op9_quality,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_merkle": merkle.op11_merkle,
    "op12_host_rules": host_rules.op12_host_rules,
    "op13_conversations": conversations.op13_conversations,
    "language_model_base": language_model_base,
}
ORACLES: dict[str, str] = {
    "op1_embeddings": oracles.OP1,
    "op4_repeats": oracles.OP4,
    "op5_decontamination": oracles.OP5,
    "op10_jaccard": oracles.OP10,
    "op11_merkle": oracles.OP11,
    "op12_host_rules": oracles.OP12,
    "op13_conversations": oracles.OP13,
    "language_model_base": oracles.LANGUAGE_MODEL_BASE,
}
