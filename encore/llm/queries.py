"""Registered queries of this package: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm import bbit_minhash, chat_template, ctw, decontaminate, importance, language_id, mixing, ngram_join, periodic_runs, pii
from encore.llm import quality_rules, toxicity, url_rules
from encore.llm.common import fold, prepare, table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs, n=3, similar=90, plan=ngram_join.PLAN_90)


def op2_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_template.digest(chat_template.with_probe(table(spark, sf_dir, "conversations")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target",
                          (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw.score(table(spark, sf_dir, "documents"), fold() != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                      "score", "n_bytes")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").filter(fold() != 0))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(fold() != 0))
    return language_id.label(docs, model, spans=False) \
        .select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic_runs.planted().alias("text"))
    return periodic_runs.digest(periodic_runs.collapse(docs))


def op12_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, similar=85)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_chat_template": op2_chat_template, "op3_pii": op3_pii, "op4_decontaminate": op4_decontaminate, "op5_url_rules": op5_url_rules, "op6_mixing": op6_mixing, "op7_ctw": op7_ctw, "op8_toxicity": op8_toxicity, "op9_language_id": op9_language_id, "op10_quality_rules": op10_quality_rules,
           "op11_periodic_runs": op11_periodic_runs, "op12_bbit_minhash": op12_bbit_minhash, "op13_importance": op13_importance}


def _prepared(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    return run


def queries() -> dict:
    return {name: _prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": ngram_join.oracle(3, 90), "op2_chat_template": chat_template.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op5_url_rules": url_rules.oracle(), "op6_mixing": mixing.ORACLE,
            "op11_periodic_runs": periodic_runs.ORACLE, "op12_bbit_minhash": bbit_minhash.oracle(3, 85), "op13_importance": importance.ORACLE}
