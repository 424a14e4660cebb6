"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import chat, decontaminate, licenses, mixing, neardup, ngram_lm, pii, ranking, rules, simhash, templates, trie, whitening
from quarryline.llm.common import table


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licence_paragraphs(table(spark, sf_dir, "documents"))


def op4_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.language_scores(table(spark, sf_dir, "documents"))


def op11_exact_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_preorder_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_perspectives": op1_chat_perspectives,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_paragraphs": op3_license_paragraphs,
    "op4_bag_min_hash": op4_bag_min_hash,
    "op5_water_filling": op5_water_filling,
    "op6_bradley_terry": op6_bradley_terry,
    "op7_qgram_lemma": op7_qgram_lemma,
    "op8_template_deduction": op8_template_deduction,
    "op9_weak_supervision": op9_weak_supervision,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_exact_scatter": op11_exact_scatter,
    "op12_preorder_intervals": op12_preorder_intervals,
    "op13_pigeonring": op13_pigeonring,
    "pipeline": pipeline,
}

#: DuckDB SQL for those that SQL expresses.
ORACLES: dict[str, str] = {"op1_chat_perspectives": chat.ORACLE, "op5_water_filling": mixing.ORACLE, "op12_preorder_intervals": trie.ORACLE}
