"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, bestfit_pack, chat_windows, gam_quality, host_paths, label_shards, lang_svm, pivotal_mix, probminhash, weak_rules
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_text(table(spark, sf_dir, "pages"))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_windows.read_back(chat_windows.format_windows(own.unionByName(more)))


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(table(spark, sf_dir, "embeddings"))


def op5_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.assign(table(spark, sf_dir, "documents"))


def op6_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_pack.pack(table(spark, sf_dir, "documents"))


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_lang_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_svm.identify(table(spark, sf_dir, "documents"))


def op10_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_host_paths, op2_probminhash, op3_chat_windows, op4_ball_tree, op5_label_shards, op6_gam_quality, op7_bestfit_pack, op8_pivotal_mix, op9_lang_svm, op10_weak_rules)}

SQL: dict[str, str] = {
    "op4_ball_tree": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
}
