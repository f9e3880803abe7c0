"""The corpus pipeline: quality rules, language identification, near-duplicates, mixing and packing, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import bestfit_pack, lang_svm, pivotal_mix, probminhash, weak_rules
from meshwright.llm.shared import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the weak rules keep. Null and wordless texts fail the base and go; repeated rows and rows with one id or none are judged one by
    one; an empty table gives none; further columns, whatever their names, are kept as they are."""
    return weak_rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose language can be told. Null texts and those without a letter go; null languages teach nothing; rows are judged one by one; an
    empty table gives none; further columns are kept as they are."""
    return lang_svm.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the lowest id (an id comes before none). Rows without a word all stay, as they are like
    nothing; of rows equal in id and text one stays; an empty table gives none; further columns are kept as they are."""
    return probminhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it. Null sources are one source; wordless texts are kept as often as their source's whole copies say;
    rows equal in source, id and text share their copies evenly; an empty table gives none; further columns are kept as they are."""
    return pivotal_mix.repeat(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences. Null and empty texts are a separator alone; repeated rows and rows without an id are documents of their
    own; an empty table gives none; other columns are left out."""
    return bestfit_pack.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Fitted models, sketches and hashes decide. Tests hold the stages' operators against plain versions or held-out rows, and the stages' rows against
#: what those operators say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
