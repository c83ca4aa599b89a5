"""A corpus pipeline of five stages; each works on what the stage before it has kept.

The stages are: language ID, near-duplicate groups reduced to one document, benchmark decontamination, mixing of
sources to target weights, and sharding.  Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns
those columns; the last adds the shard.  Rows of any input are handled as the operators' docstrings say:
null and empty texts are rejected by the first stage, extra columns are dropped, equal rows are one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelscope.llm import decontaminate, jaccard, langid, mixing, sharding
from panelscope.llm.common import DOCUMENT, conform, read, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: texts with a letter, if any language could be learned.

    Scores do not decide, since they fall with the length of a text and with the number of languages.
    """
    docs = conform(docs)
    judged = langid.predict(docs, langid.fit(docs), *DOCUMENT)
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select(*DOCUMENT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id; all documents without a word stay."""
    return jaccard.first_of_components(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by the target weights of their sources, in random order."""
    return mixing.mix(docs).select(*DOCUMENT)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies with their shard, its depth and size."""
    return sharding.shard(docs)


STAGES = [
    ("op10_language", language),
    ("op6_near_duplicates", one_of_each_group),
    ("op5_decontamination", uncontaminated),
    ("op3_mixture", mixed),
    ("op1_shards", sharded),
]

#: Language ID and string tiling are not expressible in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
