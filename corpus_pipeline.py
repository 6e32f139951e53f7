"""Corpus pipeline: the stages that turn ``documents`` into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's documents. Its decisions take effect in what it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tixspark.llm import decontam, langmix, linespread, mixing, setjoin
from tixspark.llm.common import staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter have no language and go."""
    return langmix.reject_unknown(docs, langmix.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are on many sites go from their documents; every document stays, and copies keep their lines for the next stage."""
    return linespread.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays. What is on many sites without the copies goes from it."""
    alone = staged(setjoin.one_per_group(docs))
    return linespread.drop_boilerplate(alone, keep_share=1.0).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words are benchmark passages go."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document left."""
    return mixing.mix_digest(mixing.mix_sources(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: The language model, the components and the mix's random draws are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
