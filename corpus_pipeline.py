"""Corpus pipeline: stages over ``documents``, each applying one operator to
all rows that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldpulse.llm.bpe import digests, encode
from fieldpulse.llm.common import read_table, shared_table, ship_package
from fieldpulse.llm.exact_dedup import exact_dedup
from fieldpulse.llm.mixing import take_mix
from fieldpulse.llm.quality_rules import keep_good
from fieldpulse.llm.simhash import near_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest id."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the smallest id."""
    return near_dedup(docs, shingle=4, max_distance=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a document of a second epoch is a second row."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(docs, path), path)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near),
          ("mixing", mixture), ("bpe", tokens)]

#: Fingerprints and token ids cannot be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
