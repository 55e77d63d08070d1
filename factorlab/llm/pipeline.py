"""Stages of the corpus pipeline, each one operator applied to what its predecessor kept.

All but the last return the columns of ``docs`` with fewer rows or shorter
texts; rules and classifiers learn from the labelled rows among ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import jaccard_join, packing as packer, quality_rules as rules, suffix_dedup, toxicity as toxic
from .common import table
from .queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the boosted trees reject go."""
    ship_package(spark)
    return rules.keep_good(docs, rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    ship_package(spark)
    return toxic.keep_clean(docs, toxic.learn_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows exactly one stays, with the smallest id."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, one_row=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 400 bytes that start twice are cut out; no document goes."""
    ship_package(spark)
    return suffix_dedup.cut_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length of every document left."""
    ship_package(spark)
    return packer.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
