"""Corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``docs``. ``run`` applies
them to ``documents``.

Defined cases: null and empty texts fail the quality rules; equal rows are
judged equally; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorlab.llm import pipeline as P
from factorlab.session import cut_lineage, ship_package

STAGES = [
    ("quality_rules", P.quality_rules),
    ("toxicity", P.toxicity),
    ("near_duplicates", P.near_duplicates),
    ("repeated_passages", P.repeated_passages),
    ("packing", P.packing),
]

# The learned stages cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
