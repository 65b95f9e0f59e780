"""A training-data pipeline of four operators: classifier, quality rules, near-duplicate join, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shapewright.llm import ngram_join, packing, quality_classifier, quality_rules
from shapewright.llm.common import Scratch, table

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("ngram_join", ngram_join.stage),
    ("packing", packing.stage),
]

#: Learned models and packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
