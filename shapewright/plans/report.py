"""What can be asked of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ast import SEVERITIES


def results(report: DataFrame) -> DataFrame:
    """The results themselves, without the rows that explain them."""
    return report.where("own").drop("own")


def at_least(report: DataFrame, severity: str) -> DataFrame:
    """Rows of this severity or a worse one."""
    return report.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(severity) :]))


def conforming(report: DataFrame, nodes: DataFrame, shape: str) -> DataFrame:
    """nodes (this) without a Violation of the shape; a violation without a node speaks against all."""
    bad = report.where((F.col("source_shape") == shape) & (F.col("severity") == "Violation") & F.col("own"))
    named = nodes.join(bad.where("this is not null").select("this").distinct(), "this", "left_anti")
    whole = bad.where("this is null").select(F.lit(1).alias("_any")).limit(1)
    return named.join(F.broadcast(whole), F.lit(True), "left_anti")  # one row at most


def details(report: DataFrame) -> DataFrame:
    """(this, source_shape, child_shape, ...) with each result's explaining rows: the child shape's, below the result's node."""
    r, d = report.where("own and child_shape is not null").alias("r"), report.where("not own").alias("d")
    below = (F.col("d.source_shape") == F.col("r.child_shape")) & (F.col("d.parent") == F.col("r.this"))
    same = F.col("d.this").eqNullSafe(F.col("r.object"))
    return r.join(d, below & same).select("r.this", "r.source_shape", "r.child_shape", F.col("d.this").alias("detail_node"), F.col("d.component").alias("detail_component"), F.col("d.message").alias("detail_message"))


def summary(report: DataFrame) -> DataFrame:
    """(source_shape, component, severity, n) of the results."""
    return results(report).groupBy("source_shape", "component", "severity").agg(F.count("*").alias("n"))
