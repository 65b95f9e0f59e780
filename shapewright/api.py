"""The public functions in one place, and a command line: python -m shapewright.api DATA SHAPES."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.compiler import validate, validate_shape
from .plans.report import conforming, details, results, summary
from .plans.templates import REGISTRY, ComponentTemplate, ScopeTemplate
from .sources.compact import parse_compact
from .sources.dataset import Dataset
from .sources.graph import TripleGraph
from .sources.shapes_graph import shapes_from_turtle, shapes_to_turtle, templates_from_turtle
from .sources.sparql import run_sparql

__all__ = ["REGISTRY", "ComponentTemplate", "Dataset", "ScopeTemplate", "TripleGraph", "conforming", "details", "load_graph", "load_shapes", "parse_compact", "results", "run_sparql", "shapes_from_turtle", "shapes_to_turtle", "summary", "templates_from_turtle", "validate", "validate_shape"]


def load_graph(spark: SparkSession, location: str) -> TripleGraph:
    """A Turtle file (.ttl, read whole by the driver), N-Triples (.nt, read in parallel) or a folder of tables."""
    if location.endswith(".ttl"):
        text = spark.read.text(location, wholetext=True).first()
        return TripleGraph.from_turtle(spark, text[0] if text else "")
    return TripleGraph.from_ntriples(spark, location) if location.endswith(".nt") else TripleGraph.from_parquet(spark, location)


def load_shapes(spark: SparkSession, location: str) -> list:
    """A Turtle file (.ttl) or a file in the compact syntax."""
    row = spark.read.text(location, wholetext=True).first()
    text = row[0] if row else ""
    return shapes_from_turtle(text) if location.endswith(".ttl") else parse_compact(text)


def main(arguments: list[str]) -> DataFrame:
    spark = SparkSession.builder.getOrCreate()
    report = results(validate(load_graph(spark, arguments[0]), load_shapes(spark, arguments[1])))
    if len(arguments) > 2:
        report.write.parquet(arguments[2])
    else:
        report.show(1000, truncate=False)
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
