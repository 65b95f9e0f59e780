"""What a component is evaluated on, and the rows that it returns."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import TripleGraph
from ..sources.sparql import run_sparql
from ..sources.sparql_syntax import is_sparql
from .ast import SEVERITIES, Path, Step

REPORT = ("parent", "this", "source_shape", "child_shape", "subject", "predicate", "object", "severity", "component", "message")
TOP = ""  # the parent of a scope's nodes: one group, as NULL would not join


@dataclass(frozen=True)
class Context:
    """focus: distinct (parent, this). groups: distinct (parent), also those without focus nodes."""

    graph: TripleGraph
    focus: DataFrame
    groups: DataFrame
    severity: str
    shape: str
    detail: bool = True
    depth: int = 0

    def on(self, **changes) -> "Context":
        return replace(self, **changes)

    def rows(self, failing: DataFrame, component: str | Column, message: str | Column, **columns: Column | str) -> DataFrame:
        """Report rows of failing (parent, and this where nodes fail); own: the shape's, not of a shape below."""
        this = F.col("this") if "this" in failing.columns else F.lit(None).cast("string")
        given = {
            "parent": F.col("parent"),
            "this": this,
            "source_shape": F.lit(self.shape),
            "child_shape": F.lit(None).cast("string"),
            "subject": this,
            "predicate": F.lit(None).cast("string"),
            "object": F.lit(None).cast("string"),
            "severity": F.lit(self.severity),
            "component": F.lit(component) if isinstance(component, str) else component,
            "message": F.lit(message) if isinstance(message, str) else message,
        } | columns
        return failing.select(*[(F.lit(given[c]) if isinstance(given[c], str) else given[c]).alias(c) for c in REPORT], F.lit(True).alias("own"))

    def empty(self) -> DataFrame:
        return self.rows(self.graph.spark.createDataFrame([], "parent string, this string"), "", "")

    def failing(self, rows: DataFrame, least: str) -> DataFrame:
        """(parent, this) that own rows of this severity or a worse one speak against.

        A row without a node speaks against the whole set of its parent.
        """
        bad = rows.where(F.col("own") & F.col("severity").isin(*SEVERITIES[SEVERITIES.index(least) :]))
        nodes = bad.where("this is not null").select("parent", "this")
        sets = bad.where("this is null").select("parent").distinct()
        return nodes.unionByName(self.focus.join(sets, "parent", "left_semi").select("parent", "this")).distinct()

    def without(self, nodes: DataFrame) -> "Context":
        return self.on(focus=self.focus.join(nodes, ["parent", "this"], "left_anti"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def step_edges(graph: TripleGraph, step: Step) -> DataFrame:
    """(s, o) of a step, which may repeat: a predicate's facts, or the ?subject and ?object of a query."""
    if not is_sparql(step.predicate):
        return graph.pred(step.predicate, repeated=True)
    found = run_sparql(graph, step.predicate).select(F.col("subject").alias("s"), F.col("object").alias("o"))
    return found.where("s is not null and o is not null")


def follow(graph: TripleGraph, nodes: DataFrame, along: Path, start: str = "this", repeated: bool = False) -> DataFrame:
    """nodes with `value`, once for each value that the path leads to from `start`, or more often if repeated.

    Facts are made distinct at the path's end only: one shuffle, after a combination on the map side.
    """
    out = nodes.withColumn("value", F.col(start))
    for step in along.steps:
        near, far = ("o", "s") if step.inverse else ("s", "o")
        edges = step_edges(graph, step).select(F.col(near).alias("value"), F.col(far).alias("_next"))
        out = out.join(edges, "value").drop("value").withColumnRenamed("_next", "value")
    once = len(along.steps) == 1 and graph.is_distinct(along.steps[0].predicate)
    return out if repeated or once else out.distinct()
