"""Sources of focus nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Scope, ShapeSyntaxError
from ..plans.context import TOP, union
from ..sources.graph import TripleGraph


def scope_nodes(graph: TripleGraph, scope: Scope) -> DataFrame:
    """(this) of one scope; it may repeat."""
    from ..plans.templates import REGISTRY, run_query

    arg = scope.argument
    match scope.kind:
        case "node":  # it need not be in the data
            return graph.spark.createDataFrame([(arg.key,)], "this string")
        case "class":
            return graph.instances([arg]).select(F.col("s").alias("this"))
        case "object":
            return graph.pred(arg, repeated=True).select(F.col("o").alias("this"))
        case "subject":
            return graph.pred(arg, repeated=True).select(F.col("s").alias("this"))
        case "allObjects" | "allSubjects":
            return graph.holders(graph.predicates, inverse=scope.kind == "allObjects")
        case "query":
            return run_query(graph, arg).select(F.col("scope").alias("this"))
    if template := REGISTRY.scope(scope.kind):
        return template.nodes(graph, arg)
    raise ShapeSyntaxError(f"unknown scope {scope.kind}")


def focus_nodes(graph: TripleGraph, scopes: tuple[Scope, ...]) -> DataFrame:
    """Distinct (parent, this) of the union of scopes."""
    nodes = union([scope_nodes(graph, s) for s in scopes])
    return nodes.where("this is not null").distinct().select(F.lit(TOP).alias("parent"), "this")
