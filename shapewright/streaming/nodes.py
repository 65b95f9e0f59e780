"""Constraints without state on streams: the per-node tests, which look nothing up in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nodes import EXPRESSIONS, violations
from ..plans.ast import Shape, ShapeSyntaxError


def check_stream(nodes: DataFrame, column: str, shape: Shape) -> DataFrame:
    """nodes (streaming or not) with `component`, one row for each test of the shape that a node's term fails.

    Only components that a term alone decides are allowed; there is no state, so no watermark is needed.
    """
    if shape.filters or any(c.name not in EXPRESSIONS for c in shape.components):
        raise ShapeSyntaxError("only tests of single nodes can run on a stream")
    tests = violations(F.col(column), list(shape.components))
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]), lambda x: x.isNotNull())
    return nodes.withColumn("component", F.explode(names)).withColumn("severity", F.lit(shape.severity or "Violation"))
