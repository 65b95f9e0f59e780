"""Constraints on the values of two paths of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.ast import Path
from ..plans.context import Context, follow

ON = ["parent", "this", "value"]


def _sides(ctx: Context, a: Path, b: Path) -> DataFrame:
    """(parent, this, value, low, high): each value once, and the least and greatest number of a path that has it."""
    sides = [follow(ctx.graph, ctx.focus, p, repeated=True).select(*ON, F.lit(n).alias("side")) for n, p in ((1, a), (2, b))]
    return sides[0].unionByName(sides[1]).groupBy(*ON).agg(F.min("side").alias("low"), F.max("side").alias("high"))


def check_equals(ctx: Context, a: Path, b: Path) -> DataFrame:
    """One row for each value that only one of the paths has: one aggregation of both."""
    return ctx.rows(_sides(ctx, a, b).where("low = high"), "equals", f"{a} and {b} differ", object=F.col("value"), predicate=str(a))


def check_disjoint(ctx: Context, a: Path, b: Path) -> DataFrame:
    return ctx.rows(_sides(ctx, a, b).where("low < high"), "disjoint", f"{a} and {b} share a value", object=F.col("value"), predicate=str(a))


def check_less(ctx: Context, name: str, a: Path, b: Path) -> DataFrame:
    """One row for each pair of values that isn't in order; values that can't be compared aren't.

    Paths of several steps are made distinct before the pairs are formed, as many of their ways may
    meet; the facts of a single step, which hardly repeat, only in the pairs that are out of order.
    """
    compare = T.less_than if name == "lessThan" else T.less_or_equal
    left, right = (follow(ctx.graph, ctx.focus, p, repeated=len(p.steps) == 1) for p in (a, b))
    pairs = left.join(right.withColumnRenamed("value", "other"), ["parent", "this"])
    bad = pairs.where(~F.coalesce(compare(F.col("value"), F.col("other")), F.lit(False))).distinct()
    return ctx.rows(bad, name, F.concat(F.lit("not in order with "), F.col("other")), object=F.col("value"), predicate=str(a))
