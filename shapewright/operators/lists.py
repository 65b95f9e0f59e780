"""Lists of cons cells in the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.context import Context, union
from ..plans.scratch import cut
from ..sources.graph import FIRST, NIL, REST


def rest_edges(ctx: Context) -> DataFrame:
    """(cell, next), each once; found once for all that walks over them."""
    return cut(ctx.graph.pred(REST).select(F.col("s").alias("cell"), F.col("o").alias("next")))


def cells_of(ctx: Context, rest: DataFrame) -> DataFrame:
    """(this, cell): each focus node and all cells that rest edges lead to from it, itself included.

    Rounds double their reach: after k of them all cells less than 2 ** k edges away are known, and
    `jump` has the pairs of cells that are just so many edges apart. So a list of n cells takes log2(n)
    rounds, and cycles end, as a round that finds nothing new is the last.
    """
    jump = rest
    seen = cut(ctx.focus.select("this").distinct().select("this", F.col("this").alias("cell"), F.lit(1).alias("known")))
    while not jump.isEmpty():
        reached = seen.join(jump, "cell").select("this", F.col("next").alias("cell"), F.lit(0).alias("known"))
        seen = cut(seen.unionByName(reached).groupBy("this", "cell").agg(F.max("known").alias("known")))
        if seen.where("known = 0").isEmpty():
            break
        seen = seen.withColumn("known", F.lit(1))
        far = jump.select(F.col("cell").alias("next"), F.col("next").alias("then"))
        jump = cut(jump.join(far, "next").select("cell", F.col("then").alias("next")).distinct())
    return seen.select("this", "cell")


def check_structure(ctx: Context, cells: DataFrame, rest: DataFrame) -> DataFrame:
    """Lists that don't end at nil, cells with several firsts or rests, and a nil that has one."""
    graph, nil = ctx.graph, f"<{NIL}>"
    focus = ctx.focus
    ended = cells.where(F.col("cell") == nil).select("this")
    endless = ctx.rows(focus.join(ended, "this", "left_anti"), "list", "does not end at nil")

    def several(edges: DataFrame) -> DataFrame:
        # a value other than another: facts that repeat don't matter
        ends = edges.groupBy("cell").agg(F.min("next").alias("low"), F.max("next").alias("high"))
        return ends.where((F.col("low") != F.col("high")) | (F.col("cell") == nil)).select("cell")

    first = graph.pred(FIRST, repeated=True).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    malformed = cut(several(first).unionByName(several(rest)).distinct())
    double = focus.join(cells.join(malformed, "cell"), "this")
    return union([endless, ctx.rows(double, "list", "a cell of the list is malformed", object=F.col("cell"))])


def elements(ctx: Context, cells: DataFrame) -> DataFrame:
    """Distinct (this, value): the elements of each focus node's list."""
    first = ctx.graph.pred(FIRST, repeated=True).select(F.col("s").alias("cell"), F.col("o").alias("value"))
    return cells.join(first, "cell").select("this", "value").distinct()
