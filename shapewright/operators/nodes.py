"""Constraints on a single node: expressions that hold where it violates, fused into one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.ast import NODE_KINDS, Component, Step
from ..plans.context import Context
from ..plans.scratch import cut


def _fails(condition: Column) -> Column:
    """An error (NULL) of the condition counts as false, so the node fails."""
    return ~F.coalesce(condition, F.lit(False))


def _range(compare) -> object:
    return lambda t, v: _fails(compare(t, T.constant(v)))


EXPRESSIONS = {
    "in": lambda t, v: ~t.isin([x.key for x in v]) if v else F.lit(True),
    "datatype": lambda t, v: _fails(T.datatype_of(t) == v),
    "datatypeIn": lambda t, v: _fails(T.datatype_of(t).isin(list(v))) if v else F.lit(True),
    "minLength": lambda t, v: T.is_blank(t) | (F.length(T.str_of(t)) < v),
    "maxLength": lambda t, v: T.is_blank(t) | (F.length(T.str_of(t)) > v),
    "minInclusive": _range(lambda t, v: T.less_or_equal(v, t)),
    "minExclusive": _range(lambda t, v: T.less_than(v, t)),
    "maxInclusive": _range(lambda t, v: T.less_or_equal(t, v)),
    "maxExclusive": _range(lambda t, v: T.less_than(t, v)),
    "nodeKind": lambda t, v: ~T.kind(t).isin(*NODE_KINDS[v]),
    "pattern": lambda t, v: T.is_blank(t) | ~T.str_of(t).rlike(T.regex(*v)),
}


def violations(t: Column, components: list[Component]) -> list[tuple[str, Column]]:
    return [(c.name, EXPRESSIONS[c.name](t, c.argument)) for c in components]


def check_nodes(ctx: Context, components: list[Component]) -> DataFrame:
    """All expression components of a shape over one pass of its focus nodes."""
    tests = violations(F.col("this"), components)
    if len(tests) == 1:
        name, bad = tests[0]
        return ctx.rows(ctx.focus.where(bad), name, f"fails {name}")
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]), lambda x: x.isNotNull())
    failing = ctx.focus.select("parent", "this", F.explode(names).alias("_name"))
    return ctx.rows(failing, F.col("_name"), F.concat(F.lit("fails "), F.col("_name")))


def check_class(ctx: Context, name: str, classes: list[str]) -> DataFrame:
    members = ctx.graph.instances(classes).withColumnRenamed("s", "this")
    return ctx.rows(ctx.focus.join(members, "this", "left_anti"), name, "not an instance of " + " or ".join(classes))


def check_direct_type(ctx: Context, cls: str) -> DataFrame:
    from ..sources.graph import TYPE

    typed = ctx.graph.pred(TYPE, repeated=True).where(F.col("o") == f"<{cls}>").select(F.col("s").alias("this")).distinct()
    return ctx.rows(ctx.focus.join(typed, "this", "left_anti"), "directType", f"not directly of type {cls}")


def check_closed(ctx: Context, allowed: list[Step]) -> DataFrame:
    """Nodes with a property that isn't listed; with inverse members also nodes with such an inverse property.

    The predicates that may violate are known here, so only their columns are read, and of them only
    whether there is a value.
    """
    graph, focus = ctx.graph, cut(ctx.focus)
    forward, inverse = ({s.predicate for s in allowed if s.inverse is side} for side in (False, True))
    parts = [graph.holders(set(graph.predicates) - forward)]
    if inverse:
        # literals are objects only, so the columns that hold them matter to literal nodes only
        literals = not focus.where(T.is_literal(F.col("this"))).isEmpty()
        parts.append(graph.holders(set(graph.predicates) - inverse, inverse=True, literals=literals))
    open_nodes = reduce(DataFrame.unionByName, parts)
    # an inner join, as a semi join couldn't broadcast the focus nodes where they are few
    found = focus.join(open_nodes, "this").select("parent", "this").distinct()
    return ctx.rows(found, "closed", "has a property outside the list")
