"""Shapes to DataFrames: the recursion over shapes, filters and combinators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import str_of
from ..operators import lists, nodes, pairs, scopes, sets
from ..sources.graph import TripleGraph
from . import templates
from .ast import Component, Reference, Shape, ShapeSyntaxError
from .checks import check_program
from .context import REPORT, TOP, Context, follow, union
from .scratch import cut


class Compiler:
    """A program's shapes by name, over one graph."""

    def __init__(self, graph: TripleGraph, shapes: Iterable[Shape], detail: bool = True):
        self.graph, self.shapes, self.detail = graph, list(shapes), detail
        self.named = {s.id: s for s in self.shapes}
        check_program(self.shapes, self.named)

    def run(self, shape: Shape) -> DataFrame | None:
        """The report of a shape over its scopes; None if it has none."""
        if not shape.scopes:
            return None
        spark = self.graph.spark
        focus = scopes.focus_nodes(self.graph, shape.scopes)
        groups = spark.createDataFrame([(TOP,)], "parent string")
        ctx = Context(self.graph, focus, groups, "Violation", shape.id, self.detail)
        rows = self.evaluate(shape, ctx)
        return rows.withColumn("parent", F.when(F.col("parent") != TOP, F.col("parent")))

    def resolve(self, shape: Shape | Reference) -> Shape:
        if isinstance(shape, Shape):
            return shape
        if shape.id not in self.named:
            raise ShapeSyntaxError(f"no shape {shape.id}")
        return self.named[shape.id]

    def enter(self, shape: Shape, ctx: Context) -> Context:
        """The shape's own context: its severity, and its focus nodes that pass its filters."""
        ctx = ctx.on(severity=shape.severity or ctx.severity, shape=shape.id)
        if not shape.filters:
            return ctx
        several = len(shape.filters) > 1 or len(shape.components) > 1
        if several:  # the filters and constraints read the nodes more than once: found once
            ctx = ctx.on(focus=cut(ctx.focus))
        kept = ctx.without(union([self.filtered_out(f, ctx) for f in shape.filters]))
        return kept.on(focus=cut(kept.focus)) if several else kept

    def filtered_out(self, shape: Shape | Reference, ctx: Context) -> DataFrame:
        """(parent, this) that violate a filter. A filter starts from Violation, whatever the context's severity."""
        return ctx.failing(self.evaluate(self.resolve(shape), ctx.on(severity="Violation", detail=False)), "Violation")

    def failures(self, shape: Shape | Reference, ctx: Context) -> DataFrame:
        own = self.resolve(shape)
        return ctx.failing(self.evaluate(own, ctx.on(detail=False)), ctx.severity)

    def evaluate(self, shape: Shape, ctx: Context) -> DataFrame:
        """Report rows (and `own`) of a shape on a context. Per-node tests take one pass, set tests one aggregation."""
        return self.body(shape, self.enter(shape, ctx))

    def body(self, shape: Shape, ctx: Context) -> DataFrame:
        """Report rows of a shape's components on its own context."""
        tests = [c for c in shape.components if c.name in nodes.EXPRESSIONS]
        counts = [c for c in shape.components if c.name in sets.NAMES]
        parts = [nodes.check_nodes(ctx, tests)] if tests else []
        parts += [sets.check_sets(ctx, counts)] if counts else []
        parts += [self.component(c, ctx, shape) for c in shape.components if c not in tests and c not in counts]
        return union(parts) if parts else ctx.empty()

    def component(self, c: Component, ctx: Context, shape: Shape) -> DataFrame:
        arg = c.argument
        match c.name:
            case "class":
                return nodes.check_class(ctx, c.name, [arg])
            case "classIn":
                return nodes.check_class(ctx, c.name, list(arg))
            case "directType":
                return nodes.check_direct_type(ctx, arg)
            case "closed":
                return nodes.check_closed(ctx, list(arg))
            case "equals":
                return pairs.check_equals(ctx, *arg)
            case "disjoint":
                return pairs.check_disjoint(ctx, *arg)
            case "lessThan" | "lessThanOrEquals":
                return pairs.check_less(ctx, c.name, *arg)
            case "uniqueLang":
                return sets.check_unique_lang(ctx) if arg is not False else ctx.empty()
            case "propValues":
                along, then = arg
                values = follow(self.graph, ctx.focus.select("this").distinct(), along)
                return self.below(ctx, then, values, c.name, f"in path {along}", str(along))
            case "list":
                rest = lists.rest_edges(ctx)
                cells = lists.cells_of(ctx, rest)
                found = lists.check_structure(ctx, cells, rest)
                return union([found, self.below(ctx, arg, lists.elements(ctx, cells), c.name, "in list", None)])
            case "shape":
                return self.shape(ctx, arg)
            case "not":
                return ctx.rows(ctx.without(self.failures(arg, ctx)).focus, c.name, "conforms to the shape", child_shape=self.resolve(arg).id)
            case "and":
                parts = [self.shape(ctx, s, "and") for s in arg]
                return union(parts) if parts else ctx.empty()
            case "or":
                left = ctx.focus
                for s in arg:  # only what fails all shapes so far is tried further
                    left = self.failures(s, ctx.on(focus=left))
                return ctx.rows(left, c.name, "conforms to none of the shapes")
            case "partition":
                return self.partition(ctx, arg)
            case "query":
                return self.query(ctx, arg)
        if template := templates.REGISTRY.component(c.name):
            return template.rows(self, ctx, arg)
        raise ShapeSyntaxError(f"unknown component {c.name}")

    def shape(self, ctx: Context, child: Shape | Reference, component: str = "shape") -> DataFrame:
        """Another shape's rows as this one's."""
        child = self.resolve(child)
        return self.relabelled(self.evaluate(child, ctx), ctx, child, component)

    @staticmethod
    def relabelled(rows: DataFrame, ctx: Context, child: Shape, component: str) -> DataFrame:
        named = {"source_shape": F.when(F.col("own"), F.lit(ctx.shape)).otherwise(F.col("source_shape")), "child_shape": F.when(F.col("own"), F.lit(child.id)).otherwise(F.col("child_shape"))}
        return rows.withColumns(named | {"component": F.when(F.col("own"), F.lit(component)).otherwise(F.col("component"))})

    def below(self, ctx: Context, child: Shape | Reference, values: DataFrame, component: str, message: str, predicate: str | None) -> DataFrame:
        """A shape on values (this, value) of the focus nodes: a row for each bad value, and the child's rows as detail.

        The child is evaluated once, on reachable nodes only. A row of its without a node speaks
        against the whole set of values, the empty one too.
        """
        child = self.resolve(child)
        nodes_below = values.select(F.col("this").alias("parent"), F.col("value").alias("this"))
        # a level reads its nodes more than once: cut now and then, so that deep nests don't double the plan each time
        depth = ctx.depth + 1
        inner = ctx.on(focus=cut(nodes_below) if depth % 3 == 0 else nodes_below, depth=depth, groups=ctx.focus.select(F.col("this").alias("parent")).distinct())
        rows = self.evaluate(child, inner)
        bad = rows.where("own").select(F.col("parent").alias("this"), F.col("this").alias("value")).distinct()
        columns = {"object": F.col("value"), "child_shape": F.lit(child.id)} | ({"predicate": F.lit(predicate)} if predicate else {})
        own = ctx.rows(ctx.focus.join(bad, "this"), component, message, **columns)
        return union([own, rows.withColumn("own", F.lit(False))]) if ctx.detail else own

    def partition(self, ctx: Context, cases: tuple[Shape | Reference, ...]) -> DataFrame:
        """Each case judges the nodes that pass its filters and no earlier case's; what is left violates.

        A case without filters takes all.
        """
        parts, left = [], ctx.on(focus=cut(ctx.focus))
        for case in cases:
            case = self.resolve(case)
            own = left.on(severity=case.severity or ctx.severity, shape=case.id)
            remain = None
            if case.filters:
                remain = cut(union([self.filtered_out(f, own) for f in case.filters]).distinct())
                own = own.without(remain)
            parts.append(self.relabelled(self.body(case, own), ctx, case, "partition"))
            if remain is None:
                return union(parts)
            left = left.on(focus=remain)
        return union([*parts, ctx.rows(left.focus, "partition", "Partition not exhaustive")])

    def query(self, ctx: Context, text: str) -> DataFrame:
        """SPARQL, or Spark SQL over {focus}, {groups}, {triples} and a predicate's {p_<local name>}: this, and any report columns."""
        found = templates.run_query(self.graph, text, focus=ctx.focus, groups=ctx.groups)
        if templates.is_sparql(text):  # these report columns are plain text, not terms
            found = found.withColumns({c: F.regexp_replace(str_of(F.col(c)), "^.*[/#]", "") if c == "severity" else str_of(F.col(c)) for c in ("severity", "message", "component") if c in found.columns})
        given = {c: F.col(c) for c in found.columns if c in REPORT and c not in ("parent", "this")}
        rows = found if "parent" in found.columns else found.join(ctx.focus, "this") if "this" in found.columns else found.select("*", F.lit(TOP).alias("parent"))
        return ctx.rows(rows, given.pop("component", "query"), given.pop("message", "found by the query"), **given)


def validate_shape(graph: TripleGraph, shape: Shape, program: Iterable[Shape] = (), detail: bool = True) -> DataFrame:
    """The report of one shape; without a scope no rows."""
    rows = Compiler(graph, [*program, shape], detail).run(shape)
    if rows is None:
        return graph.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT) + ", own boolean")
    return rows


def validate(graph: TripleGraph, program: Iterable[Shape], detail: bool = True) -> DataFrame:
    """The report of all shapes with a scope: the report columns and `own`, false for rows that explain others."""
    compiler = Compiler(graph, program, detail)
    reports = [r for s in compiler.shapes if (r := compiler.run(s)) is not None]
    return union(reports) if reports else graph.spark.createDataFrame([], ", ".join(f"{c} string" for c in REPORT) + ", own boolean")
