"""Components and scopes that users define as SQL with parameters, and SQL queries over a graph.

A template's SQL may name, in square brackets: an argument (as a SQL literal), "text" (the argument's
text as it is), l(argument "separator") (a list), p(argument) (a path's triples joined from focus),
s(argument) and c(path argument) (failing nodes of a shape argument, on the focus nodes or on what a
path leads to). [[ and ]] stand for brackets. A template's parts may be SPARQL (sparql=True, as those read
as data are): then [p(argument)] is a property path, a filter says what conforms, and the solutions of a
pattern and the groups of a having violate. A query may be SPARQL instead, with the variable ?this or ?scope. In braces: {focus}, {groups}, {triples}, {p_<local name>}.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Term, iri, literal
from ..sources.graph import TripleGraph
from ..sources.sparql import run_sparql
from ..sources.sparql_syntax import is_sparql
from .ast import Path, ShapeSyntaxError, path
from .context import Context, follow

#: A predicate from parents to their focus nodes, in the queries of templates only.
FOCUS = "urn:focus"
_DIRECTIVE = re.compile(r"\[\[|\]\]|\[([^\[\]]*)\]")
_NAME = re.compile(r"\{(\w+)\}")


def local_name(predicate: str) -> str:
    return re.sub(r"\W", "_", re.split(r"[/#]", predicate)[-1])


def run_sql(graph: TripleGraph, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL whose {names} are DataFrames: those given, {triples}, and {p_<local name>} of predicates."""
    known: dict[str, list[str]] = {}
    for p in graph.predicates:
        known.setdefault("p_" + local_name(p), []).append(p)
    for name in set(_NAME.findall(text)) - set(frames):
        if name == "triples":
            frames[name] = graph.all()
        elif name in known:
            if len(known[name]) > 1:
                raise ShapeSyntaxError(f"{name} may be any of {sorted(known[name])}")
            frames[name] = graph.pred(known[name][0])
        else:
            raise ShapeSyntaxError(f"the query names {name}, which isn't there")
    return graph.spark.sql(text, **{k: v for k, v in frames.items() if f"{{{k}}}" in text})


def run_query(graph: TripleGraph, text: str, **frames: DataFrame) -> DataFrame:
    """A query's rows, whether it is SPARQL or Spark SQL over {names}."""
    return run_sparql(graph, text) if is_sparql(text) else run_sql(graph, text, **frames)


def sparql_literal(value: object) -> str:
    if not isinstance(value, Term):
        value = iri(value) if isinstance(value, str) and re.match(r"\w+:", value) else literal(value)
    if value.kind != "literal":
        return value.key
    text = re.sub(r'["\\\n\r]', lambda m: {"\n": "\\n", "\r": "\\r"}.get(m[0], "\\" + m[0]), value.lex)
    return f'"{text}"' + value.key[value.key.rindex('"') + 1 :]


def sql_literal(value: object) -> str:
    if isinstance(value, Term):
        value = value.key
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else str(value)


@dataclass
class ComponentTemplate:
    """One of: filter (true where a node conforms), pattern (FROM part whose rows violate), having (true where a set conforms), query."""

    name: str
    filter: str | None = None
    pattern: str | None = None
    having: str | None = None
    query: str | None = None
    message: str = ""
    arguments: dict[str, object] = field(default_factory=dict)  # names and defaults
    check: Callable[[dict], bool] | None = None
    sparql: bool = False  # filter, pattern and having are parts of a SPARQL query; having is then true where a set violates
    paths: dict[str, Path] = field(default_factory=dict)  # of templates read as data: where an argument's node has each argument

    def bind(self, given: object) -> dict[str, object]:
        values = dict(self.arguments)
        if isinstance(given, dict):
            if unknown := set(given) - set(values):
                raise ShapeSyntaxError(f"{self.name} has no argument {sorted(unknown)}")
            values |= given
        elif len(values) == 1:
            values = {next(iter(values)): given}
        values = {"argument": given if not isinstance(given, dict) else None} | values
        if self.check and not self.check(values):
            raise ShapeSyntaxError(f"{self.name} can't have the arguments {given!r}")
        return values

    def rows(self, compiler, ctx: Context, given: object) -> DataFrame:
        values = self.bind(given)
        frames: dict[str, DataFrame] = {"focus": ctx.focus, "groups": ctx.groups}
        fill = lambda sql: substitute(sql, values, compiler, ctx, frames)
        message = fill_message(self.message or f"fails {self.name}", values)
        if self.sparql and self.query is None:
            return ctx.rows(self.solutions(ctx, values), self.name, message)
        if self.filter is not None:
            sql = f"SELECT parent, this FROM {{focus}} WHERE NOT coalesce({fill(self.filter)}, false)"
        elif self.pattern is not None:
            sql = f"SELECT DISTINCT focus.parent, focus.this FROM {{focus}} AS focus {fill(self.pattern)}"
        elif self.having is not None:
            sql = f"SELECT g.parent FROM {{groups}} AS g LEFT JOIN {{focus}} AS focus ON g.parent = focus.parent GROUP BY g.parent HAVING NOT coalesce({fill(self.having)}, false)"
        elif self.query is not None:
            sql = fill(self.query)
        else:
            raise ShapeSyntaxError(f"template {self.name} has no body")
        found = run_query(ctx.graph, sql, **frames)
        if is_sparql(sql):
            found = found.select("this").distinct().join(ctx.focus, "this")
        return ctx.rows(found, self.name, message)


    def solutions(self, ctx: Context, values: dict[str, object]) -> DataFrame:
        """(parent, this) that the fragments select of the focus nodes: ?this is bound, ?parent is what it is a value of."""
        if self.filter is None and self.pattern is None and self.having is None:
            raise ShapeSyntaxError(f"template {self.name} has no body")
        fill = lambda part: substitute(part, values, None, None, {}, sparql=True)
        body = f"?parent <{FOCUS}> ?this . " + (fill(self.pattern) if self.pattern else "")
        if self.filter is not None:
            body += f" FILTER(!({fill(self.filter)}))"
        group = f" GROUP BY ?parent ?this HAVING ({fill(self.having)})" if self.having is not None else ""
        graph = ctx.graph.beside(FOCUS, ctx.focus.select(F.col("parent").alias("s"), F.col("this").alias("o")))
        found = run_sparql(graph, f"SELECT DISTINCT ?parent ?this WHERE {{ {body} }}{group}")
        return found.select("parent", "this")


@dataclass
class ScopeTemplate:
    """A query whose column `scope` has the nodes."""

    name: str
    query: str
    arguments: dict[str, object] = field(default_factory=dict)
    paths: dict[str, Path] = field(default_factory=dict)

    def nodes(self, graph: TripleGraph, given: object) -> DataFrame:
        values = ComponentTemplate(self.name, query="", arguments=self.arguments).bind(given)
        return run_query(graph, substitute(self.query, values, None, None, {})).select(F.col("scope").alias("this"))


def fill_message(message: str, values: dict[str, object]) -> str:
    return _DIRECTIVE.sub(lambda m: m[0][0] if m[1] is None else str(values.get(m[1], m[0])), message)


def substitute(sql: str, values: dict[str, object], compiler, ctx: Context | None, frames: dict[str, DataFrame], sparql: bool | None = None) -> str:
    """The text with its directives filled in. In SPARQL a path argument is written as a property path."""
    sparql = is_sparql(sql) if sparql is None else sparql
    constant = sparql_literal if sparql else sql_literal

    def value(name: str) -> object:
        if name not in values:
            raise ShapeSyntaxError(f"no argument {name}")
        return values[name]

    def frame(df: DataFrame) -> str:
        name = f"t{len(frames)}"
        frames[name] = df
        return f"{{{name}}}"

    def one(m: re.Match) -> str:
        if m[1] is None:
            return m[0][0]
        text = m[1].strip()
        if re.fullmatch(r"\w+", text):
            return constant(value(text))
        if n := re.fullmatch(r'"(\w+)"', text):
            return str(value(n[1]))
        if n := re.fullmatch(r'l\((\w+)\s+"([^"]*)"\)', text):
            return n[2].join(map(constant, value(n[1])))
        if sparql and (n := re.fullmatch(r"p\((\w+)\)", text)):
            along = value(n[1])
            return str(along if isinstance(along, Path) else path(along.iri if isinstance(along, Term) else along))
        if ctx is not None:
            if (n := re.fullmatch(r"p\((\w+)\)", text)) and isinstance(value(n[1]), Path):
                return frame(follow(ctx.graph, ctx.focus, value(n[1])))
            if n := re.fullmatch(r"s\((\w+)\)", text):
                return frame(compiler.failures(value(n[1]), ctx))
            if n := re.fullmatch(r"c\((\w+)\s+(\w+)\)", text):
                rows = compiler.below(ctx.on(detail=False), value(n[2]), follow(ctx.graph, ctx.focus.select("this").distinct(), value(n[1])), "c", "", None)
                return frame(rows.select("parent", "this", F.col("object").alias("value")))
        raise ShapeSyntaxError(f"unknown directive [{m[1]}]")

    return _DIRECTIVE.sub(one, sql)


class Registry:
    def __init__(self) -> None:
        self._components: dict[str, ComponentTemplate] = {}
        self._scopes: dict[str, ScopeTemplate] = {}

    def add(self, template: ComponentTemplate | ScopeTemplate) -> None:
        (self._components if isinstance(template, ComponentTemplate) else self._scopes)[template.name] = template

    def component(self, name: str) -> ComponentTemplate | None:
        return self._components.get(name)

    def scope(self, name: str) -> ScopeTemplate | None:
        return self._scopes.get(name)


REGISTRY = Registry()
