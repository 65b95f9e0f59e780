"""SPARQL SELECT queries as DataFrames over a graph.

Patterns become joins on their shared variables, OPTIONAL a left join, EXISTS and MINUS semi and anti joins,
closures (* and +) semi-naive rounds that start from what the pattern already binds. A variable without a value
is NULL, and an expression's error too, so that Spark's three-valued logic is SPARQL's. Patterns that share no
variable become a product, which Catalyst turns into a join where a FILTER relates them.

Values are computed in three kinds: terms (canonical strings), numbers (integer or double) and booleans.
Arithmetic on terms is done in doubles, and what it yields is compared as such. Not there: GRAPH, SERVICE, CONSTRUCT, dates' parts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.ast import ShapeSyntaxError
from ..plans.scratch import cut
from .graph import SUBCLASS, TYPE, TripleGraph
from .sparql_syntax import Query, is_sparql, parse_sparql

__all__ = ["is_sparql", "run_sparql"]


def run_sparql(graph: TripleGraph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """A query's solutions: a column of terms for each variable. Names that differ in case only are refused."""
    query = parse_sparql(text, prefixes)
    rows, names = _Evaluator(graph).query(query)
    if len({n.lower() for n in names}) < len(names):
        raise ShapeSyntaxError(f"the query's variables {names} differ in case only")
    return rows.df.select(*[rows.column(n).alias(n) for n in names])


@dataclass(frozen=True)
class _Rows:
    """Solutions: columns of variables, by name; sure are those that always have a value."""

    df: DataFrame
    columns: dict[str, str]
    sure: frozenset[str]

    def column(self, name: str) -> Column:
        return F.col(self.columns[name]) if name in self.columns else F.lit(None).cast("string")


@dataclass(frozen=True)
class _Value:
    """kind: term, integer, double, number (a double, an integer's value where `whole`) or boolean."""

    kind: str
    col: Column
    whole: Column | None = None

    @property
    def numeric(self) -> bool:
        return self.kind in ("integer", "double", "number")


def _term(v: _Value) -> Column:
    if v.kind == "number":
        return F.when(v.whole, T.literal_col(v.col.cast("long"), T.XSD + "integer")).otherwise(T.literal_col(v.col, T.XSD + "double"))
    return v.col if v.kind == "term" else T.literal_col(v.col, T.XSD + v.kind)


def _number(v: _Value) -> Column:
    if v.numeric:
        return v.col.cast("double")
    if v.kind == "boolean":
        return F.lit(None).cast("double")
    return F.when(_numeric(v.col), T.str_of(v.col).try_cast("double"))


def _numeric(t: Column) -> Column:
    return F.coalesce(T.datatype_of(t).isin([T.XSD + n for n in T.NUMERIC]), F.lit(False)) & T.str_of(t).try_cast("double").isNotNull()


def _truth(v: _Value) -> Column:
    """The effective boolean value; of other terms NULL."""
    if v.kind == "boolean":
        return v.col
    if v.numeric:
        return (v.col != 0) & ~F.isnan(v.col.cast("double"))
    kind, text, number = T.datatype_of(v.col), T.str_of(v.col), _number(v)
    plain = kind.isin(T.XSD + "string", T.RDF + "langString")
    return F.when(kind == T.XSD + "boolean", text.isin("true", "1")).when(plain, text != "").when(number.isNotNull(), (number != 0) & ~F.isnan(number))


def _text(v: _Value) -> Column:
    """The text of a literal or IRI, as STR gives it."""
    t = _term(v)
    return F.when(~T.is_blank(t), T.str_of(t))


def _before(a: _Value, b: _Value, strict: bool) -> Column:
    """a < b or a <= b; NULL if they can't be compared."""
    if a.numeric or b.numeric:
        n, m = _number(a), _number(b)
        return F.when(F.isnan(n) | F.isnan(m), F.when(n.isNotNull() & m.isNotNull(), F.lit(False))).otherwise(n < m if strict else n <= m)
    return (T.less_than if strict else T.less_or_equal)(_term(a), _term(b))


def _string(c: Column) -> _Value:
    return _Value("term", T.literal_col(c, T.XSD + "string"))


def _equal(a: _Value, b: _Value) -> Column:
    """Equal values; NULL for literals that can't be compared."""
    if a.numeric or b.numeric:  # computed: compared as numbers, without the detour of a term's text
        n, m = _number(a), _number(b)
        other = b if a.numeric else a
        text = T.datatype_of(other.col).isin(T.XSD + "string", T.RDF + "langString") if other.kind == "term" else F.lit(False)
        unlike = F.when(~T.is_literal(other.col) | text, F.lit(False)) if other.kind == "term" else F.lit(None).cast("boolean")
        return F.when(n.isNotNull() & m.isNotNull(), (n == m) & ~F.isnan(n)).when((n if a.numeric else m).isNotNull(), unlike)
    x, y = _term(a), _term(b)
    both = T.is_literal(x) & T.is_literal(y)
    order = T.less_or_equal(x, y)
    text = lambda t: T.datatype_of(t).isin(T.XSD + "string", T.RDF + "langString")
    known = F.when(order.isNotNull(), order & T.less_or_equal(y, x)).when(text(x) | text(y), F.lit(False))
    nan = F.coalesce(F.isnan(_number(a)), F.lit(False))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(x == y, ~nan).when(both, known).otherwise(F.lit(False))


_CASTS = {T.XSD + n: n for n in ("integer", "decimal", "double", "float", "string", "boolean", "dateTime", "date")}


class _Evaluator:
    def __init__(self, graph: TripleGraph):
        self.graph, self.spark, self.made, self.flags = graph, graph.spark, {}, 0

    # --- queries ---
    def query(self, q: Query) -> tuple[_Rows, list[str]]:
        rows = self.group(q.where)
        if q.values:
            rows = self.join(rows, self.values(*q.values))
        items = q.items or [(("var", n), n) for n in rows.columns if not n.startswith(" ")]
        if q.groups or any(_has_aggregate(e) for e, _ in [*items, *[(e, None) for e in q.having]]):
            rows, items, order = self.aggregated(rows, q, items)
        else:
            order = q.order
        for e in q.having if not q.groups and not any(_has_aggregate(e) for e, _ in q.items) else []:
            rows = self.filtered(rows, e)
        names = [n for _, n in items]
        kept: dict[str, Column] = {}
        for e, n in items:  # a later one may use an earlier one
            if e != ("var", n):
                rows = self.bound(rows, e, n)
            kept[n] = rows.column(n)
        df = rows.df
        if order:
            df = df.orderBy(*[c.asc() if up else c.desc() for e, up in order for c in self.sort_keys(rows, e)])
        df = df.select(*[kept[n].alias(self.name(n)) for n in names])
        if q.distinct:
            df = df.distinct()
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:  # the query's own limit
            df = df.limit(q.limit)
        return _Rows(df, {n: self.name(n) for n in names}, rows.sure & set(names)), names

    def sort_keys(self, rows: _Rows, e: tuple) -> list[Column]:
        v = self.value(e, rows)
        return [_number(v), _term(v)]

    def aggregated(self, rows: _Rows, q: Query, items: list) -> tuple[_Rows, list, list]:
        keys = []
        for i, (e, name) in enumerate(q.groups):
            if e[0] == "var" and name is None:
                keys.append(e[1])
                continue
            keys.append(name or f" g{i}")
            rows = self.bound(rows, e, keys[-1])
        found: list[tuple] = []
        parts = [*[e for e, _ in items], *q.having, *[e for e, _ in q.order]]
        for e in parts:
            _collect_aggregates(e, found)
        made = {repr(a): f" a{i}" for i, a in enumerate(found)}
        kinds, columns = {}, []
        for a in found:
            v = self.aggregate(a, rows)
            kinds[made[repr(a)]] = v.kind
            columns.append(v.col.alias(self.name(made[repr(a)])))
        by = [rows.column(k).alias(self.name(k)) for k in keys]
        df = rows.df.groupBy(*by).agg(*columns) if columns else rows.df.select(*by).distinct()
        df = df.withColumns({self.name(n): _term(_Value(k, F.col(self.name(n)))) for n, k in kinds.items()})
        out = _Rows(df, {n: self.name(n) for n in [*keys, *kinds]}, rows.sure & set(keys))
        swap = lambda e: _swapped(e, made, {repr(g): n for (g, _), n in zip(q.groups, keys)})
        for e in q.having:
            out = self.filtered(out, swap(e))
        return out, [(swap(e), n) for e, n in items], [(swap(e), up) for e, up in q.order]

    def aggregate(self, a: tuple, rows: _Rows) -> _Value:
        _, name, distinct, e, between = a
        if e is None:
            every = [F.coalesce(rows.column(n), F.lit("")) for n in rows.columns if not n.startswith(" ")] or [F.lit(1)]
            return _Value("integer", F.count_distinct(F.struct(*every)) if distinct else F.count("*"))
        v = self.value(e, rows)
        t = _term(v)
        if name == "COUNT":
            return _Value("integer", F.count_distinct(t) if distinct else F.count(t))
        if name == "SAMPLE":
            return _Value("term", F.min(t))
        if name == "GROUP_CONCAT":
            texts = F.array_sort(F.collect_set(_text(v)) if distinct else F.collect_list(_text(v)))
            return _string(F.array_join(texts, between))
        number = _number(v)
        if name in ("MIN", "MAX"):
            pick = F.min_by if name == "MIN" else F.max_by
            return _Value("term", pick(t, F.struct(number, t)))
        whole = F.count(number) == F.count(F.when(T.datatype_of(t) == T.XSD + "integer", 1))
        if name == "SUM":
            long = F.when(T.datatype_of(t) == T.XSD + "integer", T.str_of(t).try_cast("long"))
            total, exact = (F.sum_distinct(number), F.sum_distinct(long)) if distinct else (F.sum(number), F.sum(long))
            total, exact = F.coalesce(total, F.lit(0.0)), F.coalesce(exact, F.lit(0))
        else:
            total = F.coalesce(F.sum_distinct(number) / F.count_distinct(number) if distinct else F.avg(number), F.lit(0.0))
            exact, whole = F.lit(0), F.count(number) == 0
        sound = F.count(t) == F.count(number)  # a value that is no number makes an error
        return _Value("term", F.when(sound, F.when(whole, T.literal_col(exact, T.XSD + "integer")).otherwise(T.literal_col(total, T.XSD + "double"))))

    # --- patterns ---
    def name(self, var: str) -> str:
        return self.made.setdefault(var, f"v{len(self.made)}")

    def unit(self) -> _Rows:
        return _Rows(self.spark.range(1).select(), {}, frozenset())

    def values(self, names: list[str], rows: list[tuple]) -> _Rows:
        schema = ", ".join(f"{self.name(n)} string" for n in names)
        sure = frozenset(n for i, n in enumerate(names) if all(r[i] is not None for r in rows))
        return _Rows(self.spark.createDataFrame(rows, schema), {n: self.name(n) for n in names}, sure)

    def group(self, patterns: list, seed: _Rows | None = None) -> _Rows:
        rows, filters = seed, [p[1] for p in patterns if p[0] == "filter"]
        todo = [p for p in patterns if p[0] != "filter"]
        while todo:
            block = []
            while todo and todo[0][0] == "triple":
                block.append(todo.pop(0))
            rows = self.triples(block, rows) if block else self.pattern(todo.pop(0), rows)
        rows = rows if rows is not None else self.unit()
        for e in filters:
            rows = self.filtered(rows, e)
        return rows

    def pattern(self, p: tuple, rows: _Rows | None) -> _Rows:
        match p[0]:
            case "values":
                return self.join(rows, self.values(p[1], p[2]))
            case "select":
                return self.join(rows, self.query(p[1])[0])
            case "union":
                parts = [self.group(g) for g in p[1]]
                return self.join(rows, self.union(parts) if len(parts) > 1 else parts[0])
            case "bind":
                return self.bound(rows if rows is not None else self.unit(), p[1], p[2])
            case "optional":
                return self.optional(rows if rows is not None else self.unit(), p[1])
        return self.minus(rows, self.group(p[1])) if rows is not None else self.unit()

    def union(self, parts: list[_Rows]) -> _Rows:
        names = list(dict.fromkeys(n for r in parts for n in r.columns))
        frames = [r.df.select(*[r.column(n).alias(self.name(n)) for n in names]) for r in parts]
        return _Rows(reduce(DataFrame.unionByName, frames), {n: self.name(n) for n in names}, frozenset.intersection(*[r.sure for r in parts]))

    def triples(self, block: list, rows: _Rows | None) -> _Rows:
        """The patterns joined one by one, next always one that shares a variable if there is one."""
        todo = list(block)
        while todo:
            known = set(rows.columns) if rows is not None else set()
            p = next((p for p in todo if known & _vars_of(p)), todo[0])
            todo.remove(p)
            rows = self.join(rows, self.triple(p, {q[3][1] for q in todo if q[3][0] == "var"}))
        return rows

    def triple(self, p: tuple, _later: set) -> _Rows:
        _, s, path, o = p
        if path[0] == "var":
            edges = self.graph.all().select("s", F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), "o")
        else:
            edges = self.between(s, path, o)
        wanted, names = [], {}
        for end, at in ((s, "s"), (path, "p"), (o, "o")):
            if at == "p" and path[0] != "var":
                continue
            if end[0] == "term":
                edges = edges.where(F.col(at) == end[1].key)
            elif end[1] in names:
                edges = edges.where(F.col(at) == F.col(names[end[1]]))
            else:
                names[end[1]] = at
        wanted = [F.col(at).alias(self.name(n)) for n, at in names.items()]
        if not wanted:  # a test of a fact
            edges, wanted = edges.limit(1), []
        return _Rows(edges.select(*wanted), {n: self.name(n) for n in names}, frozenset(names))

    # --- paths ---
    def between(self, s: tuple, path: tuple, o: tuple) -> DataFrame:
        """(s, o) of a path; a closure starts from a constant end."""
        if path == ("seq", [("iri", TYPE), ("*", ("iri", SUBCLASS))]) and o[0] == "term" and o[1].kind == "iri":
            return self.graph.instances([o[1].iri]).select("s", F.lit(o[1].key).alias("o"))
        if path[0] in ("*", "+", "?", "seq", "inv", "alt") and _closes(path):
            if s[0] == "term":
                return self.extend(self.pairs_of([s[1].key]), path)
            if o[0] == "term":
                back = self.extend(self.pairs_of([o[1].key]), _inverse(path))
                return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
        return self.edges(path)

    def pairs_of(self, keys: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(k, k) for k in keys], "s string, o string")

    def nodes(self) -> DataFrame:
        every = self.graph.all()
        return every.select("s").unionByName(every.select(F.col("o").alias("s"))).distinct().select("s", F.col("s").alias("o"))

    def edges(self, path: tuple) -> DataFrame:
        match path[0]:
            case "iri":
                return self.graph.pred(path[1])
            case "inv":
                return self.edges(path[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
            case "alt":
                return reduce(DataFrame.unionByName, [self.edges(p) for p in path[1]])
            case "seq":
                return reduce(self.extend, path[1][1:], self.edges(path[1][0]))
            case "not":
                return self.negated(path[1])
            case "+":
                return self.extend(self.edges(path[1]).distinct(), ("*", path[1]))
        return self.extend(self.nodes(), path)

    def negated(self, steps: list[tuple[str, bool]]) -> DataFrame:
        every, parts = self.graph.all(), []
        for back in (False, True):
            named = [p for p, b in steps if b == back]
            if named or (not back and not steps):
                own = every.where(~F.col("p").isin(named))
                parts.append(own.select(F.col("o").alias("s"), F.col("s").alias("o")) if back else own.select("s", "o"))
        return reduce(DataFrame.unionByName, parts)

    def extend(self, pairs: DataFrame, path: tuple) -> DataFrame:
        """(s, o) where pairs have (s, m) and the path leads from m to o."""
        match path[0]:
            case "seq":
                return reduce(self.extend, path[1], pairs)
            case "alt":
                return reduce(DataFrame.unionByName, [self.extend(pairs, p) for p in path[1]])
            case "?":
                return pairs.unionByName(self.extend(pairs, path[1])).distinct()
            case "+":
                return self.extend(self.extend(pairs, path[1]), ("*", path[1]))
            case "*":
                seen = new = cut(pairs.distinct())
                rounds = 0
                while not new.isEmpty():
                    new = cut(self.extend(new, path[1]).distinct().join(seen, ["s", "o"], "left_anti"))
                    seen, rounds = seen.unionByName(new), rounds + 1
                    if rounds % 16 == 0:
                        seen = cut(seen)
                return seen
        step = self.edges(path).select(F.col("s").alias("o"), F.col("o").alias("_next"))
        return pairs.join(step, "o").select("s", F.col("_next").alias("o"))

    # --- joins ---
    def join(self, a: _Rows | None, b: _Rows) -> _Rows:
        return b if a is None else self.joined(a, b, "inner", [])

    def joined(self, a: _Rows, b: _Rows, how: str, filters: list) -> _Rows:
        """Compatible solutions of both: a shared variable is equal, or has no value on one side."""
        shared = [n for n in b.columns if n in a.columns]
        right = b.df.select(*[F.col(c).alias(f"_r{c}") for c in b.columns.values()])
        mine, other = (lambda n: F.col(a.columns[n])), (lambda n: F.col("_r" + b.columns[n]))
        both: list[Column] = []
        for n in shared:
            same = mine(n) == other(n)
            both.append(same if n in a.sure and n in b.sure else same | mine(n).isNull() | other(n).isNull())
        merged = {n: c for n, c in a.columns.items()} | {n: "_r" + c for n, c in b.columns.items() if n not in a.columns}
        for e in filters:  # of an OPTIONAL that looks outside
            both.append(F.coalesce(_truth(self.value(e, _Rows(a.df, merged, a.sure))), F.lit(False)))
        on = reduce(Column.__and__, both) if both else None
        df = a.df.join(right, on, how) if on is not None else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        names = list(dict.fromkeys([*a.columns, *b.columns]))

        def merge(n: str) -> Column:
            if n not in b.columns:
                return mine(n)
            if n not in a.columns:
                return other(n)
            return mine(n) if n in a.sure else F.coalesce(mine(n), other(n))

        sure = a.sure | b.sure if how == "inner" else a.sure
        return _Rows(df.select(*[merge(n).alias(self.name(n)) for n in names]), {n: self.name(n) for n in names}, sure)

    def optional(self, rows: _Rows, patterns: list) -> _Rows:
        rest, outer = [], []
        inside = set().union(*[_vars_of(p) for p in patterns if p[0] != "filter"], set())
        for p in patterns:
            (outer if p[0] == "filter" and _vars_of(p) - inside and not _has_exists(p[1]) else rest).append(p)
        return self.joined(rows, self.group(rest), "left", [p[1] for p in outer])

    def minus(self, a: _Rows, b: _Rows) -> _Rows:
        shared = [n for n in b.columns if n in a.columns]
        if not shared:
            return a
        right = b.df.select(*[F.col(b.columns[n]).alias("_r" + b.columns[n]) for n in shared]).distinct()
        pairs = [(F.col(a.columns[n]), F.col("_r" + b.columns[n]), n in a.sure and n in b.sure) for n in shared]
        on = reduce(Column.__and__, [x == y if sure else (x == y) | x.isNull() | y.isNull() for x, y, sure in pairs])
        if not any(sure for _, _, sure in pairs):
            on = on & reduce(Column.__or__, [F.coalesce(x == y, F.lit(False)) for x, y, _ in pairs])
        return replace(a, df=a.df.join(right, on, "left_anti"))

    def bound(self, rows: _Rows, e: tuple, name: str) -> _Rows:
        rows, e = self.with_exists(rows, e)
        df = rows.df.withColumn(self.name(name), _term(self.value(e, rows)))
        return _Rows(df, rows.columns | {name: self.name(name)}, rows.sure - {name})

    def filtered(self, rows: _Rows, e: tuple) -> _Rows:
        if e[0] == "call" and e[1] == "&&":
            return reduce(self.filtered, e[2], rows)
        negated = e[0] == "call" and e[1] == "!" and e[2][0][0] == "exists"
        if e[0] == "exists" or negated:
            return self.existing(rows, e[2][0][1] if negated else e[1], "left_anti" if negated else "left_semi")
        rows, e = self.with_exists(rows, e)
        sure = rows.sure | _bound_by(e) & set(rows.columns)
        return replace(rows, df=rows.df.where(_truth(self.value(e, rows))), sure=sure)

    def inner(self, rows: _Rows, patterns: list) -> tuple[_Rows, list[str]]:
        """A group of EXISTS, and the variables that it shares. If a filter in it looks outside, it starts from rows."""
        inside = set().union(*[_vars_of(p) for p in patterns if p[0] not in ("filter", "bind")], set())
        outside = set().union(*[_vars_of(p) for p in patterns], set()) - inside
        if outside & set(rows.columns):
            names = sorted((inside | outside) & set(rows.columns))
            seed = _Rows(rows.df.select(*[rows.column(n).alias(self.name(n)) for n in names]).distinct(), {n: self.name(n) for n in names}, rows.sure & set(names))
            return self.group(patterns, seed), names
        found = self.group(patterns)
        return found, [n for n in found.columns if n in rows.columns]

    def existing(self, rows: _Rows, patterns: list, how: str) -> _Rows:
        found, shared = self.inner(rows, patterns)
        right = found.df.select(*[F.col(found.columns[n]).alias("_r" + found.columns[n]) for n in shared]).distinct()
        if not shared:  # one row at most
            return replace(rows, df=rows.df.join(F.broadcast(found.df.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), how))
        pairs = [(F.col(rows.columns[n]), F.col("_r" + found.columns[n]), n in rows.sure and n in found.sure) for n in shared]
        on = reduce(Column.__and__, [x == y if sure else (x == y) | x.isNull() | y.isNull() for x, y, sure in pairs])
        return replace(rows, df=rows.df.join(right, on, how))

    def with_exists(self, rows: _Rows, e: tuple) -> tuple[_Rows, tuple]:
        """EXISTS within an expression becomes a flag beside the rows that it holds for."""
        if e[0] == "exists":
            found, shared = self.inner(rows, e[1])
            if not shared or not set(shared) <= rows.sure & found.sure:
                raise ShapeSyntaxError("EXISTS within an expression needs shared variables that always have a value")
            self.flags += 1
            flag = f" e{self.flags}"
            columns = [self.name(n) for n in shared]
            right = found.df.select(*[F.col(found.columns[n]).alias(c) for n, c in zip(shared, columns)]).distinct().withColumn(self.name(flag), F.lit(T.literal(True).key))
            df = rows.df.join(right, columns, "left")
            return _Rows(df, rows.columns | {flag: self.name(flag)}, rows.sure), ("call", "BOUND", [("var", flag)])
        if e[0] == "call":
            parts = []
            for x in e[2]:
                rows, x = self.with_exists(rows, x)
                parts.append(x)
            return rows, ("call", e[1], parts)
        return rows, e

    # --- expressions ---
    def value(self, e: tuple, rows: _Rows) -> _Value:
        match e[0]:
            case "var":
                return _Value("term", rows.column(e[1]))
            case "term":
                return _Value("term", T.constant(e[1]))
            case "call":
                return self.call(e[1], e[2], rows)
        raise ShapeSyntaxError(f"{e[0]} can't stand here")

    def call(self, name: str, args: list, rows: _Rows) -> _Value:
        if name == "BOUND":
            return _Value("boolean", rows.column(args[0][1]).isNotNull())
        v = [self.value(a, rows) for a in args]
        flag = lambda c: _Value("boolean", c)
        constant = lambda i: args[i][1].lex if i < len(args) and args[i][0] == "term" else None
        match name:
            case "||" | "&&":
                return flag(_truth(v[0]) | _truth(v[1]) if name == "||" else _truth(v[0]) & _truth(v[1]))
            case "!":
                return flag(~_truth(v[0]))
            case "=" | "!=":
                same = _equal(*v)
                return flag(same if name == "=" else ~same)
            case "<" | "<=" | ">" | ">=":
                a, b = v if name[0] == "<" else v[::-1]
                return flag(_before(a, b, len(name) == 1))
            case "IN":
                return flag(reduce(Column.__or__, [_equal(v[0], x) for x in v[1:]], F.lit(False)))
            case "+" | "-" | "*" | "/":
                return self.arithmetic(name, *v)
            case "SAMETERM":
                return flag(_term(v[0]) == _term(v[1]))
            case "COALESCE":
                return _Value("term", F.coalesce(*map(_term, v)))
            case "IF":
                test = _truth(v[0])
                return _Value("term", F.when(test, _term(v[1])).when(~test, _term(v[2])))
            case "ISIRI" | "ISURI":
                return flag(T.is_iri(_term(v[0])))
            case "ISBLANK":
                return flag(T.is_blank(_term(v[0])))
            case "ISLITERAL":
                return flag(T.is_literal(_term(v[0])))
            case "ISNUMERIC":
                return flag(F.when(_term(v[0]).isNotNull(), _numeric(_term(v[0]))))
            case "STR":
                return _string(_text(v[0]))
            case "DATATYPE":
                return _Value("term", F.concat(F.lit("<"), T.datatype_of(_term(v[0])), F.lit(">")))
            case "LANG":
                t = _term(v[0])
                return _string(F.when(T.is_literal(t), F.coalesce(T.lang_of(t), F.lit(""))))
            case "LANGMATCHES":
                tag, wanted = F.lower(_text(v[0])), F.lower(_text(v[1]))
                return flag(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))
            case "IRI" | "URI":
                return _Value("term", F.concat(F.lit("<"), _text(v[0]), F.lit(">")))
            case "STRDT":
                return _Value("term", F.concat(F.lit('"'), _text(v[0]), F.lit('"^^'), _term(v[1])))
            case "STRLANG":
                return _Value("term", T.lang_col(_text(v[0]), _text(v[1])))
            case "STRLEN":
                return _Value("integer", F.length(_text(v[0])).cast("long"))
            case "UCASE" | "LCASE":
                return _string((F.upper if name == "UCASE" else F.lower)(_text(v[0])))
            case "CONCAT":
                return _string(F.concat(*map(_text, v)))
            case "CONTAINS" | "STRSTARTS" | "STRENDS":
                test = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name]
                return flag(test(_text(v[0]), _text(v[1])))
            case "SUBSTR":
                start = _number(v[1]).cast("int")
                return _string(F.substr(_text(v[0]), start, *[_number(x).cast("int") for x in v[2:]]))
            case "STRBEFORE" | "STRAFTER":
                text, mark = _text(v[0]), _text(v[1])
                at = F.instr(text, mark) if isinstance(mark, str) else F.locate(constant(1) or "", text)
                cutoff = F.substr(text, F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(text, at + F.length(mark))
                return _string(F.when(at > 0, cutoff).otherwise(F.lit("")))
            case "REGEX" | "REPLACE":
                n = 2 if name == "REGEX" else 3
                if constant(1) is None or (len(args) > n and constant(n) is None):
                    raise ShapeSyntaxError(f"{name} needs a constant pattern")
                pattern = T.regex(constant(1), constant(n) or "")
                return flag(_text(v[0]).rlike(pattern)) if name == "REGEX" else _string(F.regexp_replace(_text(v[0]), F.lit(pattern), _text(v[2])))
            case "ABS" | "CEIL" | "FLOOR" | "ROUND":
                f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}[name]
                whole = v[0].kind == "integer" or name != "ABS"
                return _Value("integer" if whole else "double", f(_number(v[0])).cast("long" if whole else "double"))
        if name in _CASTS:
            return self.cast(_CASTS[name], v[0])
        raise ShapeSyntaxError(f"unknown function {name}")

    def arithmetic(self, sign: str, a: _Value, b: _Value) -> _Value:
        apply = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}
        if sign != "/" and a.kind == b.kind == "integer":
            return _Value("integer", apply[sign](a.col, b.col))
        x, y = _number(a), _number(b)
        result = apply[sign](x, y) if sign != "/" else F.try_divide(x, y)
        if sign == "/":
            return _Value("double", result)
        whole = [F.lit(v.kind == "integer") if v.kind in ("integer", "double") else v.whole if v.kind == "number" else T.datatype_of(_term(v)) == T.XSD + "integer" for v in (a, b)]
        return _Value("number", result, whole[0] & whole[1])

    def cast(self, kind: str, v: _Value) -> _Value:
        text = _text(v)
        if kind == "string":
            return _string(text)
        if kind == "integer":
            return _Value("integer", F.coalesce(text.try_cast("long"), F.when(_numeric(_term(v)), text.try_cast("double").try_cast("long"))))
        if kind == "double":
            return _Value("double", text.try_cast("double"))
        if kind == "boolean":
            return _Value("boolean", F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False)))
        sound = text.try_cast({"decimal": "decimal(38,18)", "float": "double", "dateTime": "timestamp", "date": "date"}[kind])
        return _Value("term", F.when(sound.isNotNull(), T.literal_col(text, T.XSD + kind)))


# --- looking at queries --------------------------------------------------------------------------


def _vars_of(e: object) -> set[str]:
    """All variables that a pattern or expression names."""
    if isinstance(e, Query):
        return {n for _, n in e.items} or _vars_of(e.where)
    if isinstance(e, tuple) and e and e[0] == "var":
        return {e[1]}
    if isinstance(e, tuple) and e and e[0] == "bind":
        return _vars_of(e[1]) | {e[2]}
    if isinstance(e, tuple) and e and e[0] == "values":
        return set(e[1])
    return set().union(*map(_vars_of, e)) if isinstance(e, (tuple, list)) else set()


def _bound_by(e: tuple) -> set[str]:
    """Variables that must have a value for a test to be true."""
    if e[0] == "call" and e[1] in ("=", "!=", "<", ">", "<=", ">=", "BOUND", "SAMETERM"):
        return {a[1] for a in e[2] if a[0] == "var"}
    return set()


def _has_exists(e: object) -> bool:
    return isinstance(e, (tuple, list)) and (bool(e) and e[0] == "exists" or any(map(_has_exists, e)))


def _collect_aggregates(e: object, found: list) -> None:
    if isinstance(e, tuple) and e and e[0] == "aggregate":
        if e not in found:
            found.append(e)
    elif isinstance(e, tuple) and e and e[0] == "call":
        for x in e[2]:
            _collect_aggregates(x, found)


def _has_aggregate(e: tuple) -> bool:
    found: list = []
    _collect_aggregates(e, found)
    return bool(found)


def _swapped(e: tuple, aggregates: dict[str, str], groups: dict[str, str]) -> tuple:
    """The expression over the columns of the aggregation."""
    if name := aggregates.get(repr(e)) or groups.get(repr(e)):
        return ("var", name)
    return ("call", e[1], [_swapped(x, aggregates, groups) for x in e[2]]) if e[0] == "call" else e


def _closes(path: object) -> bool:
    return isinstance(path, (tuple, list)) and (bool(path) and path[0] in ("*", "+", "?") or any(map(_closes, path)))


def _inverse(path: tuple) -> tuple:
    match path[0]:
        case "inv":
            return path[1]
        case "seq":
            return ("seq", [_inverse(p) for p in reversed(path[1])])
        case "alt":
            return ("alt", [_inverse(p) for p in path[1]])
        case "*" | "+" | "?":
            return (path[0], _inverse(path[1]))
    return ("inv", path)
