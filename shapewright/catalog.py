"""Queries over the relational tables, one or more for each operator, with independent SQL of their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import PREFIXES
from .plans import ast as A
from .plans.ast import Component, Shape
from .plans.compiler import validate, validate_shape
from .plans.templates import REGISTRY, ComponentTemplate, ScopeTemplate
from .sources.compact import parse_compact
from .sources.graph import TripleGraph
from .sources.relational import EX
from .sources.shapes_graph import shapes_from_turtle, shapes_to_turtle, templates_from_turtle
from .sources.sparql import run_sparql

PREFIX = {"": EX}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def number(column: str, kind: str) -> str:
    """SQL for the key in an IRI of this kind."""
    start = len(f"<{EX}{kind}/")
    return f"cast(substr({column}, {start + 1}, length({column}) - {start + 1}) as bigint)"


def part_of(column: str, kind: str, n: int) -> str:
    """SQL for the n-th number of a compound key."""
    start = len(f"<{EX}{kind}/")
    return f"cast(split_part(substr({column}, {start + 1}, length({column}) - {start + 1}), '-', {n}) as bigint)"


def lexical(column: str) -> str:
    """SQL for a literal's lexical form."""
    return f"substr({column}, 2, length({column}) - length(substring_index({column}, '\"', -1)) - 2)"


def local(column: str) -> str:
    """SQL for what follows the namespace of an IRI, or a literal's lexical form."""
    return f"if({column} like '<%', substr({column}, {len(EX) + 2}, length({column}) - {len(EX) + 2}), {lexical(column)})"


def _register(name: str, sql: str, query: Query) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def compact(name: str, program: str, columns: dict[str, str], sql: str, distinct: bool = True) -> None:
    """A query that validates a compact program and selects columns of its results."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        graph = TripleGraph.from_parquet(spark, folder)
        found = validate(graph, parse_compact(program, PREFIX), detail=False).selectExpr(*[f"{c} as {n}" for n, c in columns.items()])
        return found.distinct() if distinct else found

    _register(name, sql, run)


def built(name: str, shape: Callable[[], Shape], columns: dict[str, str], sql: str, distinct: bool = True, only: tuple[str, ...] = ()) -> None:
    """A query that validates a built shape, on the whole graph or on some of its predicates."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        graph = TripleGraph.from_parquet(spark, folder)
        if only:
            graph = graph.restricted(only)
        found = validate_shape(graph, shape(), detail=False).selectExpr(*[f"{c} as {n}" for n, c in columns.items()])
        return found.distinct() if distinct else found

    _register(name, sql, run)


def key(name: str, kind: str) -> dict[str, str]:
    return {name: number("this", kind)}


LINE = {"l_orderkey": part_of("this", "line", 1), "l_linenumber": part_of("this", "line", 2)}
FALSE = Component("in", ())
NATIONS = """with a as (select distinct o_orderkey k, c_nationkey n from orders join customer on o_custkey = c_custkey),
 b as (select distinct l_orderkey k, s_nationkey n from lineitem join supplier on l_suppkey = s_suppkey)"""


def p(*steps: str) -> A.Path:
    return A.path(*[f"^{EX}{s[1:]}" if s[0] == "^" else EX + s for s in steps])


# --- node tests ----------------------------------------------------------------------------------
compact("c_in", '∈ :Order ⊩ :o_orderstatus ∝ ∈ {"O" "F"}', key("o_orderkey", "order"), "select o_orderkey from orders where o_orderstatus not in ('O', 'F')")
compact("c_class", "∈ :Party ⊩ ∈ :Customer", key("s_suppkey", "supplier"), "select s_suppkey from supplier")
compact("c_class_in", "∈ :Part ⊩ ∈ :Part_PROMO ∪ :Part_SMALL", key("p_partkey", "part"), "select p_partkey from part where p_type not in ('PROMO', 'SMALL')")
compact("c_datatype", ":n_chars² ∪ :source² ⊩ ^^xs:integer", {"source": f"substr(this, {len(EX) + 9}, length(this) - {len(EX) + 9})"}, "select distinct source from documents")
compact("c_datatype_in", ":event_type² ∪ :user² ⊩ ^^xs:string ∪ xs:integer", key("user_id", "user"), "select distinct user_id from events")
compact("c_direct_type", "∈ :Party ⊩ ⋹ :Supplier", key("c_custkey", "customer"), "select c_custkey from customer")
compact("c_min_length", "∈ :Customer ⊩ :c_mktsegment ∝ ℓ≥9", key("c_custkey", "customer"), "select c_custkey from customer where length(c_mktsegment) < 9")
compact("c_max_length", "∈ :Part ⊩ :p_brand ∝ ℓ≤7", key("p_partkey", "part"), "select p_partkey from part where length(p_brand) > 7")
compact("c_min_inclusive", "∈ :Customer ⊩ :c_acctbal ∝ ≥ 0", key("c_custkey", "customer"), "select c_custkey from customer where not c_acctbal >= 0")
compact("c_min_exclusive", "∈ :Part ⊩ :p_size ∝ > 10", key("p_partkey", "part"), "select p_partkey from part where not p_size > 10")
compact("c_max_inclusive", "∈ :Part ⊩ :p_size ∝ ≤ 40", key("p_partkey", "part"), "select p_partkey from part where not p_size <= 40")
compact("c_max_exclusive", "∈ :Part ⊩ :p_size ∝ < 50", key("p_partkey", "part"), "select p_partkey from part where not p_size < 50")
compact("c_node_kind", ":props² ∪ :user² ⊩ IRI", {"event_id": "cast(substr(this, 4) as bigint)"}, "select event_id from events")
compact("c_pattern", '∈ :Customer ⊩ :c_name ∝ "^customer#0000000" ★ "i"', key("c_custkey", "customer"), "select c_custkey from customer where not regexp_matches(c_name, '^customer#0000000', 'i')")
compact("c_closed", "∈ :Document ⊩ ⟦ rdf:type :text :source :n_chars ⟧", key("doc_id", "document"), "select distinct doc_id from documents join labels using (doc_id)")
compact("c_closed_inv", "∈ :Order ⊩ ⟦ rdf:type :o_custkey :o_orderstatus :o_orderpriority :o_totalprice :o_orderdate :lines :part⁻¹ ⟧", key("o_orderkey", "order"), "select distinct o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem)")
# --- path pairs ----------------------------------------------------------------------------------
compact("c_equals", "∈ :Order ⊩ :o_custkey :c_nationkey = :l_orderkey⁻¹ :l_suppkey :s_nationkey", {"k": number("this", "order"), "n": number("object", "nation")}, NATIONS + " (select * from a except select * from b) union all (select * from b except select * from a)")
compact("c_disjoint", "∈ :Order ⊩ :o_custkey :c_nationkey ∅ :l_orderkey⁻¹ :l_suppkey :s_nationkey", {"k": number("this", "order"), "n": number("object", "nation")}, NATIONS + " select * from a intersect select * from b")
compact("c_less_than", "∈ :Line ⊩ :l_orderkey :o_orderdate < :l_shipdate", LINE, "select distinct l_orderkey, l_linenumber::bigint l_linenumber from lineitem join orders on l_orderkey = o_orderkey where not o_orderdate < l_shipdate")
compact("c_less_than_or_equals", "∈ :Line ⊩ :l_orderkey :o_orderdate ≤ :l_shipdate", LINE, "select distinct l_orderkey, l_linenumber::bigint l_linenumber from lineitem join orders on l_orderkey = o_orderkey where not o_orderdate <= l_shipdate")
# --- sets ----------------------------------------------------------------------------------------
compact("c_has_value", '∈ :Customer ⊩ :o_custkey⁻¹ :o_orderstatus ∝ ∋ "F"', key("c_custkey", "customer"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
compact("c_min_count", "∈ :Customer ⊩ :o_custkey⁻¹ ∝ |≥8|", key("c_custkey", "customer"), "select c_custkey from customer left join orders on o_custkey = c_custkey group by 1 having count(distinct o_orderkey) < 8")
compact("c_min_count_empty", "∈ :Order ⊩ :l_orderkey⁻¹ ∝ |≥1|", key("o_orderkey", "order"), "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
compact("c_max_count", "∈ :Line ⊩ :l_partkey ∝ |≤1|", LINE, "select l_orderkey, l_linenumber::bigint l_linenumber from lineitem group by 1, 2 having count(distinct l_partkey) > 1")
compact("c_min_count_top", "∈ :Customer ⊩ |≥1000000|", {"component": "component"}, "select 'minCount' as component from (select count(distinct c_custkey) n from customer) where n < 1000000")
compact("c_max_count_top", "∈ :Customer ⊩ |≤10|", {"component": "component"}, "select 'maxCount' as component from (select count(distinct c_custkey) n from customer) where n > 10")

def _unique_lang(spark: SparkSession, folder: str) -> DataFrame:
    """The child's own rows say which language repeats: one for each parent and language."""
    inner = A.shape(A.unique_lang(True)).named("lang")
    outer = A.shape(A.prop_values(p("^n_chars", "text"), inner)).scoped(A.scope_objects(EX + "n_chars"))
    found = validate_shape(TripleGraph.from_parquet(spark, folder), outer).where("source_shape = 'lang'")
    return found.selectExpr(f"cast({lexical('parent')} as bigint) as n_chars", "object as lang")


_register("c_unique_lang", "select n_chars, lang from documents group by 1, 2 having count(distinct text) > 1", _unique_lang)
# --- combinators ---------------------------------------------------------------------------------
compact("c_prop_values", '∈ :Order ⊩ :o_custkey ∝ (:c_mktsegment ∝ ∈ {"BUILDING"})', key("o_orderkey", "order"), "select o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'BUILDING'")
compact("c_prop_values_nested", '∈ :Order ⊩ :o_custkey ∝ :c_nationkey ∝ :n_regionkey ∝ :r_name ∝ ∈ {"ASIA"}', key("o_orderkey", "order"), "select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'ASIA'")
compact("c_list_structure", ":lines² ⊩ ⦇ IRI ⦈", {"l_orderkey": part_of("object", "cell", 1), "l_linenumber": part_of("object", "cell", 2)}, "select l_orderkey, l_linenumber::bigint l_linenumber from lineitem group by 1, 2 having count(distinct l_partkey) > 1")


def _list_elements(spark: SparkSession, folder: str) -> DataFrame:
    inner = A.shape(A.list_of(A.shape(A.class_(EX + "Part_PROMO")))).named("promo")
    outer = A.shape(A.prop_values(p("lines"), inner)).scoped(A.scope_class(EX + "Order"))
    found = validate_shape(TripleGraph.from_parquet(spark, folder), outer).where("source_shape = 'promo' and component = 'list' and child_shape is not null")
    return found.selectExpr(f"{number('parent', 'order')} as l_orderkey", f"{number('object', 'part')} as l_partkey").distinct()


_register("c_list_elements", "select distinct l_orderkey, l_partkey from lineitem join part on l_partkey = p_partkey where p_type <> 'PROMO'", _list_elements)
compact("c_shape", "∈ :Order ⊩ :Priced . :Priced ≡ :o_totalprice ∝ ≤ 200000", key("o_orderkey", "order"), "select o_orderkey from orders where not o_totalprice <= 200000")
compact("c_not", "∈ :Customer ⊩ ¬ (:c_acctbal ∝ ≥ 0)", key("c_custkey", "customer"), "select c_custkey from customer where c_acctbal >= 0")
built("c_and", lambda: A.shape(A.and_(*(s for s in parse_compact(':a ≡ :c_acctbal ∝ ≥ 0 . :b ≡ :c_mktsegment ∝ ∋ "BUILDING"', PREFIX)))).scoped(A.scope_class(EX + "Customer")), key("c_custkey", "customer"), "select c_custkey from customer where c_acctbal < 0 or c_mktsegment <> 'BUILDING'")
compact("c_or", '∈ :Customer ⊩ (:c_acctbal ∝ ≥ 0 ∨ :c_mktsegment ∝ ∋ "BUILDING")', key("c_custkey", "customer"), "select c_custkey from customer where c_acctbal < 0 and c_mktsegment <> 'BUILDING'")


def _partition(spark: SparkSession, folder: str) -> DataFrame:
    text = '∈ :Part ⊩ ((:p_type ∝ ∋ "PROMO" → :p_size ∝ ≤ 25) ∖ (:p_brand ∝ ∋ "Brand#4" → :p_size ∝ ≥ 10) ∖)'
    shape = parse_compact(text, PREFIX)[0]
    first, second = shape.components[0].argument
    found = validate_shape(TripleGraph.from_parquet(spark, folder), shape, detail=False)
    reason = F.when(F.col("child_shape") == first.id, "case1").when(F.col("child_shape") == second.id, "case2").otherwise("rest")
    return found.select(F.expr(number("this", "part")).alias("p_partkey"), reason.alias("reason")).distinct()


_register(
    "c_partition",
    "select p_partkey, case when p_type = 'PROMO' then 'case1' when p_brand = 'Brand#4' then 'case2' else 'rest' end reason from part where (p_type = 'PROMO' and p_size > 25) or (p_type <> 'PROMO' and p_brand = 'Brand#4' and p_size < 10) or (p_type <> 'PROMO' and p_brand <> 'Brand#4')",
    _partition,
)
DOUBLE = "cast(substr({0}, 2, length({0}) - length(substring_index({0}, '\"', -1)) - 2) as double)"
built(
    "c_query",
    lambda: A.shape(A.query(f"select f.this from {{focus}} f join {{p_o_totalprice}} t on f.this = t.s join {{p_o_custkey}} c on f.this = c.s join {{p_c_acctbal}} b on c.o = b.s where {DOUBLE.format('t.o')} > 3 * {DOUBLE.format('b.o')}")).scoped(A.scope_class(EX + "Order")),
    key("o_orderkey", "order"),
    "select o_orderkey from orders join customer on o_custkey = c_custkey where o_totalprice > 3 * c_acctbal",
)
# --- scopes: a shape that nothing conforms to ------------------------------------------------------
built("s_node", lambda: A.shape(FALSE).scoped(*[A.scope_node(A.Term(f"<{EX}customer/{n}>")) for n in (1, 2)]), key("c_custkey", "customer"), "select c_custkey from customer where c_custkey in (1, 2)", distinct=False)
built("s_class", lambda: A.shape(FALSE).scoped(A.scope_class(EX + "Party")), {"node": f"regexp_replace({local('this')}, '^(.)[a-z]*/', '$1')"}, "select 'c' || c_custkey as node from customer union all select 's' || s_suppkey from supplier", distinct=False)
built("s_prop_object", lambda: A.shape(FALSE).scoped(A.scope_objects(EX + "l_orderkey")), key("l_orderkey", "order"), "select distinct l_orderkey from lineitem", distinct=False)
built("s_prop_subject", lambda: A.shape(FALSE).scoped(A.scope_subjects(EX + "quality")), key("doc_id", "document"), "select distinct doc_id from labels", distinct=False)
# each node of the whole graph once; objects have no SQL, as it would have to write numbers and times as Spark does: tests hold them against brute force
SUBJECTS = {"region": "region/' || r_regionkey", "nation": "nation/' || n_nationkey", "customer": "customer/' || c_custkey", "supplier": "supplier/' || s_suppkey", "part": "part/' || p_partkey", "orders": "order/' || o_orderkey", "events": "event/' || event_id", "documents": "document/' || doc_id", "labels": "document/' || doc_id", "conversations": "turn/' || conv_id || '-' || turn", "pages": "page/' || page_id", "benchmark": "item/' || item_id", "embeddings": "vec/' || vec_id"}
LINES = " union ".join(f"select '<{EX}{kind}/' || l_orderkey || '-' || l_linenumber || '>' from lineitem" for kind in ("line", "cell"))
built("s_all_objects", lambda: A.shape(FALSE).scoped(A.ALL_OBJECTS), {"v": "this"}, "", distinct=False)
built("s_all_subjects", lambda: A.shape(FALSE).scoped(A.ALL_SUBJECTS), {"v": "this"}, "select v from (" + " union ".join(f"select '<{EX}{name} || '>' v from {table}" for table, name in SUBJECTS.items()) + f" union {LINES} union select '_:p' || event_id from events where props is not null) where v is not null", distinct=False)
built("s_query", lambda: A.shape(FALSE).scoped(A.scope_query(f"select s as scope from {{p_c_nationkey}} where o = '<{EX}nation/3>'")), key("c_custkey", "customer"), "select c_custkey from customer where c_nationkey = 3", distinct=False)
built("s_union", lambda: A.shape(FALSE).scoped(A.scope_class(EX + "Supplier"), A.scope_subjects(EX + "s_nationkey")), key("s_suppkey", "supplier"), "select s_suppkey from supplier", distinct=False)
# --- filters, severity, several components ----------------------------------------------------------
compact("f_filter", '∈ :Customer ⊩ :c_mktsegment ∝ ∋ "BUILDING" → :c_acctbal ∝ ≥ 0', key("c_custkey", "customer"), "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0")
compact("f_filter_multi", f'∈ :Customer ⊩ :c_mktsegment ∝ ∋ "BUILDING" ∧ :c_nationkey ∝ ∋ <{EX}nation/3> → :c_acctbal ∝ ≥ 0', key("c_custkey", "customer"), "select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3 and c_acctbal < 0")
built("f_severity", lambda: parse_compact("∈ :Customer ⊩ :c_acctbal ∝ ≥ 0", PREFIX)[0].at("Warning"), key("c_custkey", "customer") | {"severity": "severity"}, "select c_custkey, 'Warning' severity from customer where c_acctbal < 0")


def _multi_component(spark: SparkSession, folder: str) -> DataFrame:
    inner = A.shape(*parse_compact(":x ≡ > 10 ∧ ≤ 40", PREFIX)[0].components).named("sizes")
    outer = A.shape(A.prop_values(p("p_size"), inner)).scoped(A.scope_class(EX + "Part"))
    found = validate_shape(TripleGraph.from_parquet(spark, folder), outer).where("source_shape = 'sizes'")
    return found.selectExpr(f"{number('parent', 'part')} as p_partkey", "component")


_register("f_multi_component", "select p_partkey, 'minExclusive' component from part where p_size <= 10 union all select p_partkey, 'maxInclusive' from part where p_size > 40", _multi_component)
# --- paths ---------------------------------------------------------------------------------------
compact("p_sequence", f"∈ :Order ⊩ :o_custkey :c_nationkey ∝ ∋ <{EX}nation/3>", key("o_orderkey", "order"), "select o_orderkey from orders join customer on o_custkey = c_custkey where c_nationkey <> 3")
compact("p_inverse", "∈ :Part ⊩ :l_partkey⁻¹ ∝ |≤30|", key("l_partkey", "part"), "select l_partkey from lineitem group by 1 having count(distinct (l_orderkey, l_linenumber)) > 30")
compact("p_mixed", "∈ :Supplier ⊩ :l_suppkey⁻¹ :l_orderkey :o_custkey ∝ |≤480|", key("l_suppkey", "supplier"), "select l_suppkey from lineitem join orders on l_orderkey = o_orderkey group by 1 having count(distinct o_custkey) > 480")
# --- legacy forms and templates -------------------------------------------------------------------
built(
    "x_qualified_count",
    lambda: A.shape(A.qualified(p("^o_custkey"), parse_compact(':f ≡ :o_orderstatus ∝ ∋ "F"', PREFIX)[0], least=3)).scoped(A.scope_class(EX + "Customer")),
    key("c_custkey", "customer"),
    "select c_custkey from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1 having count(distinct o_orderkey) < 3",
)
INTEGER = "cast(split_part(this, '\"', 2) as int)"
REGISTRY.add(ComponentTemplate(EX + "maxSize", filter=f"{INTEGER} <= [n]", message="larger than [n]", arguments={"n": 45}))
REGISTRY.add(ComponentTemplate(EX + "maxOrders", having="count(focus.this) <= [n]", arguments={"n": 14}))
REGISTRY.add(ComponentTemplate(EX + "sharedValue", pattern="JOIN [p(a)] a ON focus.this = a.this JOIN [p(b)] b ON focus.this = b.this AND a.value = b.value", arguments={"a": None, "b": None}))
REGISTRY.add(ComponentTemplate(EX + "atLeast", query="SELECT g.parent FROM {groups} g LEFT JOIN {focus} f ON g.parent = f.parent GROUP BY g.parent HAVING count(f.this) < [n]", arguments={"n": 1}))
REGISTRY.add(ScopeTemplate(EX + "inNation", "SELECT s AS scope FROM {p_c_nationkey} WHERE o = concat('<" + EX + "nation/', [n], '>')", arguments={"n": 0}))
built("t_component_filter", lambda: A.shape(A.prop_values(p("p_size"), A.shape(Component(EX + "maxSize", 45)))).scoped(A.scope_class(EX + "Part")), key("p_partkey", "part"), "select p_partkey from part where p_size > 45")
built("t_component_having", lambda: A.shape(A.prop_values(p("^o_custkey"), A.shape(Component(EX + "maxOrders", 14)))).scoped(A.scope_class(EX + "Customer")), key("o_custkey", "customer"), "select o_custkey from orders group by 1 having count(distinct o_orderkey) > 14")
built("t_component_pattern", lambda: A.shape(Component(EX + "sharedValue", {"a": p("o_custkey", "c_nationkey"), "b": p("^l_orderkey", "l_suppkey", "s_nationkey")})).scoped(A.scope_class(EX + "Order")), {"k": number("this", "order")}, NATIONS + " select distinct k from (select * from a intersect select * from b)")
built("t_component_query", lambda: A.shape(A.prop_values(p("^o_custkey"), A.shape(Component(EX + "atLeast", 8)))).scoped(A.scope_class(EX + "Customer")), key("c_custkey", "customer"), ORACLES["c_min_count"])
built("t_scope", lambda: A.shape(FALSE).scoped(A.Scope(EX + "inNation", 3)), key("c_custkey", "customer"), ORACLES["s_query"], distinct=False)


def _round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A compact program, written as Turtle and read again, gives the same results."""
    shapes = [s.named(EX + "shape") for s in parse_compact('∈ :Order ⊩ :o_orderstatus ∝ ∈ {"O" "F"}', PREFIX)]
    found = validate(TripleGraph.from_parquet(spark, folder), shapes_from_turtle(shapes_to_turtle(shapes)), detail=False)
    return found.selectExpr(f"{number('this', 'order')} as o_orderkey")


_register("u_compact_syntax", ORACLES["c_in"], _round_trip)


# --- SPARQL --------------------------------------------------------------------------------------


def sparql(name: str, text: str, columns: dict[str, str], sql: str) -> None:
    """A SPARQL query over the whole graph."""
    prologue = f"PREFIX : <{EX}> "
    _register(name, sql, lambda spark, folder: run_sparql(TripleGraph.from_parquet(spark, folder), prologue + text).selectExpr(*[f"{c} as {n}" for n, c in columns.items()]))


COUNT = f"cast({lexical('n')} as bigint)"
sparql(
    "q_optional_group",
    "SELECT ?c (COUNT(DISTINCT ?o) AS ?n) { ?c a/rdfs:subClassOf* :Customer OPTIONAL { ?o :o_custkey ?c . ?o :o_orderstatus 'F' } } GROUP BY ?c HAVING (COUNT(DISTINCT ?o) < 5)",
    {"c_custkey": number("c", "customer"), "n": COUNT},
    "select c_custkey, count(distinct o_orderkey) n from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1 having n < 5",
)
sparql(
    "q_not_exists",
    "SELECT ?c { ?c :c_acctbal ?b FILTER(?b > 0 && NOT EXISTS { ?o :o_custkey ?c ; :o_totalprice ?t FILTER(?t > ?b * 30) }) }",
    {"c_custkey": number("c", "customer")},
    "select c_custkey from customer where c_acctbal > 0 and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > c_acctbal * 30)",
)
sparql(
    "q_union_minus",
    "SELECT DISTINCT ?n { { ?x :c_nationkey ?n } UNION { ?x :s_nationkey ?n } MINUS { ?n :n_regionkey/:r_name 'ASIA' } }",
    {"nation": number("n", "nation")},
    "select n_nationkey::bigint as nation from nation join region on n_regionkey = r_regionkey where r_name <> 'ASIA' and (n_nationkey in (select c_nationkey from customer) or n_nationkey in (select s_nationkey from supplier))",
)
built(
    "q_path_step",
    lambda: A.shape(A.prop_values(A.path(f"PREFIX : <{EX}> SELECT ?subject ?object {{ ?line :l_orderkey ?subject ; :l_suppkey/:s_nationkey ?object }}"), A.shape(A.max_count(3)))).scoped(A.scope_class(EX + "Order")),
    key("o_orderkey", "order"),
    "select l_orderkey as o_orderkey from lineitem join supplier on l_suppkey = s_suppkey group by 1 having count(distinct s_nationkey) > 3",
)
built(
    "q_component",
    lambda: A.shape(A.query(f"PREFIX : <{EX}> SELECT ?this {{ ?this :o_totalprice ?t ; :o_custkey/:c_acctbal ?b FILTER(?t > 3 * ?b) }}")).scoped(A.scope_class(EX + "Order")),
    key("o_orderkey", "order"),
    ORACLES["c_query"],
)


sparql("q_values", "SELECT ?c { VALUES (?n ?s) { (<http://example.org/nation/3> 'BUILDING') (<http://example.org/nation/5> UNDEF) } ?c :c_nationkey ?n ; :c_mktsegment ?s }", {"c_custkey": number("c", "customer")}, "select c_custkey from customer where c_nationkey = 3 and c_mktsegment = 'BUILDING' or c_nationkey = 5")
sparql("q_subquery", "SELECT ?c ?n { { SELECT ?c (COUNT(?o) AS ?n) { ?o :o_custkey ?c } GROUP BY ?c } ?c :c_mktsegment 'BUILDING' }", {"c_custkey": number("c", "customer"), "n": COUNT}, "select o_custkey as c_custkey, count(distinct o_orderkey) n from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1")
sparql("q_path_alternative", "SELECT DISTINCT ?x { ?x :c_nationkey|:s_nationkey <http://example.org/nation/3> }", {"node": f"regexp_replace({local('x')}, '^(.)[a-z]*/', '$1')"}, "select 'c' || c_custkey as node from customer where c_nationkey = 3 union all select 's' || s_suppkey from supplier where s_nationkey = 3")
sparql("q_path_closure", "SELECT ?x { ?x a/rdfs:subClassOf* :Party }", {"node": f"regexp_replace({local('x')}, '^(.)[a-z]*/', '$1')"}, ORACLES["s_class"])
sparql("q_bound", "SELECT ?c { ?c :c_acctbal ?b OPTIONAL { ?o :o_custkey ?c ; :o_orderstatus 'F' } FILTER(!BOUND(?o)) }", {"c_custkey": number("c", "customer")}, ORACLES["c_has_value"])
sparql("q_in", "SELECT ?o { ?o :o_orderstatus ?s FILTER(?s NOT IN ('O', 'F')) }", {"o_orderkey": number("o", "order")}, ORACLES["c_in"])
sparql("q_bind", "SELECT ?p ?d { ?p :p_size ?s BIND(?s * 2 AS ?d) FILTER(?d > 90) }", {"p_partkey": number("p", "part"), "d": f"cast({lexical('d')} as double)"}, "select p_partkey, p_size * 2.0::double d from part where p_size * 2 > 90")
sparql("q_functions", "SELECT ?c (CONCAT(?n, '-', ?s) AS ?x) { ?c :c_name ?n ; :c_mktsegment ?s FILTER(isLiteral(?s) && isIRI(?c) && STRLEN(STR(?s)) > 8 && REGEX(?n, '1$') && DATATYPE(?s) = <http://www.w3.org/2001/XMLSchema#string>) }", {"c_custkey": number("c", "customer"), "x": lexical("x")}, "select c_custkey, c_name || '-' || c_mktsegment x from customer where length(c_mktsegment) > 8 and regexp_matches(c_name, '1$')")

# --- templates that are declared as data --------------------------------------------------------------
DECLARED = f"""@prefix : <{EX}> . @prefix sh: <{PREFIXES["sh"]}> .
:dearerThan a sh:ComponentTemplate ; sh:templatePattern "?this :o_totalprice ?price ." ; sh:templateFilter "?price <= [limit]" ; sh:propValues ( :limit [ a sh:Shape ; sh:argumentName "limit" ; sh:defaultValue 200000 ] ) .
:moreThan a sh:ComponentTemplate ; sh:templatePattern "?this [p(path)] ?value ." ; sh:templateHaving "COUNT(DISTINCT ?value) > [most]" ; sh:propValues ( :along [ a sh:Shape ; sh:argumentName "path" ] ) ; sh:propValues ( :most [ a sh:Shape ; sh:argumentName "most" ] ) .
:fromNation a sh:ScopeTemplate ; sh:templateQuery "SELECT ?scope WHERE {{ ?scope <{EX}c_nationkey> [argument] }}" .
""".replace("?this :o_totalprice", f"?this <{EX}o_totalprice>")


def declared(name: str, shape: str, columns: dict[str, str], sql: str) -> None:
    """A query with templates and a shape that are written as Turtle."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        templates_from_turtle(DECLARED)
        program = shapes_from_turtle(DECLARED.splitlines()[0] + shape)
        return validate(TripleGraph.from_parquet(spark, folder), program, detail=False).selectExpr(*[f"{c} as {n}" for n, c in columns.items()]).distinct()

    _register(name, sql, run)


declared("t_declared_filter", ":s sh:scopeClass :Order ; :dearerThan [ ] .", key("o_orderkey", "order"), "select o_orderkey from orders where o_totalprice > 200000")
declared("t_declared_having", ":s sh:scopeClass :Customer ; :moreThan [ :along [ sh:inverse :o_custkey ] ; :most 14 ] .", key("o_custkey", "customer"), ORACLES["t_component_having"])
declared("t_declared_scope", ":s :fromNation <http://example.org/nation/3> ; sh:in ( ) .", key("c_custkey", "customer"), ORACLES["s_query"])
declared("x_legacy", ":s sh:scope [ a sh:PropertyScope ; sh:predicate :l_partkey ] ; sh:property [ sh:predicate :p_size ; sh:maxInclusive 40 ] .", key("p_partkey", "part"), "select distinct p_partkey from part join lineitem on l_partkey = p_partkey where p_size > 40")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Every order has exactly one customer and a price of at least 0, that customer is known, and its lines ship in time."""
    program = """
    ∈ :Order ⊩ :o_custkey ∝ (|=1| ∧ ∈ :Customer) ∧ :o_totalprice ∝ (|=1| ∧ ^^xs:double ∧ ≥ 0) ∧ :o_orderstatus ∝ ∈ {"O" "F"} .
    ∈ :Line ⊩ :l_orderkey :o_orderdate < :l_shipdate ∧ :l_partkey ∝ |≤1|
    """
    return validate(TripleGraph.from_parquet(spark, folder), [s.named(EX + n) for s, n in zip(parse_compact(program, PREFIX), ("OrderShape", "LineShape"), strict=True)], detail=False)

