"""SPARQL queries against a graph small enough to read the answers off."""

import pytest

from shapewright.api import REGISTRY, ComponentTemplate, ScopeTemplate, TripleGraph, results, shapes_from_turtle, shapes_to_turtle, validate
from shapewright.plans import ast as A
from shapewright.plans.ast import ShapeSyntaxError
from shapewright.sources.sparql import is_sparql, run_sparql

DATA = """
@prefix : <http://x/> .
:Sub rdfs:subClassOf :Top .
:a a :Top ; :age 5 ; :name "Ann"@en ; :knows :b , :c .
:b a :Sub ; :age 7 ; :name "Bob" ; :knows :c .
:c a :Sub ; :age "x" ; :knows :d .
:d :knows :a .
:e :age 7.0 .
"""
P = "PREFIX : <http://x/> "


@pytest.fixture(scope="module")
def graph(spark):
    return TripleGraph.from_turtle(spark, DATA)


def short(term):
    return None if term is None else term[1 : term.rindex('"')] if term.startswith('"') else term.strip("<>").replace("http://x/", "")


def ask(graph, text):
    return sorted((tuple(map(short, r)) for r in run_sparql(graph, P + text).collect()), key=str)


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("SELECT ?s WHERE { ?s :age 7 }", [("b",)]),
        ("SELECT ?s { ?s :age ?a FILTER(?a = 7) }", [("b",), ("e",)]),
        ("SELECT ?s { ?s :age ?a FILTER(?a < 7) }", [("a",)]),
        ("SELECT ?s { ?s :age ?a FILTER(!(?a < 7)) }", [("b",), ("e",)]),
        ("SELECT ?s { ?s :age ?a FILTER(!COALESCE(?a < 7, false)) }", [("b",), ("c",), ("e",)]),
        ("SELECT ?s ?n { ?s :age ?a OPTIONAL { ?s :name ?n } }", [("a", "Ann"), ("b", "Bob"), ("c", None), ("e", None)]),
        ("SELECT ?s ?t { ?s :age ?a OPTIONAL { ?t :age ?b FILTER(?b > ?a && ?b < 7.5) } FILTER(?s = :a) }", [("a", "b"), ("a", "e")]),
        ("SELECT ?s { ?s :age ?a MINUS { ?s :name ?n } }", [("c",), ("e",)]),
        ("SELECT ?s { { ?s :age 5 } UNION { ?s :name 'Bob' } }", [("a",), ("b",)]),
        ("SELECT ?s { ?s :age ?a FILTER NOT EXISTS { ?s :knows ?x } }", [("e",)]),
        ("SELECT ?s { ?s :age ?a FILTER EXISTS { ?t :age ?b FILTER(?b < ?a) } }", [("b",), ("e",)]),
        ("SELECT ?s { ?s :age ?a FILTER(EXISTS { ?s :name ?n } || ?a = 'x') }", [("a",), ("b",), ("c",)]),
        ("SELECT ?x { :a :knows+ ?x }", [("a",), ("b",), ("c",), ("d",)]),
        ("SELECT ?x { ?x :knows* :b }", [("a",), ("b",), ("c",), ("d",)]),
        ("SELECT ?x { :e :knows* ?x }", [("e",)]),
        ("SELECT ?x { :b :knows? ?x }", [("b",), ("c",)]),
        ("SELECT ?x { :c ^:knows ?x }", [("a",), ("b",)]),
        ("SELECT ?x { :a :knows/:knows ?x }", [("c",), ("d",)]),
        ("SELECT ?x { :b :knows|:name ?x }", [("Bob",), ("c",)]),
        ("SELECT ?x { :b !(:age|rdf:type|:name) ?x }", [("c",)]),
        ("SELECT ?x { ?x a/rdfs:subClassOf* :Top }", [("a",), ("b",), ("c",)]),
        ("SELECT ?p { :e ?p ?o }", [("age",)]),
        ("SELECT ?s (COUNT(DISTINCT ?k) AS ?n) { ?s :age ?a OPTIONAL { ?s :knows ?k } } GROUP BY ?s HAVING (COUNT(DISTINCT ?k) < 2)", [("b", "1"), ("c", "1"), ("e", "0")]),
        ("SELECT (COUNT(*) AS ?n) { ?s :none ?o }", [("0",)]),
        ("SELECT (SUM(?a) AS ?n) { ?s :age ?a FILTER(isNumeric(?a) && datatype(?a) = xsd:integer) }", [("12",)]),
        ("SELECT ?s ?v { VALUES (?s ?v) { (:a 1) (:b UNDEF) (:z 3) } ?s :age ?x }", [("a", "1"), ("b", None)]),
        ("SELECT ?n { ?s :name ?m BIND(CONCAT(STR(?m), '!') AS ?n) FILTER(LANG(?m) = 'en') }", [("Ann!",)]),
        ("SELECT ?s { ?s :name ?n FILTER REGEX(?n, '^b', 'i') }", [("b",)]),
        ("SELECT ?s { { SELECT ?s (MAX(?a) AS ?m) { ?s :age ?a } GROUP BY ?s } FILTER(?m = 5) }", [("a",)]),
        ("SELECT ?s { ?s :age ?a FILTER(?a NOT IN (5, 'x')) }", [("b",), ("e",)]),
        ("SELECT DISTINCT ?k { ?s :knows [ :age ?k ] }", [("5",), ("7",), ("x",)]),
        ("SELECT (?a + 1 AS ?n) { :a :age ?a }", [("6",)]),
        ("SELECT ?s { ?s :age ?a FILTER(?a * 2 >= 14 && STRLEN(STR(?a)) + 1 != 2) }", [("e",)]),
        ("SELECT ?s { ?s :age ?a FILTER(!(?a + 1 = 'x')) }", [("a",), ("b",), ("e",)]),
        ("SELECT ?s { ?s :age ?a . ?t :name ?n FILTER(?s = ?t) }", [("a",), ("b",)]),
    ],
)
def test_queries(graph, text, rows):
    assert ask(graph, text) == rows


def test_sql_is_told_apart():
    assert is_sparql("SELECT ?this WHERE { ?this ?p ?o }") and is_sparql("select (?a + 1 as ?b) { }") and is_sparql("SELECT * { ?s ?p ?o }")
    assert not is_sparql("select f.this from {focus} f") and not is_sparql("SELECT (a + 1) AS this FROM {focus}") and not is_sparql("http://x/p")


def test_refusals(graph):
    for text in ("SELECT ?s { ?s q:x ?o }", "SELECT ?s { ?s :age ?a", "SELECT ?a ?A { ?a :age ?A }", "SELECT (F(?a) AS ?b) { ?s :age ?a }"):
        with pytest.raises(ShapeSyntaxError):
            run_sparql(graph, P + text)


def test_query_component_scope_and_path(graph):
    text = P + "SELECT ?this ?message { ?this :age ?a FILTER(?a > 5) BIND('old' AS ?message) }"
    shape = A.shape(A.query(text)).scoped(A.scope_query(P + "SELECT ?scope { ?scope a/rdfs:subClassOf* :Top }"))
    assert [(short(r.this), r.message) for r in results(validate(graph, [shape])).collect()] == [("b", "old")]
    source = """@prefix : <http://x/> .
    :S a sh:Shape ; sh:scopeNode :a ; sh:propValues ( "PREFIX : <http://x/> SELECT ?subject ?object { ?subject :knows/:knows ?object }" [ sh:in ( :c ) ] ) ."""
    shapes = shapes_from_turtle(source)
    for program in (shapes, shapes_from_turtle(shapes_to_turtle(shapes))):
        assert {short(r.object) for r in results(validate(graph, program)).collect()} == {"d"}


def test_templates(graph):
    REGISTRY.add(ComponentTemplate("knowsNot", query=P + "SELECT ?this { ?this :knows [who] }", arguments={"who": None}))
    REGISTRY.add(ScopeTemplate("aged", P + "SELECT ?scope { ?scope :age [age] }", {"age": None}))
    shape = A.shape(A.Component("knowsNot", A.Term("<http://x/c>"))).scoped(A.Scope("aged", 7))
    assert [short(r.this) for r in results(validate(graph, [shape])).collect()] == ["b"]
