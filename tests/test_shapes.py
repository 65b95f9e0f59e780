"""Micro-graphs for the constraints, scopes and combinators."""

import pytest

from shapewright.api import TripleGraph, conforming, details, parse_compact, results, shapes_from_turtle, shapes_to_turtle, validate, validate_shape
from shapewright.plans import ast as A
from shapewright.plans.ast import Component, ShapeSyntaxError

DATA = """
@prefix : <http://x/> .
:Sub rdfs:subClassOf :Mid . :Mid rdfs:subClassOf :Top . :Loop rdfs:subClassOf :Loop2 . :Loop2 rdfs:subClassOf :Loop .
:a a :Top ; :age 5 ; :name "Ann"@en , "Anne"@fr ; :knows :b , :c ; :start 1 ; :end 2 .
:b a :Sub ; :age "x" ; :name "Bob"@en , "Rob"@en ; :knows :a ; :start 3 ; :end 2 .
:c a :Mid ; :age 50.5 ; :start "z" ; :end 9 .
:d a :Loop .
_:e a :Top ; :age "NaN"^^xs:double .
:l1 :list ( :a :b ) . :l2 :list _:c1 . _:c1 rdf:first :a . :l3 :list _:c2 . _:c2 rdf:first :a , :b ; rdf:rest () .
:l4 :list _:c3 . _:c3 rdf:first :a ; rdf:rest _:c3 . :l5 :list () .
"""
PREFIX = {"": "http://x/"}


@pytest.fixture(scope="module")
def graph(spark):
    return TripleGraph.from_turtle(spark, DATA)


def bad(graph, program, column="this"):
    found = results(validate(graph, parse_compact(program, PREFIX))).select(column).collect()
    return sorted(str(r[0]).replace("http://x/", "").strip("<>") for r in found)


ALL = "∈ :Top ⊩ "


@pytest.mark.parametrize(
    ("program", "nodes"),
    [
        (ALL + ":age ∝ ^^xs:integer", ["_:ne", "b", "c"]),
        (ALL + ":age ∝ ^^xs:integer ∪ xs:decimal", ["_:ne", "b"]),
        (ALL + ":age ∝ ≥ 5", ["_:ne", "b"]),
        (ALL + ":age ∝ > 5", ["_:ne", "a", "b"]),
        (ALL + ":age ∝ ≤ 50.5", ["_:ne", "b"]),
        (ALL + ":age ∝ < 50.5", ["_:ne", "b", "c"]),
        (ALL + "IRI", ["_:ne"]),
        (ALL + "BlankNode", ["a", "b", "c"]),
        (ALL + ":name ∝ ℓ≤3", ["a"]),
        (ALL + ":name ∝ ℓ≥4", ["a", "b"]),
        (ALL + "ℓ≥1", ["_:ne"]),
        (ALL + ':name ∝ "^a" ★ "i"', ["b"]),
        (ALL + "∈ :Mid", ["_:ne", "a"]),
        (ALL + "⋹ :Top", ["b", "c"]),
        (ALL + "∈ { :a :c }", ["_:ne", "b"]),
        (ALL + ":knows ∝ |≥1|", ["_:ne", "c"]),
        (ALL + ":knows ∝ |=1|", ["_:ne", "a", "c"]),
        (ALL + ":knows ∝ ∋ :c", ["_:ne", "b", "c"]),
        (ALL + ":name ∝ ➀", ["b"]),
        (ALL + "⟦ rdf:type :age :start :end :name ⟧", ["a", "b"]),
        (ALL + "⟦ rdf:type :age :start :end :name :knows :knows⁻¹ ⟧", ["a", "b"]),  # they are firsts of lists
        (ALL + ":start < :end", ["b", "c"]),
        (ALL + ":start ≤ :start", []),
        (ALL + ":knows ∅ :knows⁻¹", ["a", "b"]),
        (ALL + ":knows = :knows⁻¹", ["a", "c"]),
        (ALL + "¬ (:age ∝ ≥ 5)", ["a", "c"]),
        (ALL + "¬ (:knows ∝ |≥1|)", ["a", "b"]),
        (ALL + "(:age ∝ ≥ 5 ∨ :knows ∝ |≥1|)", ["_:ne"]),
        (ALL + "(IRI → :age ∝ ^^xs:integer)", ["b", "c"]),
        (ALL + "((∈ :Mid → :age ∝ ≥ 5) ∖ (IRI → |≥1|) ∖)", ["_:ne", "b"]),
        (ALL + "((IRI → :age ∝ ≥ 0) ∖ BlankNode ∖)", ["b"]),
        ("∈ :Loop2 ⊩ BlankNode", ["d"]),
        (":age² ⊩ IRI", ['"50.5"^^<http://www.w3.org/2001/XMLSchema#decimal', '"5"^^<http://www.w3.org/2001/XMLSchema#integer', '"NaN"^^<http://www.w3.org/2001/XMLSchema#double', '"x"^^<http://www.w3.org/2001/XMLSchema#string']),
        ("¹:list ⊩ :list ∝ ⦇ IRI ⦈", ["l2", "l3", "l4"]),
        ("¹:list ⊩ :list ∝ ⦇ ∈ {:a} ⦈", ["l1", "l2", "l3", "l4"]),
        (":zz ⊩ :knows ∝ |≥1|", ["zz"]),
    ],
)
def test_compact(graph, program, nodes):
    assert sorted(set(bad(graph, program))) == sorted(nodes)


def test_nested_values_are_reported_apart(graph):
    program = "∈ :Top ⊩ :knows ∝ :knows ∝ ∈ {:b}"
    report = validate(graph, parse_compact(program, PREFIX))
    assert {r["this"] for r in results(report).collect()} == {"<http://x/a>", "<http://x/b>"}
    assert details(report).count() >= 1


def test_top_level_sets(graph):
    rows = results(validate(graph, parse_compact("∈ :Top ⊩ |≥9| ∧ |≤1| ∧ ∋ :a", PREFIX))).collect()
    assert sorted(r["component"] for r in rows) == ["maxCount", "minCount"]
    assert all(r["this"] is None and r["parent"] is None for r in rows)
    assert bad(graph, "∈ :None ⊩ |≥1|", "component") == ["minCount"]


def test_severity_filters_and_conforming(graph, spark):
    shape = parse_compact(":s ≡ ∈ :Top ⊩ IRI → :age ∝ ^^xs:integer", PREFIX)[0].at("Warning")
    rows = results(validate_shape(graph, shape)).collect()
    assert {r["severity"] for r in rows} == {"Warning"} and len(rows) == 2
    nodes = spark.createDataFrame([("<http://x/a>",), ("<http://x/b>",)], "this string")
    report = validate_shape(graph, shape.at("Violation"))
    assert [r[0] for r in conforming(report, nodes, "http://x/s").collect()] == ["<http://x/a>"]


def test_empty_combinators(graph):
    for component, n in ((A.and_(), 0), (A.or_(), 4), (A.partition(), 4)):
        assert results(validate_shape(graph, A.shape(component).scoped(A.scope_class("http://x/Top")))).count() == n


def test_qualified_count(graph):
    shape = A.shape(A.qualified(A.path("http://x/knows"), A.shape(A.class_("http://x/Sub")), least=1)).scoped(A.scope_class("http://x/Top"))
    assert {r["this"] for r in results(validate_shape(graph, shape)).collect()} == {"<http://x/b>", "<http://x/c>", "_:ne"}


@pytest.mark.parametrize(
    "program",
    [":s ≡ :t . :t ≡ :s", ":s ≡ ¬ :missing", ":s ≡ ℓ≤-1", ":s ≡ |≥x|", ":s ≡ p:x ∝ IRI", ":s ≡ (IRI", ":s ≡ :a :b", ':s ≡ "(" ★', ":a"],
)
def test_syntax_errors(graph, program):
    with pytest.raises(ShapeSyntaxError):
        validate(graph, parse_compact(program, PREFIX))


def test_wrong_arguments(graph):
    for c in (Component("minCount", -1), Component("nodeKind", "Iri"), Component("nothing"), Component("closed", ["x"])):
        with pytest.raises(ShapeSyntaxError):
            validate_shape(graph, A.shape(c).scoped(A.ALL_SUBJECTS))


def test_turtle_round_trip(graph):
    program = ':s ≡ ∈ :Top ∪ :a ⊩ IRI → :name ∝ "^a" ★ "i" ∧ (:start < :end ∨ ¬ ∈ {:a "x"@en 1.5}) ∧ ⟦ :age :knows⁻¹ ⟧ ∧ :knows :knows⁻¹ ∝ |=1| ∧ ((IRI → |≤3|) ∖ ⦇ IRI ⦈ ∖)'
    shapes = parse_compact(program, PREFIX)
    again = [s for s in shapes_from_turtle(shapes_to_turtle(shapes)) if s.scopes]
    same = lambda shapes: sorted(tuple(r)[:2] + (r["component"],) for r in results(validate(graph, shapes)).collect())
    assert [tuple(map(str, x)) for x in same(shapes)] == [tuple(map(str, x)) for x in same(again)]


def test_legacy_turtle(graph):
    text = """@prefix : <http://x/> .
    :s a sh:Shape ; sh:scopeClass :Top ; sh:property [ sh:predicate :knows ; sh:minCount 1 ] .
    :t sh:scope [ a sh:AllSubjectsScope ] ; sh:filterShape [ sh:class :Mid ] ; sh:inverseProperty [ sh:predicate :knows ; sh:maxCount 0 ] .
    :u sh:scopeClass :Top ; sh:property [ sh:predicate :knows ; sh:qualifiedValueShape [ sh:class :Sub ] ; sh:qualifiedMinCount 1 ] ."""
    found = results(validate(graph, shapes_from_turtle(text))).select("source_shape", "this").collect()
    names = lambda s: sorted(r["this"].replace("http://x/", "").strip("<>") for r in found if r["source_shape"] == "http://x/" + s)
    assert names("s") == ["_:ne", "c"] and names("t") == ["b", "c"] and names("u") == ["_:ne", "b", "c"]


def test_ntriples(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<http://x/a> <http://x/p> "q\\"u\\\\n\\n" .\n<http://x/a> <http://x/p> "y"@EN-us .\n_:b <http://x/p> <http://x/a> . # note\n')
    graph = TripleGraph.from_ntriples(spark, str(tmp_path / "g.nt"))
    assert {(r["s"], r["o"]) for r in graph.pred("http://x/p").collect()} == {("<http://x/a>", '"q"u\\n\n"^^<http://www.w3.org/2001/XMLSchema#string>'), ("<http://x/a>", '"y"@EN-us'), ("_:b", "<http://x/a>")}


def test_stream(spark, tmp_path):
    from shapewright.streaming.nodes import check_stream

    spark.createDataFrame([("<http://x/a>",), ('"abc"^^<http://www.w3.org/2001/XMLSchema#string>',)], "term string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("term string").parquet(str(tmp_path / "in"))
    query = check_stream(stream, "term", A.shape(A.node_kind("IRI"), A.max_length(3))).writeStream.format("memory").queryName("checked").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["term"][:2], r["component"]) for r in spark.table("checked").collect()) == [('"a', "nodeKind"), ("<h", "maxLength")]
    with pytest.raises(ShapeSyntaxError):
        check_stream(stream, "term", A.shape(A.class_("http://x/C")))
