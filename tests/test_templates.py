"""Templates that are declared as data, their SPARQL fragments and arguments."""

import pytest

from shapewright.api import TripleGraph, results, shapes_from_turtle, templates_from_turtle, validate
from shapewright.plans.ast import ShapeSyntaxError
from shapewright.plans.metamodel import check_shapes_graph

DATA = """@prefix : <http://x/> .
:a a :T ; :age 5 ; :tag "x", "y" ; :knows :b . :b a :T ; :age 50 ; :tag "z" ; :knows :c , :a . :c a :T ; :age 7 ; :knows :c .
:d a :Other ; :age 99 .
"""
TEMPLATES = """@prefix : <http://x/> . @prefix sh: <SH> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:above a sh:ComponentTemplate ; sh:templateFilter "?this > [argument]" ; sh:templateMessage "not above [argument]" ; sh:datatype xsd:integer .
:sees a sh:ComponentTemplate ; sh:templatePattern "?this [argument] ?this ." .
:many a sh:ComponentTemplate ; sh:templatePattern "?this [p(path)] ?value ." ; sh:templateHaving "COUNT(DISTINCT ?value) > [most]" ;
  sh:propValues ( :along [ a sh:Shape ; sh:argumentName "path" ; sh:minCount 1 ] ) ; sh:propValues ( ( :limits :upper ) [ a sh:Shape ; sh:argumentName "most" ; sh:defaultValue 1 ; sh:datatype xsd:integer ] ) .
:ofKind a sh:ScopeTemplate ; sh:templateQuery "SELECT ?scope WHERE { ?scope a [argument] }" .
""".replace("SH", __import__("shapewright.functions.terms", fromlist=["SH"]).SH)
HEAD = TEMPLATES.splitlines()[0]


@pytest.fixture(scope="module")
def graph(spark):
    templates_from_turtle(TEMPLATES)
    return TripleGraph.from_turtle(spark, DATA)


@pytest.mark.parametrize(
    ("shape", "nodes"),
    [
        (":s :ofKind :T ; sh:propValues ( :age [ :above 6 ] ) .", ["a"]),
        (":s :ofKind :T ; :sees :knows .", ["c"]),
        (":s :ofKind :T ; :many [ :along :tag ] .", ["a"]),
        (":s :ofKind :T ; :many [ :along ( :knows :tag ) ] .", ["b"]),
        (":s :ofKind :T ; :many [ :along [ sh:inverse :knows ] ; :limits [ :upper 2 ] ] .", []),
        (":s :ofKind :T ; :many [ :along [ sh:inverse :knows ] ; :limits [ :upper 1 ] ] .", ["c"]),
        (":s :ofKind :Other ; sh:in ( ) .", ["d"]),
    ],
)
def test_declared_templates(graph, shape, nodes):
    found = results(validate(graph, shapes_from_turtle(HEAD + shape))).where("parent is null").select("this").distinct().collect()
    assert sorted(r["this"][10:-1] for r in found) == nodes


def test_messages(graph):
    rows = results(validate(graph, shapes_from_turtle(HEAD + ":s sh:scopePropertyObject :age ; :above 60 ."))).collect()
    assert {r["message"] for r in rows} == {"not above 60"} and len(rows) == 3


def test_arguments_are_judged(spark, graph):
    good = HEAD + ":s :above 6 ; :many [ :along :tag ; :limits [ :upper 3 ] ] ."
    assert check_shapes_graph(spark, good, TEMPLATES).count() == 0
    bad = HEAD + ':s :above "x" ; :many [ :limits [ :upper "y" ] ] .'
    assert {r["source_shape"].rsplit("/", 1)[-1] for r in check_shapes_graph(spark, bad, TEMPLATES).collect()} == {"above", "many"}
    with pytest.raises(ShapeSyntaxError):
        templates_from_turtle(HEAD + ":t a sh:ScopeTemplate .", register=False)
