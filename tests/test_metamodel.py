"""Shape programs validated as data."""

from shapewright.api import parse_compact, shapes_to_turtle
from shapewright.plans.metamodel import check_shapes_graph


def test_good_and_bad_programs(spark):
    good = shapes_to_turtle(parse_compact(':s ≡ ∈ :T ⊩ IRI → :p ∝ |≤3| ∧ "^a" ★ "i" ∧ :p = :q⁻¹ ∧ ⟦ :p :q⁻¹ ⟧ ∧ (ℓ≤3 ∨ ¬ ∈ {:a 1})', {"": "http://x/"}))
    assert check_shapes_graph(spark, good).count() == 0
    bad = """@prefix : <http://x/> . :s sh:minCount -1 ; sh:maxCount "x" ; sh:nodeKind :Other ; sh:severity sh:Info , sh:Bad ; sh:class "C" ; sh:equals ( :p ) ; sh:in ( [] ) ; sh:and ( "x" ) ."""
    found = {r["source_shape"].rsplit("#", 1)[-1] for r in check_shapes_graph(spark, bad).collect()}
    assert found == {"minCountArgument", "maxCountArgument", "nodeKindArgument", "severityArgument", "severityOnce", "classArgument", "equalsArgument", "inArgument", "andArgument"}


def test_results_as_data(spark):
    report = """@prefix : <http://x/> . :r a sh:ValidationResult ; sh:focusNode :a ; sh:message "m"@en ; sh:severity sh:Info .
    :q a sh:ValidationResult ; sh:focusNode :a , :b ; sh:sourceShape :s , :t ; sh:message 5 ; sh:severity :Odd . :other sh:focusNode :a , :b ; sh:message 5 ."""
    found = {(r["source_shape"].rsplit("#", 1)[-1], r["this"]) for r in check_shapes_graph(spark, report).collect()}
    assert found == {("focusNodeResult", "<http://x/q>"), ("sourceShapeResult", "<http://x/q>"), ("messageResult", "<http://x/q>"), ("severityArgument", "<http://x/Odd>")}
