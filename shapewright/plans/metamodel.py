"""Shape programs that are data: a program whose shapes say what a shape program may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .compiler import validate
from .report import results

# One statement for each kind of argument; every property of the vocabulary is under one of them.
_ARGUMENTS = {
    "∈ {sh:Info sh:Warning sh:Violation}": ("severity",),
    "∈ {sh:IRI sh:BlankNode sh:Literal sh:BlankNodeOrIRI sh:BlankNodeOrLiteral sh:IRIOrLiteral}": ("nodeKind",),
    "∈ {true}": ("scopeAllObjects", "scopeAllSubjects", "uniqueLang"),
    "^^xs:decimal ∪ xs:integer": ("order",),
    "^^xs:integer ∧ ≥ 0": ("minLength", "maxLength", "minCount", "maxCount"),
    "^^xs:string": ("query", "scopeQuery", "templateFilter", "templatePattern", "templateHaving", "templateQuery", "argumentName"),
    "Literal ∧ ^^xs:string ∪ rdf:langString": ("name", "description", "templateMessage"),
    "∈ sh:PropertyGroup": ("group",),
    "IRI": ("class", "datatype", "directType", "scopeClass", "scopePropertyObject", "scopePropertySubject"),
    "Literal": ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"),
    "¬ BlankNode": ("hasValue",),
    "¬ Literal": ("shape", "not", "list", "filter", "filterShape", "valueShape", "constraint"),
    "⦇ IRI ⦈": ("classIn", "datatypeIn"),
    "⦇ ¬ BlankNode ⦈": ("in",),
    "⦇ ¬ Literal ⦈": ("and", "or", "partition"),
    "⦇ (IRI ∨ sh:inverse ∝ (|=1| ∧ IRI)) ⦈": ("closed",),
    "(Literal → ^^xs:string)": ("pattern",),
    # two paths, or a path and a shape, neither of which is a literal
    "rdf:rest rdf:rest ∝ ∋ rdf:nil ∧ rdf:first ∝ ¬ Literal ∧ rdf:rest rdf:first ∝ ¬ Literal": ("equals", "disjoint", "lessThan", "lessThanOrEquals", "propValues"),
}

# Fields that a result has at most once.
_RESULT_FIELDS = ("focusNode", "subject", "predicate", "object", "sourceConstraint", "sourceShape", "sourceTemplate")


def program() -> str:
    """The program in the compact syntax: the objects of each property have the form of its argument."""
    lines = [f"sh:{name}Argument ≡ sh:{name}² ⊩ {form} ." for form, names in _ARGUMENTS.items() for name in names]
    once = [f"sh:{name}Once ≡ ¹sh:{name} ⊩ sh:{name} ∝ |≤1| ." for name in ("severity", "order", "group", "defaultValue", "argumentName", "templateFilter", "templatePattern", "templateHaving", "templateQuery")]
    once += [f"sh:{name}Once ≡ ¹sh:{name} ⊩ sh:{name} ∝ ➀ ." for name in ("name", "description", "templateMessage")]
    fields = [f"sh:{name}Result ≡ ∈ sh:ValidationResult ⊩ sh:{name} ∝ |≤1| ." for name in _RESULT_FIELDS]
    fields.append("sh:messageResult ≡ ∈ sh:ValidationResult ⊩ sh:message ∝ (Literal ∧ ^^xs:string ∪ rdf:langString) .")
    return "\n".join([*lines, *once, *fields])


def check_shapes_graph(spark: SparkSession, turtle: str, templates: str = "") -> DataFrame:
    """What is wrong with a shape program written as RDF: the results of the program above on it.

    templates: Turtle that declares the templates that it uses; they judge their own arguments.
    """
    from ..sources.compact import parse_compact
    from ..sources.graph import TripleGraph
    from ..sources.shapes_graph import argument_shapes

    graph = TripleGraph.from_turtle(spark, turtle)
    # only the shapes whose property occurs can have results
    used = {p.rsplit("#", 1)[-1] for p in graph.predicates}
    shapes = [s for s in parse_compact(program()) if s.id.rsplit("#", 1)[-1].removesuffix("Argument").removesuffix("Once").removesuffix("Result") in used]
    shapes += argument_shapes(templates) if templates else []
    return results(validate(graph, shapes, detail=False))
