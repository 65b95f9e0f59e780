"""Shape programs: what the front ends build and the compiler reads."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from ..functions.terms import Term

SEVERITIES = ("Info", "Warning", "Violation")
NODE_KINDS = {
    "IRI": ("iri",),
    "BlankNode": ("bnode",),
    "Literal": ("literal",),
    "BlankNodeOrIRI": ("bnode", "iri"),
    "BlankNodeOrLiteral": ("bnode", "literal"),
    "IRIOrLiteral": ("iri", "literal"),
}
_names = itertools.count(1)


class ShapeSyntaxError(ValueError):
    """A shape program that can't be compiled."""


@dataclass(frozen=True)
class Step:
    predicate: str
    inverse: bool = False

    def __str__(self) -> str:
        return f"^<{self.predicate}>" if self.inverse else f"<{self.predicate}>"


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]

    def __post_init__(self) -> None:
        if not self.steps:
            raise ShapeSyntaxError("a path needs a step")

    def __str__(self) -> str:
        return "/".join(map(str, self.steps))


def path(*steps: str | Step) -> Path:
    """A path of predicate IRIs; a leading ^ inverts a step."""
    return Path(tuple(s if isinstance(s, Step) else Step(s[1:], True) if s.startswith("^") else Step(s) for s in steps))


@dataclass(frozen=True)
class Component:
    """A constraint: its name and argument, whose type depends on the name (see NAMES in checks)."""

    name: str
    argument: object = None


@dataclass(frozen=True)
class Scope:
    """kind: node, class, object, subject, allObjects, allSubjects, query or a template's name."""

    kind: str
    argument: object = None


@dataclass(frozen=True)
class Shape:
    components: tuple[Component, ...] = ()
    filters: tuple["Shape", ...] = ()
    scopes: tuple[Scope, ...] = ()
    severity: str | None = None
    id: str = field(default_factory=lambda: f"_:shape{next(_names)}")

    def scoped(self, *scopes: Scope) -> "Shape":
        return replace(self, scopes=(*self.scopes, *scopes))

    def when(self, *filters: "Shape") -> "Shape":
        return replace(self, filters=(*self.filters, *filters))

    def named(self, name: str) -> "Shape":
        return replace(self, id=name)

    def at(self, severity: str) -> "Shape":
        return replace(self, severity=severity)


@dataclass(frozen=True)
class Reference:
    """A shape by its name, looked up in the program when it is compiled."""

    id: str


def shape(*components: Component) -> Shape:
    return Shape(components)


def _c(name: str):
    def build(argument: object = None) -> Component:
        return Component(name, argument)

    build.__name__ = name
    return build


# One builder for each constraint; arguments as the compiler's table says.
datatype, datatype_in, class_, class_in, direct_type = map(_c, ("datatype", "datatypeIn", "class", "classIn", "directType"))
min_length, max_length, node_kind, in_, closed = map(_c, ("minLength", "maxLength", "nodeKind", "in", "closed"))
min_inclusive, min_exclusive, max_inclusive, max_exclusive = map(_c, ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"))
has_value, min_count, max_count, unique_lang, query = map(_c, ("hasValue", "minCount", "maxCount", "uniqueLang", "query"))
list_of, shape_is, not_ = map(_c, ("list", "shape", "not"))


def pattern(expression: str, flags: str = "") -> Component:
    return Component("pattern", (expression, flags))


def prop_values(along: Path, then: Shape | Reference) -> Component:
    return Component("propValues", (along, then))


def and_(*shapes: Shape | Reference) -> Component:
    return Component("and", shapes)


def or_(*shapes: Shape | Reference) -> Component:
    return Component("or", shapes)


def partition(*shapes: Shape | Reference) -> Component:
    return Component("partition", shapes)


def _pair(name: str):
    return lambda a, b: Component(name, (a, b))


equals, disjoint, less_than, less_than_or_equals = map(_pair, ("equals", "disjoint", "lessThan", "lessThanOrEquals"))


def qualified(along: Path, of: Shape | Reference, least: int | None = None, most: int | None = None) -> Component:
    """How many values of a path conform to a shape: the values are filtered by it, then counted."""
    counts = [Component(n, v) for n, v in (("minCount", least), ("maxCount", most)) if v is not None]
    return prop_values(along, Shape(tuple(counts), filters=(of,)))


def scope_node(term: Term) -> Scope:
    return Scope("node", term)


def scope_class(name: str) -> Scope:
    return Scope("class", name)


def scope_objects(predicate: str) -> Scope:
    return Scope("object", predicate)


def scope_subjects(predicate: str) -> Scope:
    return Scope("subject", predicate)


ALL_OBJECTS, ALL_SUBJECTS = Scope("allObjects"), Scope("allSubjects")


def scope_query(text: str) -> Scope:
    return Scope("query", text)
