"""Syntax checks of shape programs, before anything is compiled."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..functions.terms import Term
from .ast import NODE_KINDS, SEVERITIES, Component, Path, Reference, Shape, ShapeSyntaxError, Step

_shape = lambda x: isinstance(x, Shape | Reference)
_iri = lambda x: isinstance(x, str) and bool(x)
_many = lambda test: lambda x: isinstance(x, list | tuple) and all(map(test, x))
_natural = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
_literal = lambda x: isinstance(x, Term) and x.kind == "literal"
_constant = lambda x: isinstance(x, Term) and x.kind != "bnode"
_paths = lambda x: isinstance(x, tuple) and len(x) == 2 and all(isinstance(p, Path) for p in x)
_text = lambda x: isinstance(x, str)


def _pattern(x: object) -> bool:
    if not (isinstance(x, tuple) and len(x) == 2 and all(map(_text, x)) and set(x[1]) <= set("ismxq")):
        return False
    try:
        re.compile(re.sub(r"\\[pP]\{[^}]*\}", "x", x[0])) if "q" not in x[1] else None
    except re.error:
        return False
    return True


ARGUMENTS = {
    "in": _many(_constant), "class": _iri, "classIn": _many(_iri), "datatype": _iri, "datatypeIn": _many(_iri), "directType": _iri,
    "minLength": _natural, "maxLength": _natural, "minCount": _natural, "maxCount": _natural,
    "minInclusive": _literal, "minExclusive": _literal, "maxInclusive": _literal, "maxExclusive": _literal,
    "nodeKind": lambda x: x in NODE_KINDS, "pattern": _pattern, "closed": _many(lambda s: isinstance(s, Step)),
    "equals": _paths, "disjoint": _paths, "lessThan": _paths, "lessThanOrEquals": _paths,
    "hasValue": _constant, "uniqueLang": lambda x: isinstance(x, bool) or x is None, "query": _text,
    "propValues": lambda x: isinstance(x, tuple) and len(x) == 2 and isinstance(x[0], Path) and _shape(x[1]),
    "list": _shape, "shape": _shape, "not": _shape, "and": _many(_shape), "or": _many(_shape), "partition": _many(_shape),
}
SCOPES = {"node": lambda x: isinstance(x, Term), "class": _iri, "object": _iri, "subject": _iri, "allObjects": lambda x: True, "allSubjects": lambda x: True, "query": _text}


def children(shape: Shape) -> list[Shape | Reference]:
    out = list(shape.filters)
    for c in shape.components:
        parts = c.argument if isinstance(c.argument, list | tuple) else [c.argument]
        out += [p for p in parts if _shape(p)]
    return out


def check_component(c: Component) -> None:
    from .templates import REGISTRY

    if c.name not in ARGUMENTS and REGISTRY.component(c.name) is None:
        raise ShapeSyntaxError(f"unknown component {c.name}")
    if c.name in ARGUMENTS and not ARGUMENTS[c.name](c.argument):
        raise ShapeSyntaxError(f"{c.name} can't have the argument {c.argument!r}")


def check_program(shapes: Iterable[Shape], named: dict[str, Shape]) -> None:
    """Raises ShapeSyntaxError for wrong arguments, unknown names and recursion."""
    from .templates import REGISTRY

    done: set[int] = set()

    def visit(s: Shape | Reference, above: tuple[str, ...]) -> None:
        if isinstance(s, Reference):
            if s.id not in named:
                raise ShapeSyntaxError(f"no shape {s.id}")
            s = named[s.id]
        if s.id in above:
            raise ShapeSyntaxError(f"shape {s.id} refers to itself")
        if id(s) in done:
            return
        if s.severity is not None and s.severity not in SEVERITIES:
            raise ShapeSyntaxError(f"unknown severity {s.severity}")
        for x in s.scopes:
            if x.kind not in SCOPES and REGISTRY.scope(x.kind) is None:
                raise ShapeSyntaxError(f"unknown scope {x.kind}")
            if x.kind in SCOPES and not SCOPES[x.kind](x.argument):
                raise ShapeSyntaxError(f"scope {x.kind} can't have the argument {x.argument!r}")
        for c in s.components:
            check_component(c)
        for child in children(s):
            visit(child, (*above, s.id))
        done.add(id(s))

    for s in shapes:
        visit(s, ())
