"""RDF terms as canonical strings, and the scalar functions of constraints on columns of them.

An IRI is ``<iri>``, a blank node ``_:label``, a literal ``"lexical"^^<datatype>`` or
``"lexical"@lang``. The lexical form isn't escaped: it ends at the last quotation mark, as neither
datatypes nor language tags have one. Equal strings are the same term, so joins need no struct.
"""

from __future__ import annotations

import pkgutil
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that others define: prefixes and namespaces, one a line.
PREFIXES = dict(line.split() for line in pkgutil.get_data(__package__, "vocabularies.txt").decode().splitlines())
RDF, RDFS, SH, XSD = (PREFIXES[p] for p in ("rdf", "rdfs", "sh", "xsd"))
NUMERIC = ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")


@dataclass(frozen=True)
class Term:
    """A constant term."""

    key: str

    @property
    def kind(self) -> str:
        return {"<": "iri", "_": "bnode"}.get(self.key[0], "literal")

    @property
    def iri(self) -> str:
        if self.kind != "iri":
            raise ValueError(f"{self.key} is no IRI")
        return self.key[1:-1]

    @property
    def lex(self) -> str:
        if self.kind == "iri":
            return self.key[1:-1]
        return self.key[2:] if self.kind == "bnode" else self.key[1 : self.key.rindex('"')]

    @property
    def datatype(self) -> str | None:
        if self.kind != "literal":
            return None
        tail = self.key[self.key.rindex('"') + 1 :]
        return RDF + "langString" if tail[:1] == "@" else tail[3:-1]

    @property
    def lang(self) -> str | None:
        if self.kind != "literal":
            return None
        tail = self.key[self.key.rindex('"') + 1 :]
        return tail[1:] if tail[:1] == "@" else None

    def __str__(self) -> str:
        return self.key


def iri(value: str) -> Term:
    return Term(f"<{value}>")


def bnode(label: str) -> Term:
    return Term(f"_:{label}")


def literal(value: object, datatype: str | None = None, lang: str | None = None) -> Term:
    """A literal of a Python value; its datatype follows from the value unless given."""
    if lang is not None:
        return Term(f'"{value}"@{lang.lower()}')
    if datatype is None:
        datatype = XSD + {bool: "boolean", int: "integer", float: "double"}.get(type(value), "string")
    if isinstance(value, bool):
        value = str(value).lower()
    return Term(f'"{value}"^^<{datatype}>')


def curie(term: Term, prefixes: dict[str, str]) -> str:
    if term.kind == "iri":
        for name, start in prefixes.items():
            if term.iri.startswith(start) and re.fullmatch(r"[\w.-]*", term.iri[len(start) :]):
                return f"{name}:{term.iri[len(start):]}"
    return term.key


# --- columns -------------------------------------------------------------------------------------


def iri_col(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit("<" + prefix), *[p.cast("string") for p in parts], F.lit(">"))


def literal_col(value: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{datatype}>'))


def lang_col(value: Column, lang: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"@'), F.lower(lang))


def kind(t: Column) -> Column:
    return F.when(t.startswith("<"), F.lit("iri")).when(t.startswith("_"), F.lit("bnode")).otherwise(F.lit("literal"))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def _tail(t: Column) -> Column:
    """What follows the last quotation mark."""
    return F.substring_index(t, '"', -1)


def str_of(t: Column) -> Column:
    """The lexical form or IRI; a blank node's label, which no caller looks at."""
    inner = F.substr(t, F.lit(2), F.length(t) - F.length(_tail(t)) - 2)
    return F.when(is_literal(t), inner).when(is_iri(t), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(F.substr(t, F.lit(3)))


def datatype_of(t: Column) -> Column:
    tail = _tail(t)
    typed = F.substr(tail, F.lit(4), F.length(tail) - 4)
    return F.when(is_literal(t), F.when(tail.startswith("@"), F.lit(RDF + "langString")).otherwise(typed))


def lang_of(t: Column) -> Column:
    tail = _tail(t)
    return F.when(is_literal(t) & tail.startswith("@"), F.substr(tail, F.lit(2)))


def _has(t: Column, datatype: str) -> Column:
    """Whether a term is a literal of this datatype of XSD: its end says it, so nothing is cut out."""
    return t.startswith('"') & t.endswith(f'"^^<{XSD}{datatype}>')


def _lexical(t: Column, datatype: str) -> Column:
    """The lexical form of a literal that has this datatype."""
    return F.substr(t, F.lit(2), F.length(t) - len(f'""^^<{XSD}{datatype}>'))


def _less(a: Column, b: Column, strict: bool) -> Column:
    """a < b (or <=) of two terms; NULL if they can't be compared.

    Terms of one family can be ordered: numbers, strings, booleans, dates or times.
    """
    order = lambda x, y: x < y if strict else x <= y
    any_of = lambda t, names: reduce(Column.__or__, [_has(t, n) for n in names])
    la, lb = str_of(a), str_of(b)
    xa, xb = la.try_cast("double"), lb.try_cast("double")
    ya, yb = la.try_cast("decimal(38,18)"), lb.try_cast("decimal(38,18)")
    floating = any_of(a, ("double", "float")) | any_of(b, ("double", "float"))
    # Spark orders NaN above all numbers, the standard compares nothing with it
    doubles = F.when(F.isnan(xa) | F.isnan(xb), F.lit(False)).otherwise(order(xa, xb))
    numbers = F.when(floating | ya.isNull() | yb.isNull(), doubles).otherwise(order(ya, yb))
    known = None
    for name, kind in (("dateTime", "timestamp"), ("string", "string"), ("date", "timestamp"), ("boolean", "boolean")):
        compared = order(*[_lexical(t, name).try_cast(kind) if kind != "string" else _lexical(t, name) for t in (a, b)])
        both = _has(a, name) & _has(b, name)
        known = F.when(both, compared) if known is None else known.when(both, compared)
    return known.when(any_of(a, NUMERIC) & any_of(b, NUMERIC), numbers)


def less_than(a: Column, b: Column) -> Column:
    return _less(a, b, True)


def less_or_equal(a: Column, b: Column) -> Column:
    return _less(a, b, False)


def constant(term: Term) -> Column:
    return F.lit(term.key)


def regex(pattern: str, flags: str = "") -> str:
    """An expression for rlike with the flags i, s, m, x and q of regular expressions over strings."""
    if not set(flags) <= set("ismxq"):
        raise ValueError(f"unknown flags {flags!r}")
    if "q" in flags:
        pattern = re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", pattern)
    inline = "".join(f for f in flags if f in "ismx") + ("u" if "i" in flags else "")
    return f"(?{inline}){pattern}" if inline else pattern
