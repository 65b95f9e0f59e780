"""Turtle: a parser for small graphs (shape programs, fixtures) and a writer."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from ..functions import terms as T
from ..functions.terms import Term, bnode, curie, iri

TYPE, FIRST, REST, NIL = (iri(T.RDF + n) for n in ("type", "first", "rest", "nil"))
Triple = tuple[Term, Term, Term]


class TurtleError(ValueError):
    pass


_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n]*)
  |(?P<long>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3})
  |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  |(?P<directive>@prefix\b|@base\b|(?i:prefix\b|base\b)(?=\s+[\w.-]*:?\s*<|\s*<))
  |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
  |(?P<name>(?:[^\W\d_][\w.-]*)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:.%-]|\\.)*(?:[\w:%-]|\\.))?)?)
  |(?P<word>\ba\b|\btrue\b|\bfalse\b)
  |(?P<mark>\^\^|[;,.\[\]()])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[1]
        return chr(int(s[1:], 16)) if s[0] in "uU" else _ESCAPES.get(s, s)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.DOTALL)


def number(text: str) -> Term:
    kind = "double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"
    return T.literal(text, T.XSD + kind)


class _Parser:
    def __init__(self, text: str, prefixes: dict[str, str]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TurtleError(f"unexpected {text[at:at + 20]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base = 0, dict(prefixes), ""
        self.triples: list[Triple] = []
        self.labels = (f"b{n}" for n in itertools.count())

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, mark: str) -> None:
        if self.next()[1] != mark:
            raise TurtleError(f"expected {mark!r} before {self.peek()[1]!r}")

    def document(self) -> None:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive":
                self.next()
                if "prefix" in text.lower():
                    name = self.next()[1]
                    self.prefixes[name.rstrip(":")] = self.resolve(self.next()[1][1:-1])
                else:
                    self.base = self.next()[1][1:-1]
                if self.peek()[1] == "." and text[0] == "@":
                    self.next()
                continue
            bracket = text == "["
            subject = self.term()
            if not (bracket and self.peek()[1] == "."):
                self.properties(subject)
            self.expect(".")

    def properties(self, subject: Term) -> None:
        while True:
            verb = self.term()
            while True:
                self.triples.append((subject, verb, self.term()))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
            if self.tokens[self.at - 1][1] != ";" or self.peek()[1] in (".", "]", ""):
                return

    def resolve(self, text: str) -> str:
        return text if re.match(r"[A-Za-z][\w+.-]*:", text) else self.base + text

    def term(self) -> Term:
        kind, text = self.next()
        match kind:
            case "iri":
                return iri(self.resolve(unescape(text[1:-1])))
            case "name":
                prefix, _, local = text.partition(":")
                if prefix not in self.prefixes:
                    raise TurtleError(f"unknown prefix {prefix!r}")
                return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
            case "blank":
                return bnode("n" + text[2:])
            case "word":
                return TYPE if text == "a" else T.literal(text == "true")
            case "number":
                return number(text)
            case "string" | "long":
                value = unescape(text[3:-3] if kind == "long" else text[1:-1])
                if self.peek()[0] == "lang":
                    return T.literal(value, lang=self.next()[1][1:])
                if self.peek()[1] == "^^":
                    self.next()
                    return T.literal(value, self.term().iri)
                return T.literal(value)
        if text == "[":
            node = bnode(next(self.labels))
            if self.peek()[1] != "]":
                self.properties(node)
            self.expect("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                if self.peek()[0] == "end":
                    raise TurtleError("a list has no end")
                items.append(self.term())
            self.next()
            return add_list(self.triples, items, self.labels)
        raise TurtleError(f"unexpected {text!r}")


def add_list(triples: list[Triple], items: list[Term], labels: Iterable[str]) -> Term:
    """Cons cells of the items; their head."""
    head = NIL
    for item in reversed(items):
        cell = bnode(next(labels))
        triples += [(cell, FIRST, item), (cell, REST, head)]
        head = cell
    return head


def parse_turtle(text: str, prefixes: dict[str, str] | None = None) -> tuple[list[Triple], dict[str, str]]:
    """(triples, prefixes). rdf, rdfs, sh, xs and xsd are known without a directive."""
    parser = _Parser(text, T.PREFIXES | (prefixes or {}))
    parser.document()
    return parser.triples, parser.prefixes


def write_turtle(triples: Iterable[Triple], prefixes: dict[str, str] | None = None) -> str:
    """Triples as Turtle, grouped by subject in order of appearance."""
    prefixes = T.PREFIXES | (prefixes or {})

    def show(t: Term) -> str:
        if t.kind == "literal":
            text = '"' + t.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
            if t.lang:
                return f"{text}@{t.lang}"
            return text if t.datatype == T.XSD + "string" else f"{text}^^{curie(iri(t.datatype), prefixes)}"
        return curie(t, prefixes)

    by_subject: dict[Term, list[tuple[Term, Term]]] = {}
    for s, p, o in triples:
        by_subject.setdefault(s, []).append((p, o))
    lines = [f"@prefix {name}: <{start}> ." for name, start in prefixes.items()] + [""]
    for s, pairs in by_subject.items():
        lines.append(show(s) + " " + " ;\n    ".join(f"{'a' if p == TYPE else show(p)} {show(o)}" for p, o in pairs) + " .")
    return "\n".join(lines) + "\n"
