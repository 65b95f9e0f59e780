"""Graphs that refer to others: imports, and the shapes graphs that a data graph names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions.terms import SH, Term
from ..plans.ast import Shape
from ..plans.compiler import validate
from .graph import TripleGraph
from .shapes_graph import ShapesReader
from .turtle import Triple, parse_turtle

IMPORTS = "http://www.w3.org/2002/07/owl#imports"
SHAPES_GRAPH = SH + "shapesGraph"


class Dataset:
    """Named graphs in Turtle files: name -> location, None for the default graph.

    A file is read whole by the driver when its graph is asked for. Nothing is fetched by a name that
    the dataset hasn't got: naming such a graph is an error.
    """

    def __init__(self, spark: SparkSession, locations: dict[str | None, str]):
        self.spark, self.locations = spark, locations
        self._read: dict[str | None, list[Triple]] = {}

    def graph(self, name: str | None = None) -> list[Triple]:
        """One graph's own triples. Blank nodes of different graphs are different."""
        if name not in self._read:
            if name not in self.locations:
                raise ValueError(f"no graph {name or '(default)'} in the dataset")
            row = self.spark.read.text(self.locations[name], wholetext=True).first()
            mark = f"_:g{len(self._read)}_"
            apart = lambda t: Term(mark + t.key[2:]) if t.kind == "bnode" else t
            self._read[name] = [(apart(s), p, apart(o)) for s, p, o in parse_turtle(row[0] if row else "")[0]]
        return self._read[name]

    def merged(self, names: Iterable[str | None]) -> list[Triple]:
        """The triples of these graphs and of all that they import, each graph once."""
        todo = list(dict.fromkeys(names))
        for name in todo:
            todo += [o for o in objects(self.graph(name), IMPORTS) if o not in todo]
        return list(dict.fromkeys(t for name in todo for t in self.graph(name)))

    def data(self, name: str | None = None) -> TripleGraph:
        return TripleGraph.from_terms(self.spark, self.merged([name]))

    def shapes(self, name: str | None = None) -> list[Shape]:
        """The program in the shapes graphs that the data graph names, and in what they import."""
        return ShapesReader(self.merged(objects(self.merged([name]), SHAPES_GRAPH))).program()

    def validate(self, name: str | None = None) -> DataFrame:
        return validate(self.data(name), self.shapes(name))


def objects(triples: Iterable[Triple], predicate: str) -> list[str]:
    return list(dict.fromkeys(o.iri for _, p, o in triples if p.iri == predicate))
