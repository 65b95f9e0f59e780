"""Data graphs: predicates as lazy DataFrames of (s, o) terms."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

TYPE, SUBCLASS = T.RDF + "type", T.RDFS + "subClassOf"
FIRST, REST, NIL = T.RDF + "first", T.RDF + "rest", T.RDF + "nil"
MOST_CLASS_EDGES = 1_000_000
MOST_PREDICATES = 100_000


class TripleGraph:
    """A set of triples, partitioned by predicate.

    A path step reads one predicate, so of a columnar source one column; operators that ask for any
    predicate read the union. Class edges may be given; otherwise they are the graph's own.
    """

    def __init__(self, spark: SparkSession, predicates: dict[str, Callable[[], DataFrame]], subclasses: Iterable[tuple[str, str]] | None = None, distinct: Iterable[str] = (), typed: Callable[[set[str]], DataFrame] | None = None, holders: Callable[[set[str], bool, bool], DataFrame] | None = None, facts: DataFrame | None = None):
        self._typed = typed  # the instances (s) of classes, where the source knows better than by reading all types
        self._holders = holders  # the nodes that have predicates, where the source needn't read each by itself
        self._facts = facts  # all (s, p, o), where the source has them in one table
        self.spark, self._predicates, self._distinct = spark, predicates, set(distinct)
        self._subclasses = subclasses
        self._closure: dict[str, set[str]] | None = None
        self._hidden: frozenset[str] = frozenset()

    @property
    def predicates(self) -> list[str]:
        return [p for p in self._predicates if p not in self._hidden]

    def beside(self, name: str, edges: DataFrame) -> "TripleGraph":
        """This graph with further edges (s, o) that only those who name them see."""
        other = copy.copy(self)
        other._predicates = self._predicates | {name: lambda: edges}
        other._hidden = self._hidden | {name}
        return other

    def is_distinct(self, name: str) -> bool:
        """Whether the source has each fact of a predicate once."""
        return name in self._distinct

    def holders(self, names: Iterable[str], inverse: bool = False, literals: bool = True) -> DataFrame:
        """(this): the subjects of these predicates' facts, or inversely their objects, perhaps without literals. Nodes may repeat."""
        names = set(names) & set(self._predicates)
        if self._holders is not None:
            return self._holders(names, inverse, literals)
        column = "o" if inverse else "s"
        found = self.all(names, repeated=True).select(F.col(column).alias("this"))
        return found if literals or not inverse else found.where(~T.is_literal(F.col("this")))

    def pred(self, name: str, repeated: bool = False) -> DataFrame:
        """(s, o) of a predicate, each pair once unless repeated; no rows if the graph hasn't got it."""
        if name not in self._predicates:
            return self.spark.createDataFrame([], "s string, o string")
        edges = self._predicates[name]().where("s is not null and o is not null")
        return edges if repeated or name in self._distinct else edges.distinct()

    def all(self, names: Iterable[str] | None = None, repeated: bool = False) -> DataFrame:
        """(s, p, o) of these predicates, or of all, each once unless repeated."""
        chosen = self.predicates if names is None else [n for n in self.predicates if n in set(names)]
        if self._facts is not None:
            facts = self._facts if names is None else self._facts.where(F.col("p").isin(chosen))
            facts = facts.where("s is not null and o is not null").select("s", "p", "o")
            return facts if repeated else facts.distinct()
        parts = [self.pred(n, repeated).select("s", F.lit(n).alias("p"), "o") for n in chosen]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "s string, p string, o string")

    def restricted(self, names: Iterable[str]) -> "TripleGraph":
        """The subgraph of these predicates (by IRI or local name) and of the types of their subjects."""
        chosen = {p: f for p, f in self._predicates.items() if p in names or p.rsplit("/", 1)[-1] in names}
        part = TripleGraph(self.spark, chosen, self._subclasses, self._distinct)
        subjects = lambda: part.all().select("s").distinct()
        return TripleGraph(self.spark, chosen | {TYPE: lambda: self.pred(TYPE, repeated=True).join(subjects(), "s", "left_semi")}, self._subclasses, self._distinct)

    def subclasses(self, name: str) -> set[str]:
        """The class and all below it. The hierarchy is small by nature, which is checked before it is collected."""
        if self._closure is None:
            if self._subclasses is None:
                edges = self.pred(SUBCLASS).limit(MOST_CLASS_EDGES + 1).collect()
                if len(edges) > MOST_CLASS_EDGES:
                    raise ValueError("the class hierarchy is too large to close on the driver")
                self._subclasses = [(r["s"][1:-1], r["o"][1:-1]) for r in edges if r["s"][0] == r["o"][0] == "<"]
            below: dict[str, set[str]] = {}
            for low, high in self._subclasses:
                below.setdefault(high, set()).add(low)
            self._closure = below
        found, todo = {name}, [name]
        while todo:
            for low in self._closure.get(todo.pop(), ()):
                if low not in found:
                    found.add(low)
                    todo.append(low)
        return found

    def instances(self, names: Iterable[str]) -> DataFrame:
        """(s) of the classes' instances and those of their subclasses."""
        classes = sorted(set().union(*(self.subclasses(n) for n in names)))
        if self._typed is not None:
            return self._typed(set(classes))
        return self.pred(TYPE, repeated=True).where(F.col("o").isin([f"<{c}>" for c in classes])).select("s").distinct()

    # --- makers ---------------------------------------------------------------------------------

    @classmethod
    def from_triples(cls, triples: DataFrame) -> "TripleGraph":
        """triples: (s, p, o) of canonical terms; p may be a bare IRI or a term."""
        bare = triples.withColumn("p", F.when(F.col("p").startswith("<"), F.expr("substr(p, 2, length(p) - 2)")).otherwise(F.col("p")))
        names = [r["p"] for r in bare.where("p is not null").select("p").distinct().limit(MOST_PREDICATES + 1).collect()]
        if len(names) > MOST_PREDICATES:
            raise ValueError("too many predicates to name on the driver")
        return cls(triples.sparkSession, {n: (lambda n=n: bare.where(F.col("p") == n).select("s", "o")) for n in sorted(names)}, facts=bare)

    @classmethod
    def from_terms(cls, spark: SparkSession, triples: Iterable[tuple[T.Term, T.Term, T.Term]]) -> "TripleGraph":
        rows: dict[str, list[tuple[str, str]]] = {}
        for s, p, o in triples:
            rows.setdefault(p.iri, []).append((s.key, o.key))
        return cls(spark, {n: (lambda v=v: spark.createDataFrame(v, "s string, o string")) for n, v in rows.items()})

    @classmethod
    def from_turtle(cls, spark: SparkSession, text: str) -> "TripleGraph":
        from .turtle import parse_turtle

        return cls.from_terms(spark, parse_turtle(text)[0])

    @classmethod
    def from_ntriples(cls, spark: SparkSession, location: str) -> "TripleGraph":
        """A folder or file of N-Triples, read line by line in parallel. Escapes are undone.

        Blank lines and comments are skipped; any other line that is no triple raises an error when it is read.
        """
        line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'
        text = spark.read.text(location).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
        wrong = F.raise_error(F.concat(F.lit("no triple: "), F.col("value"))).cast("string")
        text = text.select(F.when(F.col("value").rlike(line), F.col("value")).otherwise(wrong).alias("value"))
        part = lambda n: F.regexp_extract("value", line, n)
        rows = text.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("raw"))
        raw = F.when(F.col("raw").endswith('"'), F.concat("raw", F.lit(f"^^<{T.XSD}string>"))).otherwise(F.col("raw"))
        return cls.from_triples(rows.select(_unescaped(F.col("s")).alias("s"), _unescaped(F.col("p")).alias("p"), _unescaped(raw).alias("o")))

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> "TripleGraph":
        """The relational tables as a graph: each column a predicate (see MAPPING)."""
        from .relational import relational_predicates

        return cls(spark, *relational_predicates(spark, folder))


def _unescaped(text: Column) -> Column:
    """A term's text with its escapes undone: the single characters, \\uXXXX and \\UXXXXXXXX."""
    # the pieces between backslashes: the first character of each but the first says what was escaped
    double = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))  # a doubled backslash escapes nothing behind it
    pieces = F.split(double, r"\\")

    def undone(piece: Column) -> Column:
        code = lambda n: F.decode(F.unhex(F.lpad(F.substring(piece, 2, n), 8, "0")), "UTF-32BE")
        rest = lambda n: F.substr(piece, F.lit(n))
        out = F.when(piece.startswith("u"), F.concat(code(4), rest(6))).when(piece.startswith("U"), F.concat(code(8), rest(10)))
        for mark, meant in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")):
            out = out.when(piece.startswith(mark), F.concat(F.lit(meant), rest(2)))
        return out.otherwise(piece)

    whole = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(undone(x))), "")
    return F.when(text.contains("\\"), F.replace(whole, F.lit("\u0001"), F.lit("\\"))).otherwise(text)
