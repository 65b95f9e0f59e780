"""Parquet tables as predicates: every column is a virtual predicate, read only when it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms as T
from .graph import FIRST, MOST_CLASS_EDGES, NIL, REST, TYPE

EX = "http://example.org/"

# table | kind of its subjects | their key columns | class | columns: name=kind of the object
# Objects: string, double, integer, dateTime, lang (a text with the lang column), or an IRI of a kind.
MAPPING = """
region | region | r_regionkey | Region | r_name=string
nation | nation | n_nationkey | Nation | n_name=string n_regionkey=region
customer | customer | c_custkey | Customer_{c_mktsegment} | c_name=string c_mktsegment=string c_acctbal=double c_nationkey=nation
supplier | supplier | s_suppkey | Supplier | s_name=string s_acctbal=double s_nationkey=nation
part | part | p_partkey | Part_{p_type} | p_name=string p_brand=string p_type=string p_size=integer p_retailprice=double
orders | order | o_orderkey | Order | o_custkey=customer o_orderstatus=string o_orderpriority=string o_totalprice=double o_orderdate=dateTime
lineitem | line | l_orderkey,l_linenumber | Line | l_orderkey=order l_partkey=part l_suppkey=supplier l_quantity=double l_extendedprice=double l_discount=double l_tax=double l_returnflag=string l_linestatus=string l_shipdate=dateTime
events | event | event_id | Event | user_id=user event_type=string value=double ts=dateTime
documents | document | doc_id | Document | text=lang source=source n_chars=integer
labels | document | doc_id | - | quality=integer toxic=integer
conversations | turn | conv_id,turn | Turn | conv_id=conversation role=string text=string
pages | page | page_id | Page | url=string html=string
benchmark | item | item_id | Item | text=string
embeddings | vec | vec_id | Vec | label=integer
"""
LITERALS = ("string", "double", "integer", "dateTime", "lang")
# Names that differ from their column's, or that tables share.
NAMES = {("events", "user_id"): "user", ("conversations", "conv_id"): "conv"}


def ex(name: str) -> str:
    return EX + name


def _subject(kind: str, keys: list[str]) -> Column:
    parts: list[Column] = []
    for k in keys:
        parts += [F.lit("-"), F.col(k)] if parts else [F.col(k)]
    return T.iri_col(f"{EX}{kind}/", *parts)


def _object(column: str, kind: str) -> Column:
    value = F.col(column)
    if kind in ("string", "double", "integer"):
        return T.literal_col(value, T.XSD + kind)
    if kind == "dateTime":
        return T.literal_col(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), T.XSD + kind)
    if kind == "lang":
        return T.lang_col(value, F.col("lang"))
    return T.iri_col(f"{EX}{kind}/", value)


class Subclasses:
    """Subclass edges, of which those of a category column are read when they are first asked for."""

    def __init__(self, known: list[tuple[str, str]], categories: list[tuple[str, str, Callable[[], DataFrame]]]):
        self.known, self.categories = known, categories
        self.edges: list[tuple[str, str]] | None = None

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.edges is None:
            self.edges = list(self.known)
            for prefix, top, values in self.categories:
                rows = values().distinct().limit(MOST_CLASS_EDGES + 1).collect()
                if len(rows) > MOST_CLASS_EDGES:
                    raise ValueError(f"too many classes below {top} to name on the driver")
                self.edges += [(prefix + r[0], top) for r in rows if r[0] is not None]
        return iter(self.edges)


def relational_predicates(spark: SparkSession, folder: str) -> tuple[dict[str, Callable[[], DataFrame]], Subclasses, set[str], Callable[[set[str]], DataFrame], Callable[[set[str], bool, bool], DataFrame]]:
    """(predicates, subclass edges, predicates whose pairs are known to be distinct, instances of classes, holders of predicates)."""
    parts: dict[str, list[tuple[str, Callable[[], DataFrame]]]] = {}
    # (table, subject, class or start of its classes, column that ends their names)
    types: list[tuple[str, Callable[[], Column], str, str | None]] = []
    #: Columns by table: (predicate, column, kind of the object), and how the table's subjects are named.
    columns_of: dict[str, tuple[Callable[[], Column], list[tuple[str, str, str]]]] = {}
    read = lambda table: spark.read.parquet(f"{folder}/{table}.parquet")

    def add(name: str, table: str, make: Callable[[], DataFrame]) -> None:
        parts.setdefault(name, []).append((table, make))

    for line in MAPPING.strip().splitlines():
        table, kind, keys, cls, columns = (x.strip() for x in line.split(" | "))
        subject = lambda kind=kind, keys=keys: _subject(kind, keys.split(",")).alias("s")
        if "{" in cls:
            start, column = cls.rstrip("}").split("{")
            types.append((table, subject, ex(start), column))
            add(TYPE, table, lambda t=table, s=subject, x=start, c=column: read(t).select(s(), T.iri_col(EX + x, F.col(c)).alias("o")))
        elif cls != "-":
            types.append((table, subject, ex(cls), None))
            add(TYPE, table, lambda t=table, s=subject, x=cls: read(t).select(s(), F.lit(f"<{ex(x)}>").alias("o")))
        columns_of[table] = subject, [(ex(NAMES.get((table, c), c)), c, k) for c, k in (x.split("=") for x in columns.split())]
        for item in columns.split():
            column, of = item.split("=")
            add(ex(NAMES.get((table, column), column)), table, lambda t=table, s=subject, c=column, k=of: read(t).select(s(), _object(c, k).alias("o")))
    # blank nodes for the events' properties
    props = lambda: read("events").where("props is not null")
    add(ex("props"), "events", lambda: props().select(_subject("event", ["event_id"]).alias("s"), F.concat(F.lit("_:p"), "event_id").alias("o")))
    add(ex("k"), "events", lambda: props().select(F.concat(F.lit("_:p"), "event_id").alias("s"), T.literal_col(F.get_json_object("props", "$.k"), T.XSD + "integer").alias("o")))
    # each order's lines as a list of parts
    cells = lambda: read("lineitem").select("l_orderkey", "l_linenumber").distinct()
    cell = _subject("cell", ["l_orderkey", "l_linenumber"])
    after = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    add(FIRST, "cells", lambda: read("lineitem").select(cell.alias("s"), T.iri_col(EX + "part/", F.col("l_partkey")).alias("o")))
    add(REST, "cells", lambda: cells().select(cell.alias("s"), F.coalesce(T.iri_col(EX + "cell/", F.col("l_orderkey"), F.lit("-"), after), F.lit(f"<{NIL}>")).alias("o")))
    heads = lambda: read("lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    add(ex("lines"), "cells", lambda: heads().select(_subject("order", ["l_orderkey"]).alias("s"), cell.alias("o")))
    # the values of a category column, few by nature
    categories = [(ex(prefix), ex(top), lambda t=table, c=column: read(t).select(c)) for prefix, table, column, top in (("Customer_", "customer", "c_mktsegment", "Customer"), ("Part_", "part", "p_type", "Part"))]
    subclasses = Subclasses([(ex("Customer"), ex("Party")), (ex("Supplier"), ex("Party"))], categories)

    def union(makers: list) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            frames = [m() for _, m in makers]
            out = frames[0]
            for f in frames[1:]:
                out = out.unionByName(f)
            return out

        return make

    def instances(classes: set[str]) -> DataFrame:
        """Only the tables of these classes are read, and of a table with a class column only its matching rows."""
        frames, repeated = [], False
        for table, subject, start, column in types:
            if column is None and start in classes:
                frames.append(read(table).select(subject()))
                repeated |= table not in keyed
            elif column is not None and (ends := [c.removeprefix(start) for c in sorted(classes) if c.startswith(start)]):
                frames.append(read(table).where(F.col(column).isin(ends)).select(subject()))
        out = spark.createDataFrame([], "s string") if not frames else frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return (out.distinct() if repeated else out).where("s is not null")

    def holders(names: set[str], inverse: bool, literals: bool) -> DataFrame:
        """One scan a table: of subjects only whether one of the columns has a value, of objects the values."""
        frames = []
        for table, (subject, columns) in columns_of.items():
            wanted = [(c, k) for p, c, k in columns if p in names]
            if inverse:
                wanted = [(c, k) for c, k in wanted if literals or k not in LITERALS]
                if wanted:
                    frames.append(read(table).select(F.explode(F.array(*[_object(c, k) for c, k in wanted])).alias("this")))
            elif wanted:
                found = read(table).where(reduce(Column.__or__, [F.col(c).isNotNull() if k != "lang" else F.col(c).isNotNull() & F.col("lang").isNotNull() for c, k in wanted]))
                frames.append(found.select(subject().alias("this")))
        for name, makers in parts.items():
            others = [make for table, make in makers if name in names and (table not in columns_of or name not in {p for p, _, _ in columns_of[table][1]})]
            if name == ex("k") and inverse and not literals:
                continue
            frames += [make().where("s is not null and o is not null").select(F.col("o" if inverse else "s").alias("this")) for make in others]
        out = reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], "this string")
        return out.where("this is not null")

    keyed = {"region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "pages", "benchmark", "embeddings"}
    distinct = {name for name, makers in parts.items() if len(makers) == 1 and makers[0][0] in keyed and name != ex("k")} | {REST, ex("lines")}
    return {name: union(makers) for name, makers in parts.items()}, subclasses, distinct, instances, holders
