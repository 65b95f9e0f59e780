"""What the operators of this subpackage share: table access, shared scratch tables and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEAST_HUB = 100_000
_OWN_SCRATCH: list[str] = []
_ROOTS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder and a
    cluster gets a folder below the warehouse, which is shared too.
    """
    conf = spark.sparkContext.getConf()
    if shared := conf.get("spark.checkpoint.dir"):
        return shared.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="scratch-"))
    return _OWN_SCRATCH[0]


def _remove(spark: SparkSession, location: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _remove_all() -> None:
    """At the end of the program; where its session has been stopped before, tables stay behind."""
    for spark, root in _ROOTS:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                _remove(spark, root)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    What a result still reads stays until the driver's program ends, and goes then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _ROOTS:
            atexit.register(_remove_all)
        _ROOTS.append((spark, self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that nothing reads any more."""
        _remove(self.spark, f"{self.root}/{name}")


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of df and these further fields; df.schema itself must not be added to, as df keeps it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(fields).fields])


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_prefix(df: DataFrame) -> str:
    """A beginning that no column of df has, for columns of an operator's own."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def hub_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined with right, which has one row per key and in its column `rows` how many rows of left have it.

    Keys with more than total / share of the left side's rows are hubs: there are less than `share` of
    them, so right's hub rows are broadcast and their many left rows stay where they are. All other
    keys are joined as usual, and so are all where left has no more than LEAST_HUB rows, which any one
    task can hold. total: rows of left. right's column `rows` isn't returned.
    """
    if total <= LEAST_HUB:
        return left.join(right.drop(rows), key, how)
    most = max(total // share, 1)
    kept = [c for c in right.columns if c not in (key, rows)]
    mark = free_prefix(left) + "hub"
    hubs = right.where(F.col(rows) > most).select(key, F.struct(F.lit(True).alias("hub"), *kept).alias(mark))
    tagged = left.join(F.broadcast(hubs), key, "left")
    of_hubs = tagged.where(F.col(mark).isNotNull()).select(*left.columns, *[F.col(f"{mark}.{c}").alias(c) for c in kept])
    others = tagged.where(F.col(mark).isNull()).select(*left.columns).join(right.where(F.col(rows) <= most).drop(rows), key, how)
    return of_hubs.unionByName(others)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows_per_class: tuple[int, int], most_bytes: int) -> list:
    """Rows (doc_id, text, label) of at most rows_per_class[label] documents, ascending by doc_id.

    The bounds are parameters of the classifiers, and only their training reads the sample: of each
    class the ids that hash lowest are taken, and of their texts, in that order, those that still fit
    into most_bytes bytes in all. Texts are whole. Null texts, rows with a null id or label, and ids
    whose labels disagree, don't count; of an id's several texts the least is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    order = F.xxhash64("doc_id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).select("doc_id", "label").orderBy(order, "doc_id").limit(rows_per_class[value])
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select("doc_id", "text").where("text is not null")
    scratch = Scratch(docs.sparkSession, f"sample-{label}")
    # as many ids as rows_per_class says: small by construction
    sample = scratch.save(text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label"), "texts")
    fitting, left = [], most_bytes
    for r in sample.select("doc_id", F.octet_length("text").alias("n"), order.alias("h")).orderBy("h", "doc_id").collect():
        if r["n"] <= left:
            fitting.append(r["doc_id"])
            left -= r["n"]
    rows = sample.where(F.col("doc_id").isin(fitting)).collect() if fitting else []
    scratch.drop("texts")
    return sorted(rows, key=lambda r: r["doc_id"])


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null texts are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to most at the utmost; a larger item stands alone."""
    first, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, i
            first, held = i, 0
        held += size
    if i >= first:
        yield first, i + 1


def concat_all(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)
