"""Operator 9: n-gram Jaccard join with Bayesian candidate pruning (after BayesLSH).

1. Each text has MinHashes of its shingles (five consecutive words); equal texts stand as one class.
2. Bands of MinHashes tie classes into candidate clusters: within a band value every class is tied to
   the least one, and clusters are connected components of those ties, so no pairs are listed.
3. Within a cluster, cut into blocks where it is large, MinHashes of all pairs are compared step by
   step; a pair is dropped once the posterior probability that its similarity reaches the threshold
   falls below the tolerance. Signatures alone are dealt to the cells for this, and of a cell only
   the members with a pair left come out.
4. The texts of those meet in their cells and are verified exactly on the shingles, by counting common
   ones for a whole block. Per text only its number of links and a tree edge leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_prefix, hub_join, table, utf8_buffers, with_fields
from .components import connected_components
from .embedding_dedup import linked_roots

BANDS, BAND_ROWS = 32, 5
HASHES = BANDS * BAND_ROWS
STEP = 32
_rng = np.random.default_rng(977)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = [np.uint64(x) for x in _rng.integers(1, 1 << 62, 16) * 2 + 1]


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of `words` blank-separated words, ascending.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(each))
    with np.errstate(over="ignore"):
        h = np.zeros(len(each) - width + 1, np.uint64)
        for k in range(width):
            h = (h ^ each[k : len(each) - width + 1 + k]) * _MIX[k % 16]
            h ^= h >> np.uint64(29)
        h += np.uint64(width < words)
    return np.unique(h)


def minhashes(own: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-add hashes of these shingles, 16 mixed bits of each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), 2048):
            values = own[i : i + 2048][None, :] * _FACTORS[:, None] + _ADDED[:, None]
            np.minimum(least, values.min(1), out=least)
    with np.errstate(over="ignore"):  # minima of many values begin with zeros
        return ((least ^ least >> np.uint64(32)) * _MIX[0] >> np.uint64(48)).astype(np.uint16)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 * STEP, ... compared MinHashes: the fewest equal ones with which a pair stays.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), which is at
    least t with probability P(Binomial(n + 1, t) <= m).
    """
    fewest = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        fewest.append(m)
    return fewest


def surviving(a: np.ndarray, b: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Pairs of signature rows that no step drops, as a matrix."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for h in range(STEP):
        equal += a[:, h][:, None] == b[:, h][None, :]
    alive = equal >= fewest[0]
    left, right = np.nonzero(alive)
    matches = equal[left, right]
    for step, least in enumerate(fewest[1:], 1):
        if not len(left):
            break
        for i in range(0, len(left), 1 << 16):
            part = slice(i, i + (1 << 16))
            columns = slice(step * STEP, (step + 1) * STEP)
            matches[part] += (a[left[part], columns] == b[right[part], columns]).sum(1, dtype=np.int16)
        keep = matches >= least
        left, right, matches = left[keep], right[keep], matches[keep]
    out = np.zeros(alive.shape, bool)
    out[left, right] = True
    return out


def common_shingles(sets: list[np.ndarray], first: int, columns: int = 4096) -> np.ndarray:
    """How many shingles each of the first sets shares with each of the others, by products of 0-1 matrices."""
    rest = len(sets) - first
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(joined, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = number[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((first, rest), np.float32)
    for start in range(0, int(shared.sum()), columns):
        i, j = np.searchsorted(place, [start, start + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[i:j], place[i:j] - start] = 1
        total += has[:first] @ has[first:].T
    return total


class _Member:
    __slots__ = ("key", "copies", "resident", "signature", "shingles")

    def __init__(self, key: bytes, copies: int, resident: bool, signature: bytes):
        self.key, self.copies, self.resident = key, copies, resident
        self.signature = np.frombuffer(signature, np.uint16)
        self.shingles: np.ndarray | None = None


def _sides(members: list[_Member], inside: bool, fewest: list[int]) -> tuple[list[_Member], list[_Member], np.ndarray]:
    """The members of a cell that have a pair left after pruning, as rows and columns, and which pairs those are.

    A block with itself has all its members on both sides, any other cell has residents and others.
    """
    a = b = members
    if not inside:
        a, b = ([m for m in members if m.resident is side] for side in (True, False))
    if not a or not b:
        return [], [], np.zeros((0, 0), bool)
    linked = surviving(np.stack([m.signature for m in a]), np.stack([m.signature for m in b]), fewest)
    if inside:
        np.fill_diagonal(linked, False)
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    return [a[i] for i in rows], [b[i] for i in columns], linked[np.ix_(rows, columns)]


def linked_members(members: list[_Member], threshold: float, fewest: list[int], inside: bool) -> Iterator[tuple[bytes, int, bytes]]:
    """(key, links, root) of members with shingles in one cell: of all pairs if it is a block with itself, else of residents with others."""
    a, b, linked = _sides(members, inside, fewest)
    if not a:
        return
    common = common_shingles([m.shingles for m in [*a, *b]], len(a))
    either = np.array([len(m.shingles) for m in a])[:, None] + np.array([len(m.shingles) for m in b])[None, :] - common
    # the threshold as a fraction of whole numbers, so that equality counts
    top, bottom = threshold.as_integer_ratio() if threshold != 0.8 else (4, 5)
    linked &= common * bottom >= either * top
    keys = sorted({m.key for m in [*a, *b]})
    number = {k: i for i, k in enumerate(keys)}
    of_a, of_b = linked_roots(linked, np.array([number[m.key] for m in a]), np.array([number[m.key] for m in b]))
    links_a = linked @ np.array([m.copies for m in b])
    for m, n, root in zip(a, links_a.tolist(), of_a.tolist(), strict=True):
        if n:
            yield m.key, n, keys[root]
    if not inside:
        links_b = np.array([m.copies for m in a]) @ linked
        for m, n, root in zip(b, links_b.tolist(), of_b.tolist(), strict=True):
            if n:
                yield m.key, n, keys[root]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[_Member]]]:
    """The members of each cell, from rows sorted by cell; with a text column also their shingles."""
    at, held = None, {}
    for batch in batches:
        texts = utf8_buffers(batch.column("text")) if "text" in batch.schema.names else None
        names = zip(*[batch.column(c).to_pylist() for c in ("cluster", "i", "j", "key", "copies", "resident", "signature")], strict=True)
        for k, (cluster, i, j, key, copies, resident, signature) in enumerate(names):
            if (cluster, i, j) != at:
                if held:
                    yield at, list(held.values())
                at, held = (cluster, i, j), {}
            if key not in held:
                held[key] = member = _Member(key, copies, resident, signature)
                if texts:
                    offsets, data = texts
                    member.shingles = shingles(data[offsets[k] : offsets[k + 1]].tobytes())
    if held:
        yield at, list(held.values())


def _batches(rows: Iterator[tuple], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


def text_key(text: Column) -> Column:
    """What equal texts have in common: 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def sketch(rows: DataFrame) -> DataFrame:
    """rows (doc_id, key, text) -> doc_id, key, n_shingles, signature; the key is null where a text has no shingles."""
    names = ["doc_id", "key", "n_shingles", "signature"]

    def sketched(batches):
        for batch in batches:
            offsets, data = utf8_buffers(batch.column("text"))
            keys, counts, signatures = [], [], []
            for key, a, b in zip(batch.column("key").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = shingles(data[a:b].tobytes())
                keys.append(key if len(own) else None)
                counts.append(len(own))
                signatures.append(minhashes(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())], names=names)

    return rows.select("doc_id", "key", "text").mapInArrow(sketched, with_fields(rows.select("doc_id", "key"), "n_shingles long, signature binary"))


def similarity_join(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256, block_shingles: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, n_links, key, class_key, one row per document.

    Two texts link if the Jaccard similarity of their sets of five-word shingles is at least the
    threshold; equal texts always do. n_links counts the documents linked directly, class_id is the
    smallest doc_id reachable by links. key names the text (see text_key) and class_key that of the
    class's first document, the one with class_id. Null, empty and blank texts have no shingles and
    link with nothing: class_id is then the doc_id, and both keys are null. Rows with a null doc_id are
    compared as others, and where a class has no other, its class_id is null. Repeated rows are copies
    of each other; an id may stand for several texts, each compared by itself. Very long texts are
    shingled whole, and more of a cluster's blocks are made where its texts are long. Columns but
    doc_id and text aren't read. An empty table gives no rows.

    A pair of similarity 0.8 shares no band with probability 3e-6, and one above the threshold is
    dropped early with about the tolerance.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    fewest = least_matches(threshold, tolerance)
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    sketches = scratch.save(sketch(rows), "sketches")
    known = sketches.where("key is not null")
    # the signature follows from the key: grouping by both lets map sides combine
    classes = scratch.save(known.groupBy("key", "n_shingles", "signature").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("key")), "classes")
    n_rows, n_classes = known.count(), classes.count()
    # nodes of the candidate graph: 64 bits of the key; two classes with one number only widen a cluster
    width = 2 * BAND_ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(BANDS)])
    banded = classes.select("node", F.explode(bands).alias("band"))
    tied = banded.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("other"), F.count("*").alias("n")).where("root != other").select("band", "root", "n")
    ties = hub_join(banded, tied, "band", "n", BANDS * n_classes).where("node != root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()
    clusters = connected_components(ties, scratch, "clusters").withColumnRenamed("component", "cluster")
    members = scratch.save(classes.join(clusters, "node").select("key", "least_id", "copies", "n_shingles", "signature", "cluster"), "members")
    # a large cluster's blocks meet in cells (i, j), i <= j
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = sizes.select("cluster", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("parts"))
    dealt = hub_join(members, sizes, "cluster", "n", n_classes).withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    cell = F.transform(others, lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    cells = dealt.withColumn("at", F.explode(cell)).select("cluster", "at.i", "at.j", "key", "least_id", "copies", (F.col("own") == F.col("at.i")).alias("resident"), "signature")

    def pruned(batches):
        left = ((*at, m.key) for at, members in _by_cell(batches) for side in _sides(members, at[1] == at[2], fewest)[: 1 if at[1] == at[2] else 2] for m in side)
        yield from _batches(left, pa.schema([("cluster", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("key", pa.binary())]))

    # signatures meet first, texts only where a pair is left
    placed = lambda df: df.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    left = scratch.save(placed(cells.drop("least_id")).mapInArrow(pruned, "cluster long, i int, j int, key binary"), "left")
    wanted = left.join(cells, ["cluster", "i", "j", "key"])
    # the text of one document of each class that has a pair left; without ids, equal texts are one row
    chosen = members.join(left.select("key").distinct(), "key", "left_semi").select("key", "least_id").hint("shuffle_hash")
    found = rows.join(chosen, (rows["key"] == chosen["key"]) & rows["doc_id"].eqNullSafe(chosen["least_id"]), "left_semi").dropDuplicates(["key"]).select("key", "text")

    def compared(batches):
        kind = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
        yield from _batches((r for at, members in _by_cell(batches) for r in linked_members(members, threshold, fewest, at[1] == at[2])), kind)

    met = placed(wanted.join(found, "key").select("cluster", "i", "j", "key", "copies", "resident", "signature", "text"))
    met = scratch.save(met.mapInArrow(compared, "key binary, links long, root binary"), "met")
    for name in ("members", "left"):
        scratch.drop(name)
    edges = met.where("key != root").select(F.col("key").alias("u"), F.col("root").alias("v"))
    component = connected_components(edges, scratch, "components").select(F.col("node").alias("key"), "component")
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    classed = classes.select("key", "least_id", "copies").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "key")).alias("first")
    least = classed.groupBy("component").agg(first, F.count("*").alias("n")).select("component", F.col("first.least_id").alias("class_id"), F.col("first.key").alias("class_key"), "n")
    whole = hub_join(classed, least, "component", "n", n_classes).join(links, "key", "left")
    whole = whole.select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_key", "copies")
    joined = hub_join(known.select("doc_id", "key"), whole, "key", "copies", n_rows).select("doc_id", "class_id", "n_links", "key", "class_key")
    none = F.lit(None).cast("binary")
    alone = sketches.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), none.alias("key"), none.alias("class_key"))
    return joined.unionByName(alone)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents")).drop("key", "class_key")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) but near copies: of each class of similarity_join one row stays.

    It has the class's smallest doc_id, or none where no row of the class has one; of that id's texts in
    the class the one with the least key, and of rows with that id and text any one. Rows whose texts
    have no words link with nothing, so they all stay. An empty table stays empty.
    """
    mark = free_prefix(docs)
    key, fate, doc = f"{mark}key", f"{mark}fate", f"{mark}doc"
    joined = scratch_classes(docs)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key"))
    fates = joined.groupBy("doc_id", "key").agg(F.min(first).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    fates = fates.select(F.col("doc_id").alias(doc), F.col("key").alias(key), F.when(F.col("stays"), "repeated").otherwise("goes").alias(fate))
    rows = docs.withColumn(f"{mark}text_key", text_key(F.col("text")))
    told = rows.join(fates, rows["doc_id"].eqNullSafe(fates[doc]) & (rows[f"{mark}text_key"] == fates[key]), "left").drop(doc, key)
    once = told.where(F.col(fate).isNull())
    repeated = told.where(F.col(fate) == "repeated").dropDuplicates(["doc_id", f"{mark}text_key"])
    return once.unionByName(repeated).drop(f"{mark}text_key", fate)


def scratch_classes(docs: DataFrame) -> DataFrame:
    """similarity_join's rows that have a key, written, as they are read more than once."""
    return Scratch(docs.sparkSession, "classes").save(similarity_join(docs.select("doc_id", "text")).where("key is not null"), "rows")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays; see one_of_each_class for nulls, repeated rows and ties."""
    return one_of_each_class(docs.select("doc_id", "text", "lang", "source", "n_chars"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' ']
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
m AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, class_id, coalesce(m.n, 0)::BIGINT AS n_links FROM documents d JOIN class USING (doc_id) LEFT JOIN m USING (doc_id)
"""
}
