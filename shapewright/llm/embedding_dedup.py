"""Operator 2: near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Centres are fitted on a bounded sample and every vector is assigned to its nearest centre (its home
cell) and, as a guest, to every other cell in which a vector within the threshold could be at home:
those whose bisecting plane is nearer than the threshold's chord. So no link is lost between cells,
and a vector's links are all found in its home cell. Cells are cut into blocks, and a task compares
one block of residents with one block of members, whatever a cell's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hub_join, table, with_fields
from .components import connected_components


def unit_rows(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length, as unit rows in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Spherical k-means on unit rows; a centre without rows moves to the row that is farthest from its own."""
    cells = max(1, min(cells, len(sample)))
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.choice(len(sample), cells, replace=False))].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        home = near.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        sizes = np.bincount(home, minlength=cells)
        far = iter(np.argsort(near[np.arange(len(sample)), home], kind="stable"))
        for k in np.flatnonzero(sizes == 0):
            sums[k] = sample[next(far)]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def memberships(x: np.ndarray, centres: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether at home) of unit rows.

    A row y within `chord` of x is at home in cell c only if y.(home(x) - c) <= 0, so x lies within
    `chord` of that plane: x.(home(x) - c) <= chord * |home(x) - c|.
    """
    near = x @ centres.T
    home = near.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    reach = near[np.arange(len(x)), home][:, None] - near <= chord * apart[home] + 1e-9
    reach[np.arange(len(x)), home] = True
    row, cell = np.nonzero(reach)
    return row, cell, cell == home[row]


def _blocks(cells: DataFrame, block: int) -> DataFrame:
    """cells (label, length, cell, id, home, weight, embedding) -> one row for each block pair a row takes part in."""
    cells = cells.withColumn("place", F.struct("label", "length", "cell"))
    sizes = cells.groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("at_home"))
    parts = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    sizes = sizes.select("place", "n", "at_home", parts("at_home", block).alias("in_i"), parts("n", 4 * block).alias("in_j"))
    dealt = hub_join(cells, sizes, "place", "n", cells.count())
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    # residents meet all blocks of members; members meet all blocks of residents, which are fewer
    as_resident = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("in_j") - 1), lambda j: F.struct(own("in_i").alias("i"), j.alias("j"), F.lit(True).alias("resident")))).otherwise(F.array().cast("array<struct<i:int,j:int,resident:boolean>>"))
    as_member = F.when(F.col("at_home") > 0, F.transform(F.sequence(F.lit(0), F.col("in_i") - 1), lambda i: F.struct(i.alias("i"), own("in_j").alias("j"), F.lit(False).alias("resident")))).otherwise(F.array().cast("array<struct<i:int,j:int,resident:boolean>>"))
    return dealt.withColumn("at", F.explode(F.concat(as_resident, as_member))).select("place", "at.i", "at.j", "at.resident", "id", "weight", "embedding")


def linked_roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least number of each row's and column's component in a bipartite link matrix; a and b are their numbers."""
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], top).min(1, initial=top))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], top).min(0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def _compare(threshold: float):
    kind = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        resident = group.column("resident").to_numpy()
        ids, weight = group.column("id").to_numpy(), group.column("weight").to_numpy()
        x = unit_rows(group.column("embedding").combine_chunks())
        a, b = np.flatnonzero(resident), np.flatnonzero(~resident)
        linked = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        links = linked @ weight[b]
        a, b, linked = _linked_only(a, b, linked)
        of_a, of_b = linked_roots(linked, ids[a], ids[b])
        # links of residents, then a tree over what is linked here instead of all its links
        node, root = np.concatenate((ids[a], ids[b])), np.concatenate((of_a, of_b))
        links = np.concatenate((links[links > 0], np.zeros(len(b), np.int64)))
        keep = (links > 0) | (node != root)
        return pa.table({"id": node[keep], "links": links[keep], "root": root[keep]}, kind)

    return compare


def _linked_only(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, columns = linked.any(1), linked.any(0)
    return a[rows], b[columns], linked[rows][:, columns]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 8192, cell_rows: int = 2048, most_cells: int = 4096, block: int = 512) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row per vector.

    Vectors link if their labels are equal and not null and their cosine is at least threshold.
    Vectors that are null, empty or zero, hold null or non-finite numbers, or have a null label link
    with nothing: 0 links, and a component of their own. Lengths that differ link with nothing either.
    Equal vectors of a label are compared as one and counted as many; repeated vec_ids are rows of
    their own, each linked with its copies. Vectors with a null vec_id link as others; a component's id
    is the least that isn't null, and null (and all its rows kept) where there is none. Very long
    vectors are compared as others. Columns of other names aren't read. Only a sample of sample_rows
    vectors is fitted on; all are assigned and compared, those of a length that the sample hasn't got
    in one cell. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    e = F.col("embedding")
    fit = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding", "label").withColumn("fit", F.coalesce(fit, F.lit(False)))
    # equal vectors stand together; hot ones are pre-aggregated before the shuffle
    classes = rows.where("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    # a class is named by a number of its own: repeated ids may stand for different vectors
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    sample = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample_rows).collect()
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["embedding"]), []).append(r["embedding"])
    chord = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    cells_of = lambda known: min(most_cells, -(-n_classes * len(known) // (len(sample) * cell_rows)))
    # at most most_cells centres of each length, and sample_rows in all
    shared = spark.sparkContext.broadcast({n: fit_centres(unit_rows(pa.array(known, pa.list_(pa.float64()))), cells_of(known)) for n, known in by_length.items()})

    def assigned(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lengths = part.column("length").to_numpy()
                for length in np.unique(lengths):
                    same = part.take(pa.array(np.flatnonzero(lengths == length)))
                    if length in shared.value:
                        row, cell, home = memberships(unit_rows(same.column("embedding")), shared.value[length], chord)
                        same = same.take(pa.array(row))
                    else:
                        cell, home = np.zeros(same.num_rows), np.ones(same.num_rows, bool)
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=[*part.schema.names, "cell", "home"])

    chosen = classes.select("label", F.size("embedding").alias("length"), "id", "weight", "embedding")
    cells = scratch.save(chosen.mapInArrow(assigned, with_fields(chosen, "cell int, home boolean")), "cells")
    met = scratch.save(_blocks(cells, block).groupBy("place", "i", "j").applyInArrow(_compare(threshold), "id long, links long, root long"), "met")
    scratch.drop("cells")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    found = connected_components(_edges(met), scratch, "components")
    placed = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    summed = hub_join(placed, first, "component", "n", n_classes).join(links, "id", "left")
    summed = summed.select(F.struct("label", "embedding").alias("vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id", "weight")
    joined = hub_join(rows.where("fit").select("vec_id", F.struct("label", "embedding").alias("vector")), summed, "vector", "weight", n_rows).select("vec_id", "n_links", "component_id")
    apart = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = joined.unionByName(apart)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _edges(met: DataFrame) -> DataFrame:
    return met.where("root != id").select(F.col("id").alias("u"), F.col("root").alias("v"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}
ORACLES = {
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN n USING (vec_id)
"""
}
