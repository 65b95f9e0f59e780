"""Operator 6: minimax contiguous partition of atomic groups into shards, by binary search of the capacity.

Equal texts are one atomic group. Groups that are larger than an even share of what is left have a
shard of their own; the others are ordered by the MD5 of their text and cut into contiguous shards:
the least capacity with which greedy filling succeeds is found by binary search, and within it the cuts
are made where what is left is shared most evenly among the shards left.

Only DataFrame expressions run over the data: they add up group sizes, and then the sizes of ranges of
the order, from coarse to fine. The search runs on the driver over a bounded list of ranges; a range
that a cut could fall into is split further, and all others stay coarse, so what is collected depends on
the number of shards and not on that of groups. The cuts are order keys, so rows find their shard by
comparison, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table

FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 3, 2, 32
CELL_ROWS = 50_000


@dataclass
class Range:
    """Groups whose keys begin with `start`: all their bytes, the largest group, and whether it is just one."""

    start: str
    size: int
    largest: int
    single: bool


def _filled(ranges: list[Range], capacity: int, shards: int, hopeful: bool) -> list[int]:
    """Greedy filling: where each shard ends, as a number of bytes before it.

    A range of several groups is known by its ends only. hopeful: shards may end anywhere in it, so no
    real filling reaches further; otherwise they end before it, and a real filling reaches at least as far.
    """
    ends, used, at = [], 0, 0
    for r in ranges:
        if hopeful and not r.single:
            left = r.size
            while left > capacity - used:
                left -= capacity - used
                at += capacity - used
                ends.append(at)
                used = 0
            used, at = used + left, at + left
        else:
            if r.size > capacity - used:
                ends.append(at)
                used = 0
            used, at = used + r.size, at + r.size
    ends.append(at)
    return ends + [at] * (shards - len(ends))


def _least(low: int, high: int, good) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid + 1, high)
    return low


def _bounds(ranges: list[Range], shards: int) -> tuple[int, int]:
    """Bounds of the least capacity; they are equal where no cut falls into a range of several groups."""
    total, largest = sum(r.size for r in ranges), max(r.largest for r in ranges)
    low = max(largest, -(-total // shards))
    fits = lambda hopeful: lambda c: len(_filled(ranges, c, shards, hopeful)) <= shards
    low = _least(low, total, fits(True))
    # ranges as wholes need at least the size of the largest of them
    return low, _least(max(low, *(r.size for r in ranges)), total, fits(False))


def even_cuts(ranges: list[Range], capacity: int, shards: int) -> list[int]:
    """Numbers of ranges after which a shard ends, but for the last shard; every range counts as atomic.

    Each shard ends where its size is nearest to an even share of what is left, but not beyond the
    capacity, not before the rest would fit into the shards left, and not empty while ranges are left.
    """
    sizes = [r.size for r in ranges]
    # with k shards left, the first range from which on they can hold all the rest
    needed, i = [len(sizes)], len(sizes)
    for _ in range(shards):
        held = 0
        while i and held + sizes[i - 1] <= capacity:
            i -= 1
            held += sizes[i]
        needed.append(i)
    cuts, at, rest = [], 0, sum(sizes)
    for left in range(shards - 1, 0, -1):
        first = max(needed[left], min(at + 1, len(sizes)))
        share, held, best = rest / (left + 1), sum(sizes[at:first]), first
        size = held
        for j in range(first, len(sizes)):
            held += sizes[j]
            if held > capacity or len(sizes) - (j + 1) < left or abs(held - share) >= abs(size - share):
                break
            best, size = j + 1, held
        cuts.append(best)
        at, rest = best, rest - size
    return cuts


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(least capacity, first keys of all shards but the first) of groups (key, bytes) in the order of their keys.

    Only ranges that a cut could fall into are split, with 16 ** MORE_DIGITS parts each: some 20 for each
    shard in a round, whatever the number of groups.
    """

    def measured(of: DataFrame, start: Column) -> list[Range]:
        rows = of.groupBy(start.alias("start")).agg(F.sum("bytes").alias("size"), F.max("bytes").alias("largest"), F.count("*").alias("n")).collect()
        return sorted((Range(r["start"], r["size"], r["largest"], r["n"] == 1) for r in rows), key=lambda r: r.start)

    ranges = measured(groups, F.substring("key", 1, FIRST_DIGITS))  # 16 ** FIRST_DIGITS rows at most
    while ranges:
        low, high = _bounds(ranges, shards)
        early, late = _filled(ranges, low, shards, False), _filled(ranges, high, shards, True)
        cuts = even_cuts(ranges, high, shards)
        open_ranges, at = [], 0
        for k, r in enumerate(ranges):
            crossed = low < high and any(a < at + r.size and at < b for a, b in zip(early, late, strict=False))
            if not r.single and (crossed or r.size > low or k in cuts or k + 1 in cuts):
                open_ranges.append(r)
            at += r.size
        if not open_ranges:
            return high, [ranges[k].start if k < len(ranges) else "g" for k in cuts]  # no key begins with g
        split = {}
        for digits in {len(r.start) for r in open_ranges}:
            starts = [r.start for r in open_ranges if len(r.start) == digits]
            some = groups.where(F.substring("key", 1, digits).isin(starts))
            for r in measured(some, F.substring("key", 1, min(digits + MORE_DIGITS, ALL_DIGITS))):
                split.setdefault(r.start[:digits], []).append(r)
        opened = {r.start for r in open_ranges}
        ranges = [x for r in ranges for x in (split[r.start] if r.start in opened else [r])]
    return 0, []


def alone_groups(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """(keys of the groups that have a shard of their own, bytes of all groups): those of at least an even share of what is left."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone, rest = [], total
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        left = shards - len(alone)
        if left == 1 or r["bytes"] * left < rest:
            break
        alone.append(r["key"])
        rest -= r["bytes"]
    return alone, total


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs.

    size is the text's UTF-8 bytes and 1; the null text counts as the empty one, and they are one
    group, however long its text is. Repeated rows, and rows with a null id, each get a slot of their
    own; slots follow the order in which rows were read. The largest shard is as small as an atomic
    group allows, and no shard is empty while there are as many groups. An empty table gives no rows.
    Columns but doc_id and text aren't read.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit("")).cast("binary")
    # rows of a few bytes stand for the texts from here on
    small = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))
    rows = scratch.save(small.withColumn("row", F.monotonically_increasing_id()), "rows")
    # sorted files, so that the search skips what it doesn't ask for
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("bytes")).sortWithinPartitions("key"), "groups")
    alone, total = alone_groups(groups, shards)
    _, cuts = minimax_cuts(groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone)) if total else (0, [])
    scratch.drop("groups")
    shard = sum([(F.col("key") >= cut).cast("int") for cut in cuts], F.lit(len(alone)))
    for k, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(k)).otherwise(shard)
    # slots: numbered within small cells of rows, whose sizes give each cell its first slot
    cells = -(-rows.count() // CELL_ROWS) or 1
    placed = rows.withColumn("shard", shard).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")  # a row for each 50,000 rows or shard
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    slotted = placed.withColumn("number", number).join(counts.select("shard", "cell", before.alias("start")), ["shard", "cell"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_sharding": op6_sharding}
ORACLES: dict[str, str] = {}
