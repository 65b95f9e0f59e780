"""Constraints on the set of a parent's focus nodes, fused into one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..plans.ast import Component
from ..plans.context import Context

NAMES = ("minCount", "maxCount", "hasValue")


def check_sets(ctx: Context, components: list[Component]) -> DataFrame:
    """minCount, maxCount and hasValue: focus pairs are distinct, so a plain count counts distinct nodes.

    Counts are partial sums before the shuffle. Groups without nodes matter to minCount and hasValue
    only, so without those no outer join is made.
    """
    values = [c.argument for c in components if c.name == "hasValue"]
    has = [F.max((F.col("this") == v.key).cast("int")).alias(f"h{i}") for i, v in enumerate(values)]
    counted = ctx.focus.groupBy("parent").agg(F.count("this").alias("n"), *has)
    if any(c.name == "hasValue" or c.name == "minCount" and c.argument > 0 for c in components):
        counted = ctx.groups.join(counted, "parent", "left").na.fill(0, ["n", *[f"h{i}" for i in range(len(values))]])
    tests, k = [], 0
    for c in components:
        if c.name == "hasValue":
            tests.append((c.name, F.col(f"h{k}") == 0))
            k += 1
        else:
            tests.append((c.name, F.col("n") < c.argument if c.name == "minCount" else F.col("n") > c.argument))
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]), lambda x: x.isNotNull())
    failing = counted.select("parent", "n", F.explode(names).alias("_name"))
    return ctx.rows(failing, F.col("_name"), F.concat(F.col("_name"), F.lit(" fails for "), F.col("n").cast("string"), F.lit(" nodes")), subject=F.col("parent"))


def check_unique_lang(ctx: Context) -> DataFrame:
    """One row for each parent and language that more than one node has."""
    tagged = ctx.focus.withColumn("lang", T.lang_of(F.col("this"))).where("lang is not null and lang != ''")
    twice = tagged.groupBy("parent", "lang").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return ctx.rows(twice, "uniqueLang", F.concat(F.lit("more than one value in "), F.col("lang")), subject=F.col("parent"), object=F.col("lang"))
