"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed

#: Keys with more than one in HUBS of all rows are split into SPLIT parts, so there are at most HUBS of them.
HUBS, SPLIT, LEAST_HUB = 4_096, 32, 64


def join_split(many: DataFrame, one: DataFrame, key: str, rows: int, by: Column) -> DataFrame:
    """many joined with one by key. one has a row for each key and `_n`, about the rows of many with it; rows is their
    sum. The rows of a key that has many are dealt into parts by a hash of `by`, each with a copy of one's row. The keys
    that are split are broadcast, as their number is bounded."""
    most = max(LEAST_HUB, rows // HUBS)
    hubs = one.filter(F.col("_n") > most).select(F.col(key).alias("_hub"))
    part = F.when(F.col("_hub").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(SPLIT)).cast("int"))
    left = many.join(F.broadcast(hubs), F.col(key) == F.col("_hub"), "left").withColumn("_part", part).drop("_hub")
    copies = F.when(F.col("_n") > most, F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_part", F.explode(copies)), [key, "_part"]).drop("_part")


def connected(edges: DataFrame, steps: int = 60, store: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, root): each node of edges (a, b) and the least node of its component. Nodes may be of any ordered type.

    Large-star and small-star steps (Kiveris et al., 2014): each is a minimum by node and a join that splits nodes with
    many neighbours, no neighbours are collected, and the number of steps grows with the logarithm of the component's
    size. `store` keeps the table of each step."""
    pair = lambda x, y: (F.col(x).alias("a"), F.col(y).alias("b"))
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(steps):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            break
        before = now
        near = edges.union(edges.select(*pair("b", "a")))
        least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = join_split(near.filter("b > a"), least, "a", 2 * now[0], F.col("b")).select(*pair("b", "m")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = join_split(large, least, "a", now[0], F.col("b")).select(*pair("b", "m")).union(least.select(*pair("a", "m")))
        edges = store(small.filter("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {steps} steps")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
