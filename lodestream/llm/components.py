"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, written


def components(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """edges(src, dst) of any sortable type -> (node, component) with component the smallest node that is reachable.

    Each step replaces a node's neighbours by links to its smallest one. A step is two aggregations that Spark sums up
    on the map side and one join on the node, so a node with millions of neighbours is never gathered anywhere.
    Every round is written to the shared folder, which keeps the lineage short and survives lost executors. Loops, repeated and
    reversed edges are allowed; edges with a null end are left out; nodes without an edge don't occur in the result.
    """
    spark = edges.sparkSession
    loops = edges.filter("src is not null and dst is not null")
    start, _ = written(loops.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u")).distinct(), "cc")
    now, before = start, None
    for _ in range(max_rounds):
        # large star: each neighbour larger than the node goes to the smallest of the node and its neighbours
        both = now.filter("u <> v").select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(now.filter("u <> v").select(F.col("v").alias("n"), F.col("u").alias("o")))
        low = both.groupBy("n").agg(F.min("o").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.filter("o > n").join(low, "n").select(F.col("o").alias("v"), F.col("low").alias("u")).distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("low").alias("u")).filter("u <> v").unionByName(least.select("v", F.col("low").alias("u"))).distinct()
        after, new_path = written(small, "cc")
        n, total = after.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before:
            drop_path(spark, before[0])
        if before and before[1:] == (n, total):
            now = after
            break
        before = (new_path, n, total)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    nodes = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
