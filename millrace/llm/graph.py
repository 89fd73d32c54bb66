"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of its component) of every id in edges (a, b), both long and not null.

    Alternating large-star and small-star steps; each round's edges are written to the shared
    folder. A node of very many neighbours costs one aggregate with map-side partials and a join
    that Spark can split; no component is gathered in one task.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = fingerprint(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join takes both sides straight from a shuffle: only then can Spark split a hot node's rows.
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large")
        discard(least, now)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = saved(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        discard(least, large)
        before, mark = mark, fingerprint(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
