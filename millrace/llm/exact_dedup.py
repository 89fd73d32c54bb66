"""Exact dedup with skew-safe combining, DataFrame functions only.

1. *Local*: each task collapses its own equal texts (the map-side half of the aggregate).
2. *Salted merge*: what is left is shuffled by (digest, salt, text), so a group that holds a
   third of all rows is spread over ``salts`` tasks.
3. *Global*: the winners of the salts, at most ``salts`` rows a group, meet by (digest, text).

The full normalised text is part of the key at every stage, so two texts with one digest are
never merged. Rows find their group again by digest alone, unless a digest with two texts
exists; then they find it by digest and text. The rows of the HOT largest groups are dealt over
all tasks for that, each task with its own copy of the group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dealt_joins, saved


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16,
                digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the largest id stays (a null id only where all
    are null, and then no row of the group but every null-id row is kept). Rows repeated with
    the kept id are all marked kept: they cannot be told apart. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = df.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = keyed.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "norm").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    table = saved(groups.select("digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    clash = table.groupBy("digest").count().filter("count > 1").limit(1).count()
    if clash:
        found = keyed.join(groups.withColumn("text_sha256", F.sha2("norm", 256)), ["digest", "norm"])
    else:
        found = dealt_joins(keyed.select("id", "digest"), table, "digest", "group_size", F.xxhash64("id"), "inner")
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of df that stay, with df's columns whatever their names; rows repeated with the kept id all stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = exact_dedup(df, id_col, text_col, **kwargs).filter("kept").select(F.col(id_col).alias("kept_id"), "text_sha256").distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(ascii_lower(text), 256).alias("sha"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("text_sha256"))
    return rows.join(kept.hint("merge"), same, "left_semi").select("row.*")
