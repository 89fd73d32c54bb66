"""Line dedup, DataFrame functions only.

Lines are exploded with their positions and hashed by their key; each document sends every
distinct hash once, so the count (with map-side partials) is of documents. Hashes at or over
the threshold meet the exploded lines by hash, which gives each document the positions it
loses; its other lines are put together again by position. Text is shuffled once, by document.
The commonest lines' rows are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, dealt_joins, saved


def line_hashes(text: Column, min_chars: int) -> Column:
    """The MD5 of each line's key, null where the key is shorter than min_chars."""
    keys = F.split(ascii_lower(text), "\n")

    def one(line: Column) -> Column:
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(key) >= min_chars, F.md5(key))

    return F.transform(keys, one)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 10, min_chars: int = 1) -> DataFrame:
    """df with text_col reduced to the lines that stay, and n_lines (before) and n_dropped.

    A line's key is the line without blanks at its ends and with A-Z lower-cased. Every row is
    a document: repeated rows count as often as they occur. Null or empty text is one empty
    line, whose key is empty and never counted. A document that loses all its lines keeps
    empty text. Other columns pass through; ones named n_lines or n_dropped are replaced.
    """
    # A row is found again by id and text, so that rows that share an id cannot mix.
    source = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(source).alias("key"), source.alias("text"))
    hashed = rows.select("id", "key", line_hashes(F.col("text"), min_chars).alias("hashes"))
    frequent = (hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h IS NOT NULL")
                .groupBy(F.unhex("h").alias("h")).agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= threshold))
    lines = hashed.select("id", "key", F.posexplode("hashes").alias("pos", "h")).filter("h IS NOT NULL").withColumn("h", F.unhex("h"))
    # A line may be in every document: the commonest ones' rows are dealt over all tasks.
    found = dealt_joins(lines, saved(frequent, "frequent"), "h", "docs", F.xxhash64("id", "key", "pos"), "left_semi")
    lost = found.groupBy("id", "key").agg(F.collect_set("pos").alias("lost"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("key").alias("lost_key"), "lost")
    both = rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("key") == F.col("lost_key")), "left")
    both = both.select("row", "text", "lost", F.split("text", "\n").alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")
    new = {
        text_col: F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept),
        "n_lines": F.size("lines").cast("bigint"),
        "n_dropped": F.when(F.col("lost").isNull(), F.lit(0)).otherwise(F.size("lost")).cast("bigint"),
    }
    same = [c for c in df.columns if c not in new]
    return both.select(*(F.col("row")[c].alias(c) for c in same), *(c.alias(n) for n, c in new.items()))
