"""Shared pieces: written intermediate tables, text keys, bounded samples."""

from __future__ import annotations

import gc
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D], as characters.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a local master gets a local one; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by saved() of which nothing is read any more. What is still to be read must have been saved since."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at).getParent()
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects them."""
    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """A-Z only. Pure ASCII (as many bytes as characters) takes the byte-wise lower()."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def crc_fold(id_col: Column) -> Column:
    """crc32(id as text) mod 5; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0))


#: Keys whose rows are spread by dealt_joins. Any other key has less than a share of 1 / HOT of the rows.
HOT = 1000


def dealt_joins(rows: DataFrame, keys: DataFrame, key: str, size: str, by: Column, how: str) -> DataFrame:
    """rows joined with ``keys`` (saved, one row a key, with the number of its rows in ``size``) where any key may have most of the rows.

    The HOT largest keys are broadcast, which is bounded by their number, so that each of their rows
    draws a task by the hash ``by``; in ``keys`` these have a copy for each. Others meet as in any join.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = keys.orderBy(F.desc(size), key).limit(HOT).select(F.col(key).alias("__hot"))
    spread = F.when(F.col("__hot").isNotNull(), F.pmod(by, F.lit(tasks)).cast("int")).otherwise(F.lit(0))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__task", spread).drop("__hot")
    copies = F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    right = keys.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__task", F.explode(copies)).drop("__hot")
    return left.join(right.hint("merge"), [key, "__task"], how).drop("__task")


#: Kind, key and object: what the last operator of this Python worker left for the next task.
_KEPT: list = [None, None, None]


def kept(kind: str, key: str, make):
    """One object for a Python worker, which Spark reuses from task to task; another kind or key takes its place and its memory."""
    if _KEPT[:2] != [kind, key]:
        _KEPT[:] = [kind, key, None]
        release()
        _KEPT[2] = make()
    return _KEPT[2]


def release() -> None:
    """Hands memory that earlier tasks no longer use back to the machine."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
