"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet to the shared folder and read back as the next one's docs.

toxicity     documents predicted toxic go
exact        of equal texts (A-Z lower-cased) the largest doc_id stays
near         of each class of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays
secrets      every secret's span becomes [SECRET]; n_chars follows the text
packing      the rest as pieces of sequences of at most 2048 tokens

In every stage a null text counts as empty and stays null, an empty table gives an empty one, and
columns of other names than doc_id, text and n_chars pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, minhash, secret_scan, toxicity
from millrace.llm.common import discard, saved
from millrace.llm.packing import pack
from millrace.llm.registry import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic. A null or empty text is judged as labelled rows without a word are; without labels all stay.

    Repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, labels)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without copies. Null and empty texts are copies of each other; rows repeated with the kept doc_id all stay, as do null-id rows where all of a group are."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without near copies. Null and empty texts have no shingle and stay; rows repeated with a kept doc_id all stay; a null doc_id links with nothing and stays."""
    return minhash.survivors(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With redacted texts and their lengths. A null text keeps its n_chars; rows repeated with one doc_id and text are redacted alike."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A null or empty text is the end id alone; every repeated row is packed for itself."""
    return pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Toxicity, near copies and packing are not expressible in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
