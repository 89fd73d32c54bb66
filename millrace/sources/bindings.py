"""Design matrices over the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import linear_predictor, sigmoid, uniform


@dataclass(frozen=True)
class Binding:
    df: DataFrame
    features: list[str]
    label: str = "y"
    truth: tuple[float, ...] | None = None


# Fixed values: (column, centre, scale) of each planted feature.
LINEITEM_SCALING = [
    ("l_quantity", 25.5, 14.43), ("l_extendedprice", 52953.0, 30000.0),
    ("l_discount", 0.05, 0.0316), ("l_tax", 0.04, 0.0258),
]
LINEITEM_TRUTH = (0.5, 1.0, -1.0, 1.2, 1.0)
LINEITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def lineitem_planted(spark: SparkSession, sf_dir: str) -> Binding:
    """Scaled lineitem columns with a label drawn from a known model."""
    src = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = [f"x{j}" for j in range(len(LINEITEM_SCALING) + 1)]
    scaled = [((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"x{j}") for j, (c, m, s) in enumerate(LINEITEM_SCALING, 1)]
    df = src.select(F.concat_ws("-", *LINEITEM_KEYS).alias("key"), F.lit(1.0).alias("x0"), *scaled)
    p = sigmoid(linear_predictor(names, LINEITEM_TRUTH))
    return Binding(df.select(*names, F.when(uniform("y", F.col("key")) < p, 1).otherwise(0).alias("y")), names, truth=LINEITEM_TRUTH)


def labels_quality(spark: SparkSession, sf_dir: str) -> Binding:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    df = labels.join(docs, "doc_id").select(
        F.lit(1.0).alias("x0"),
        (F.log(F.lit(1.0) + F.col("n_chars")) - F.lit(7.0)).alias("x1"),
        F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("x2"),
        F.col("quality").alias("y"),
    )
    return Binding(df, ["x0", "x1", "x2"])


def embeddings_binary(spark: SparkSession, sf_dir: str, width: int = 64) -> Binding:
    """label < 5 against the embedding's components: the wide case."""
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    names = ["x0", *(f"x{j}" for j in range(1, width + 1))]
    components = [F.col("embedding")[j - 1].cast("double").alias(f"x{j}") for j in range(1, width + 1)]
    return Binding(src.select(F.lit(1.0).alias("x0"), *components, F.when(F.col("label") < 5, 1).otherwise(0).alias("y")), names)
