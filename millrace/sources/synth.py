"""Parametric generator of binary classification data, reproducible at any partitioning."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import linear_predictor, sigmoid, uniform


@dataclass(frozen=True)
class ModelConfig:
    n: int = 1000
    beta: tuple[float, ...] = (0.5, 1.0, -1.0, 1.2, 1.0, 3.0)
    rho: float = 0.2
    seed: int = 42

    @property
    def n_features(self) -> int:
        return len(self.beta) - 1

    @property
    def names(self) -> list[str]:
        return [f"x{j}" for j in range(len(self.beta))]


def truth_table(spark: SparkSession, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    rows = [(i, name, b) for i, (name, b) in enumerate(zip(cfg.names, cfg.beta, strict=True))]
    return spark.createDataFrame(rows, "idx int, name string, truth double")


def corr_matrix(spark: SparkSession, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """rho^|i-j| in long form."""
    index = F.sequence(F.lit(0), F.lit(cfg.n_features - 1))
    pairs = spark.range(1).select(F.explode(index).alias("i")).select("i", F.explode(index).alias("j"))
    return pairs.select("i", "j", F.pow(F.lit(cfg.rho), F.abs(F.col("i") - F.col("j"))).alias("sigma"))


def features(spark: SparkSession, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """id, x1..xp: zero-mean normals with AR(1) correlation, by Box-Muller and the exact recursion."""
    df = spark.range(cfg.n)
    spread = math.sqrt(1.0 - cfg.rho * cfg.rho)
    for j in range(1, cfg.n_features + 1):
        a, b = uniform(f"a{j}", F.col("id"), cfg.seed), uniform(f"b{j}", F.col("id"), cfg.seed)
        z = F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2.0 * math.pi) * b)
        df = df.withColumn(f"x{j}", z if j == 1 else F.lit(cfg.rho) * F.col(f"x{j - 1}") + F.lit(spread) * z)
    return df


def design_matrix(spark: SparkSession, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    return features(spark, cfg).select("id", F.lit(1.0).alias("x0"), *cfg.names[1:])


def dataset(spark: SparkSession, cfg: ModelConfig = ModelConfig()) -> DataFrame:
    """id, x0..xp, eta, p, y with y ~ Bernoulli(p)."""
    df = design_matrix(spark, cfg).withColumn("eta", linear_predictor(cfg.names, cfg.beta))
    df = df.withColumn("p", sigmoid(F.col("eta")))
    return df.withColumn("y", F.when(uniform("y", F.col("id"), cfg.seed) < F.col("p"), 1).otherwise(0))
