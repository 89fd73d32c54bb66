"""Fits as relations. All inputs are one fit's coefficients and history, a few kilobytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.solvers import FitResult


def coefficients(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    rows = [(f.algo, i, f"x{i}", b) for f in fits for i, b in enumerate(f.beta)]
    return spark.createDataFrame(rows, "algo string, idx int, name string, estimate double")


def history(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    """1-based iterations; the loss is the one before that iteration's update."""
    rows = [(f.algo, i, v) for f in fits for i, v in enumerate(f.loss_history, 1)]
    return spark.createDataFrame(rows, "algo string, iteration bigint, loss double")


def summary(spark: SparkSession, fits: Sequence[FitResult]) -> DataFrame:
    rows = [(f.algo, f.iterations, f.status, f.loss_history[-1]) for f in fits]
    return spark.createDataFrame(rows, "algo string, iterations bigint, status string, last_loss double")


def trace(spark: SparkSession, fit: FitResult) -> DataFrame:
    k = len(fit.beta)
    rows = [(i, loss, *b) for i, (loss, b) in enumerate(zip(fit.loss_history, fit.path, strict=True), 1)]
    return spark.createDataFrame(rows, "iteration bigint, loss double, " + ", ".join(f"b{j} double" for j in range(k)))


def against_truth(coefs: DataFrame, truth: DataFrame) -> DataFrame:
    return coefs.join(truth.select("idx", "truth"), "idx").select(
        "algo", "idx", "estimate", "truth", F.abs(F.col("estimate") - F.col("truth")).alias("abs_error"))


def last_loss(hist: DataFrame) -> DataFrame:
    return hist.groupBy("algo").agg(F.max_by("loss", "iteration").alias("last_loss"))


def loss_curves(hist: DataFrame) -> DataFrame:
    """Both series over the 0-based iteration index, ready to plot."""
    return hist.select("algo", (F.col("iteration") - 1).alias("iteration"), "loss")


def progress(spark: SparkSession, fit: FitResult) -> DataFrame:
    """Gradient descent reports iterations 1, 101, 201, ..; Newton 5, 10, ..; never the one that ends the fit early."""
    hist = history(spark, [fit])
    due = (F.col("iteration") - 1) % 100 == 0 if fit.algo == "gd" else F.col("iteration") % 5 == 0
    ended = F.col("iteration") == fit.iterations if fit.status != "max_iter" else F.lit(False)
    return hist.filter(due & ~ended).select("iteration", "loss")


def progress_lines(rows: DataFrame) -> DataFrame:
    return rows.select("iteration", F.format_string("iteration %d: loss %.6f", "iteration", "loss").alias("line"))
