"""Loss, gradient and Hessian of the logistic model as one global aggregate per evaluation.

Three interchangeable backends: ``agg`` (Catalyst sums; map-side partials, one row shuffled
per partition), ``blocks`` (NumPy products per Arrow batch, for wide designs) and ``local``
(the whole loop in one grouped task, in solvers.py, for data with a checked small size).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import irls_weight, linear_predictor, log_loss_term, residual, sigmoid

EPS = 1e-10


@dataclass(frozen=True)
class Evaluation:
    loss: float
    gradient: np.ndarray
    hessian: np.ndarray | None


def checked_count(df: DataFrame, features: Sequence[str], label: str) -> int:
    """Row count after rejecting NULLs: sums would skip them while the divisor would not."""
    bad = F.greatest(*(F.col(c).isNull().cast("int") for c in [*features, label])) if features else F.col(label).isNull().cast("int")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad")).first()
    if not row["n"]:
        raise ValueError("no rows to fit")
    if row["bad"]:
        raise ValueError(f"{row['bad']} rows have a NULL feature or label")
    return row["n"]


def upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


class AggObjective:
    def __init__(self, df: DataFrame, features: Sequence[str], label: str, n: int):
        self.df, self.features, self.label, self.n = df, list(features), label, n

    def frame(self, beta: Sequence[float], hessian: bool) -> DataFrame:
        """One row: loss, g0.., and the upper triangle h_i_j, over p projected once."""
        scored = self.df.select(*self.features, F.col(self.label).cast("double").alias("_y"),
                                sigmoid(linear_predictor(self.features, beta)).alias("_p"))
        p, y, n = F.col("_p"), F.col("_y"), F.lit(float(self.n))
        out = [(-F.avg(log_loss_term(p, y))).alias("loss")]
        out += [(F.sum(residual(p, y) * F.col(f)) / n).alias(f"g{i}") for i, f in enumerate(self.features)]
        if hessian:
            w = irls_weight(p)
            out += [(F.sum(w * F.col(self.features[i]) * F.col(self.features[j])) / n).alias(f"h_{i}_{j}") for i, j in upper(len(self.features))]
        return scored.agg(*out)

    def __call__(self, beta: Sequence[float], hessian: bool) -> Evaluation:
        row, k = self.frame(beta, hessian).first(), len(self.features)
        h = None
        if hessian:
            h = np.zeros((k, k))
            for i, j in upper(k):
                h[i, j] = h[j, i] = row[f"h_{i}_{j}"]
        return Evaluation(row["loss"], np.array([row[f"g{i}"] for i in range(k)]), h)


def batch_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, hessian: bool) -> np.ndarray:
    """Loss, gradient and (flattened) Hessian sums of one batch."""
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-(x @ beta)))
    terms = y * np.log(p + EPS) + (1.0 - y) * np.log((1.0 - p) + EPS)
    parts = [[-terms.sum()], x.T @ (p - y)]
    if hessian:
        parts.append((x.T @ (x * (p * (1.0 - p))[:, None])).ravel())
    return np.concatenate(parts)


#: Tasks that add up the partial sums before the driver does.
ADDERS = 32


class BlocksObjective:
    """Partial sums per task by NumPy, one array a task with the Hessian's upper triangle; they are added up in two steps."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, n: int):
        self.k, self.n = len(features), n
        self.df = df.select(F.array(*features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))

    def __call__(self, beta: Sequence[float], hessian: bool) -> Evaluation:
        b, k = np.asarray(beta, dtype=float), self.k
        triangle = np.triu_indices(k)

        def partial(batches):
            import pyarrow as pa

            total = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    sums = batch_sums(x, batch.column("y").to_numpy(zero_copy_only=False), b, hessian)
                    total = sums if total is None else total + sums
            if total is not None:
                if hessian:
                    total = np.concatenate([total[: 1 + k], total[1 + k :].reshape(k, k)[triangle]])
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

        def added(batches):
            import pyarrow as pa

            parts = [np.array(batch.column("v").to_pylist()).sum(axis=0) for batch in batches if batch.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0)])], names=["v"])

        rows = self.df.mapInArrow(partial, "v array<double>").repartition(ADDERS).mapInArrow(added, "v array<double>").collect()
        sums = np.sum([r["v"] for r in rows], axis=0) / self.n
        full = None
        if hessian:
            full = np.zeros((k, k))
            full[triangle] = sums[1 + k :]
            full += np.triu(full, 1).T
        return Evaluation(float(sums[0]), sums[1 : 1 + k], full)


def gradient_frame(df: DataFrame, features: Sequence[str], label: str, beta: Sequence[float], n: int | None = None) -> DataFrame:
    """idx, grad."""
    n = n or checked_count(df, features, label)
    one = AggObjective(df, features, label, n).frame(beta, hessian=False)
    pairs = F.array(*(F.struct(F.lit(i).alias("idx"), F.col(f"g{i}").alias("grad")) for i in range(len(features))))
    return one.select(F.inline(pairs))


def hessian_frame(df: DataFrame, features: Sequence[str], label: str, beta: Sequence[float], n: int | None = None) -> DataFrame:
    """i, j, h over the full symmetric matrix."""
    n, k = n or checked_count(df, features, label), len(features)
    one = AggObjective(df, features, label, n).frame(beta, hessian=True)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"h_{min(i, j)}_{max(i, j)}").alias("h")) for i in range(k) for j in range(k)))
    return one.select(F.inline(cells))
