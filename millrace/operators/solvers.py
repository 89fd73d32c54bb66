"""Fixed-step gradient descent and undamped Newton-Raphson.

Each iteration records the loss *before* its update; the stop rule is a strict ``<`` on the
L2 length of the step; on convergence the new coefficients are returned. An exactly singular
Hessian ends Newton with the current coefficients, the failed iteration counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .objective import AggObjective, BlocksObjective, Evaluation, batch_sums, checked_count

#: Rows times columns up to which one task may hold the design matrix (16 MB of doubles).
LOCAL_CELLS = 2_000_000
#: Columns up to which the sums of Newton stay one codegen aggregate.
AGG_COLUMNS = 12


@dataclass
class FitResult:
    algo: str
    beta: list[float]
    loss_history: list[float]
    iterations: int
    status: str
    path: list[list[float]] = field(default_factory=list)


def iterate(algo: str, evaluate: Callable[[np.ndarray], Evaluation], beta: Sequence[float], max_iter: int, tol: float, learning_rate: float | None) -> FitResult:
    """The loop of both solvers; learning_rate None means a Newton step."""
    beta = np.array(beta, dtype=float)
    history: list[float] = []
    path: list[list[float]] = []
    status = "max_iter"
    for _ in range(max_iter):
        at = evaluate(beta)
        history.append(float(at.loss))
        if learning_rate is None:
            try:
                step = np.linalg.solve(at.hessian, -at.gradient)
            except np.linalg.LinAlgError:
                status = "singular"
                path.append(beta.tolist())
                break
            new = beta + step
        else:
            new = beta - learning_rate * at.gradient
        length = np.linalg.norm(new - beta)
        beta = new
        path.append(beta.tolist())
        if length < tol:
            status = "converged"
            break
    return FitResult(algo, beta.tolist(), history, len(history), status, path)


def fit_local(df: DataFrame, features: Sequence[str], label: str, n: int, beta: Sequence[float], algo: str, max_iter: int, tol: float, learning_rate: float | None) -> FitResult:
    """The whole loop in one grouped task. The caller has checked the size."""
    names, start = list(features), list(map(float, beta))

    def run(pdf):
        import pandas as pd

        x, y = pdf[names].to_numpy(float), pdf["_label"].to_numpy(float)
        k = len(names)

        def evaluate(b):
            s = batch_sums(x, y, b, learning_rate is None)
            s[0] /= len(y)
            s[1:] /= n
            return Evaluation(s[0], s[1 : 1 + k], s[1 + k :].reshape(k, k) if learning_rate is None else None)

        fit = iterate(algo, evaluate, start, max_iter, tol, learning_rate)
        return pd.DataFrame({"beta": [fit.beta], "history": [fit.loss_history], "status": [fit.status], "path": [[v for b in fit.path for v in b]]})

    row = (df.select(*(F.col(f).cast("double").alias(f) for f in names), F.col(label).cast("double").alias("_label"), F.lit(0).alias("_all"))
           .groupBy("_all").applyInPandas(run, "beta array<double>, history array<double>, status string, path array<double>").first())
    k, flat = len(names), list(row["path"])
    return FitResult(algo, list(row["beta"]), list(row["history"]), len(row["history"]), row["status"], [flat[i : i + k] for i in range(0, len(flat), k)])


def fit(df: DataFrame, features: Sequence[str], label: str, algo: str, *, beta_init=None, learning_rate=None, max_iter: int, tol: float, n: int | None = None, backend: str = "auto") -> FitResult:
    if max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    k = len(features)
    beta = [0.0] * k if beta_init is None else list(map(float, beta_init))
    if len(beta) != k:
        raise ValueError(f"{k} features but {len(beta)} coefficients")
    data = df.select(*features, label)
    rows = checked_count(data, features, label)
    n = rows if n is None else n
    if backend == "auto":
        if rows * (k + 1) <= LOCAL_CELLS and learning_rate is not None:
            backend = "local"
        else:
            backend = "agg" if learning_rate is None and k <= AGG_COLUMNS else "blocks"
    if backend == "local":
        if rows * (k + 1) > LOCAL_CELLS:
            raise ValueError(f"{rows} x {k} is too large for one task; use agg or blocks")
        return fit_local(data, features, label, n, beta, algo, max_iter, tol, learning_rate)
    if backend not in ("agg", "blocks"):
        raise ValueError(f"unknown backend {backend!r}")
    kind = AggObjective if backend == "agg" else BlocksObjective
    objective = kind(data, features, label, n)
    objective.df = objective.df.persist()
    try:
        if backend == "blocks" and n != rows:  # the loss is a mean over rows present, whatever n is
            inner, scale = objective, n / rows
            evaluate = lambda b: (lambda e: Evaluation(e.loss * scale, e.gradient, e.hessian))(inner(b, learning_rate is None))
        else:
            evaluate = lambda b: objective(b, learning_rate is None)
        return iterate(algo, evaluate, beta, max_iter, tol, learning_rate)
    finally:
        objective.df.unpersist()


def fit_gradient_descent(df, features, label, *, beta_init=None, learning_rate=0.5, max_iter=1000, tol=1e-6, n=None, backend="auto") -> FitResult:
    return fit(df, features, label, "gd", beta_init=beta_init, learning_rate=learning_rate, max_iter=max_iter, tol=tol, n=n, backend=backend)


def fit_newton(df, features, label, *, beta_init=None, max_iter=100, tol=1e-6, n=None, backend="auto") -> FitResult:
    return fit(df, features, label, "newton", beta_init=beta_init, max_iter=max_iter, tol=tol, n=n, backend=backend)
