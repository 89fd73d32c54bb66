"""Row-wise building blocks as Column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def linear_predictor(features: Sequence[str], beta: Sequence[float]) -> Column:
    if len(features) != len(beta):
        raise ValueError(f"{len(features)} features but {len(beta)} coefficients")
    return reduce(lambda a, b: a + b, (F.col(f) * F.lit(float(b)) for f, b in zip(features, beta, strict=True)))


def sigmoid(eta: Column) -> Column:
    """Unguarded 1/(1+exp(-eta)): overflow of exp gives exactly 0.0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def log_loss_term(p: Column, y: Column) -> Column:
    """y*ln(p+eps) + (1-y)*ln((1-p)+eps); eps is added inside the log, p is not clipped."""
    y = y.cast("double")
    return y * F.log(p + F.lit(EPS)) + (F.lit(1.0) - y) * F.log((F.lit(1.0) - p) + F.lit(EPS))


def residual(p: Column, y: Column) -> Column:
    return p - y.cast("double")


def irls_weight(p: Column) -> Column:
    """Literal p*(1-p): its saturation for p near 1 is part of Newton's exit behaviour."""
    return p * (F.lit(1.0) - p)


def uniform(tag: str, key: Column, seed: int = 42) -> Column:
    """Counter-based uniform in (0, 1): 52 bits of md5("seed:tag:key"), the same whatever the partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
