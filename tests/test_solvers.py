import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import fit_gradient_descent, fit_newton, gradient_frame, hessian_frame
from millrace.operators.objective import AggObjective, BlocksObjective
from millrace.plans import report
from millrace.sources import synth

CFG = synth.ModelConfig()


@pytest.fixture(scope="module")
def data(spark):
    return synth.dataset(spark, CFG).cache()


def frame(spark, rows):
    return spark.createDataFrame(rows, "x0 double, x1 double, y int")


def test_first_loss_and_history_length(data):
    fit = fit_newton(data, CFG.names, "y")
    assert abs(fit.loss_history[0] - 0.69314718036) < 1e-10
    assert len(fit.loss_history) == fit.iterations == 7 and fit.status == "converged"


def test_newton_and_gd_agree(data):
    gd, nt = fit_gradient_descent(data, CFG.names, "y"), fit_newton(data, CFG.names, "y")
    assert gd.iterations == 976
    assert np.allclose(gd.beta, nt.beta, atol=1e-4)
    assert all(b <= a for a, b in zip(gd.loss_history, gd.loss_history[1:]))


def test_first_newton_step_is_scaled_regression(spark, data):
    fit = fit_newton(data, ["x0", "x5"], "y", max_iter=1)
    r = data.agg(F.regr_slope(F.col("y").cast("double"), F.col("x5")).alias("s"), F.regr_intercept(F.col("y").cast("double"), F.col("x5")).alias("i")).first()
    assert np.allclose(fit.beta, [4 * (r["i"] - 0.5), 4 * r["s"]], atol=1e-9)
    assert fit.status == "max_iter" and fit.iterations == 1


@pytest.mark.parametrize("algo", ["newton", "gd"])
def test_backends_agree(data, algo):
    call = fit_newton if algo == "newton" else fit_gradient_descent
    kwargs = {"max_iter": 4}
    fits = [call(data, CFG.names, "y", backend=b, **kwargs) for b in ("agg", "blocks", "local")]
    for f in fits[1:]:
        assert np.allclose(f.beta, fits[0].beta, atol=1e-9) and np.allclose(f.loss_history, fits[0].loss_history, atol=1e-9)


def test_partitions_do_not_matter(spark):
    a, b = (fit_newton(synth.dataset(spark, CFG).repartition(p), CFG.names, "y").beta for p in (1, 7))
    assert np.allclose(a, b, atol=1e-9)


def test_optimum(spark, data):
    fit = fit_newton(data, CFG.names, "y", tol=1e-10)
    assert max(abs(r["grad"]) for r in gradient_frame(data, CFG.names, "y", fit.beta).collect()) < 1e-9
    h = np.zeros((6, 6))
    for r in hessian_frame(data, CFG.names, "y", fit.beta).collect():
        h[r["i"], r["j"]] = r["h"]
    assert np.allclose(h, h.T) and np.linalg.eigvalsh(h).min() > 0


def test_zero_feature_is_singular_at_once(spark):
    df = frame(spark, [(1.0, 0.0, 0), (1.0, 0.0, 1), (1.0, 0.0, 1)])
    fit = fit_newton(df, ["x0", "x1"], "y", beta_init=[0.25, -1.0])
    assert (fit.status, fit.iterations, fit.beta) == ("singular", 1, [0.25, -1.0])


def test_separable(spark):
    df = frame(spark, [(1.0, -2.0, 0), (1.0, -1.0, 0), (1.0, 1.0, 1), (1.0, 2.0, 1)])
    assert fit_newton(df, ["x0", "x1"], "y", backend="local").status == "singular"
    gd = fit_gradient_descent(df, ["x0", "x1"], "y")
    assert (gd.status, gd.iterations) == ("max_iter", 1000)


@pytest.mark.parametrize("y, newton", [(0, "max_iter"), (1, "singular")])
def test_one_class(spark, y, newton):
    df = frame(spark, [(1.0, 0.0, y)] * 4)
    assert fit_newton(df, ["x0"], "y", backend="local").status == newton
    assert fit_gradient_descent(df, ["x0"], "y").status == "max_iter"


def test_extreme_scores(spark):
    df = frame(spark, [(1.0, 800.0, 0), (1.0, -800.0, 1)])
    for kind in (AggObjective, BlocksObjective):
        at = kind(df, ["x0", "x1"], "y", 2)([0.0, 1.0], True)
        assert math.isfinite(at.loss) and -1.1e-10 <= at.loss <= 23.03


def test_caller_n_scales_gradient_not_loss(spark):
    df = frame(spark, [(1.0, 0.5, 0), (1.0, -1.0, 1)])
    for backend in ("agg", "blocks", "local"):
        a, b = (fit_gradient_descent(df, ["x0", "x1"], "y", n=n, max_iter=1, backend=backend) for n in (2, 4))
        assert np.allclose(a.loss_history, b.loss_history) and np.allclose(a.beta, np.array(b.beta) * 2)


def test_rejections(spark):
    df = frame(spark, [(1.0, None, 0), (1.0, 1.0, 1)])
    with pytest.raises(ValueError, match="NULL"):
        fit_newton(df, ["x0", "x1"], "y")
    with pytest.raises(ValueError, match="NULL"):
        fit_newton(frame(spark, [(1.0, 1.0, None)]), ["x0", "x1"], "y")
    with pytest.raises(ValueError, match="max_iter"):
        fit_newton(df, ["x0"], "y", max_iter=0)
    with pytest.raises(ValueError, match="no rows"):
        fit_newton(df.limit(0), ["x0"], "y")
    with pytest.raises(ValueError, match="coefficients"):
        fit_newton(df, ["x0"], "y", beta_init=[0.0, 0.0])
    with pytest.raises(ValueError, match="backend"):
        fit_newton(df, ["x0"], "y", backend="other")


def test_start_is_untouched_and_progress_skips_the_end(spark, data):
    start = [0.0] * 6
    fit = fit_gradient_descent(data, CFG.names, "y", beta_init=start)
    assert start == [0.0] * 6
    assert [r["iteration"] for r in report.progress(spark, fit).orderBy("iteration").collect()] == [1, 101, 201, 301, 401, 501, 601, 701, 801, 901]
    line = report.progress_lines(report.progress(spark, fit)).orderBy("iteration").first()["line"]
    assert line == "iteration 1: loss 0.693147"
