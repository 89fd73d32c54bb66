"""The named queries of the engine and their SQL twins for an independent engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import irls_weight, linear_predictor, log_loss_term, sigmoid
from ..operators.objective import AggObjective, checked_count, gradient_frame, hessian_frame
from ..operators.solvers import fit_gradient_descent, fit_newton
from ..sources import bindings, synth
from . import report

CFG = synth.ModelConfig()
NAMES = CFG.names
#: Where gradient, Hessian and row scores are evaluated.
PROBE = (0.2, 0.5, -0.5, 0.4, 0.3, 1.0)
PROBE_LINEITEM = (0.1, 0.5, -0.5, 0.6, 0.5)
#: Decimals that two engines' sums agree on.
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS decimals, without a negative zero."""
    return df.select(*((F.round(F.col(c), DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def data(spark: SparkSession) -> DataFrame:
    return synth.dataset(spark, CFG)


def scored(spark: SparkSession, value) -> DataFrame:
    p = sigmoid(linear_predictor(NAMES, PROBE))
    return rounded(data(spark).select("id", value(p).alias("value")))


def synth_fits(spark: SparkSession, *algos: str):
    df = data(spark)
    fits = {"gd": lambda: fit_gradient_descent(df, NAMES, "y"), "newton": lambda: fit_newton(df, NAMES, "y")}
    return [fits[a]() for a in algos]


def both_fits(spark: SparkSession):
    """Both solvers on the same six coefficients, with the reference settings."""
    return synth_fits(spark, "gd", "newton")


def binding_newton(binding: bindings.Binding, spark: SparkSession, tol: float = 1e-10) -> DataFrame:
    fit = fit_newton(binding.df, binding.features, binding.label, tol=tol)
    return rounded(report.coefficients(spark, [fit]).select("idx", "estimate"))


def step_norm(spark: SparkSession) -> DataFrame:
    """Length of the first gradient step from zero."""
    step = gradient_frame(data(spark), NAMES, "y", [0.0] * len(NAMES), n=CFG.n)
    return rounded(step.agg(F.sqrt(F.sum(F.pow(F.lit(0.5) * F.col("grad"), F.lit(2.0)))).alias("norm")))


def singular(spark: SparkSession) -> DataFrame:
    df = data(spark).select("x0", F.lit(0.0).alias("x1"), "y")
    return report.summary(spark, [fit_newton(df, ["x0", "x1"], "y")]).select("status", "iterations")


def wide_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bindings.embeddings_binary(spark, sf_dir)
    fit = fit_newton(b.df, b.features, b.label, backend="blocks")
    return rounded(report.coefficients(spark, [fit]).select("idx", "estimate"))


def wide_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient, by the ``agg`` expressions, where the ``blocks`` fit ended: zero only at the one optimum."""
    b = bindings.embeddings_binary(spark, sf_dir)
    fit = fit_newton(b.df, b.features, b.label, backend="blocks", tol=1e-9)
    return rounded(gradient_frame(b.df, b.features, b.label, fit.beta))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    gd_cols = ["idx", "estimate", "iterations"]
    return {
        "corr_matrix": lambda s, d: rounded(synth.corr_matrix(s, CFG)),
        "truth_table": lambda s, d: synth.truth_table(s, CFG),
        "synth_features": lambda s, d: rounded(synth.features(s, CFG)),
        "design_matrix": lambda s, d: rounded(synth.design_matrix(s, CFG)),
        "linear_predictor": lambda s, d: rounded(data(s).select("id", linear_predictor(NAMES, PROBE).alias("value"))),
        "sigmoid_scores": lambda s, d: scored(s, lambda p: p),
        "row_log_loss": lambda s, d: scored(s, lambda p: log_loss_term(p, F.col("y"))),
        "irls_weights": lambda s, d: scored(s, irls_weight),
        "bernoulli_label": lambda s, d: data(s).select("id", "y"),
        "label_rate": lambda s, d: data(s).agg(F.round(F.avg("y"), 3).alias("rate")),
        "log_loss": lambda s, d: rounded(AggObjective(data(s), NAMES, "y", CFG.n).frame(PROBE, False).select("loss")),
        "gradient_at_beta": lambda s, d: rounded(gradient_frame(data(s), NAMES, "y", PROBE)),
        "hessian_at_beta": lambda s, d: rounded(hessian_frame(data(s), NAMES, "y", PROBE)),
        "step_norm": lambda s, d: step_norm(s),
        "gd_trace_25": lambda s, d: rounded(report.trace(s, fit_gradient_descent(data(s), NAMES, "y", max_iter=25))),
        "gd_fit": lambda s, d: rounded(report.coefficients(s, f := synth_fits(s, "gd")).withColumn("iterations", F.lit(f[0].iterations).cast("bigint")).select(*gd_cols)),
        "newton_trace": lambda s, d: rounded(report.trace(s, *synth_fits(s, "newton"))),
        "newton_trace_2": lambda s, d: rounded(report.trace(s, fit_newton(data(s), ["x0", "x5"], "y"))),
        "newton_fit": lambda s, d: rounded(report.coefficients(s, f := synth_fits(s, "newton")).withColumn("iterations", F.lit(f[0].iterations).cast("bigint")).select(*gd_cols)),
        "newton_singular": lambda s, d: singular(s),
        "fit_summary": lambda s, d: rounded(report.summary(s, both_fits(s))),
        "estimates_vs_truth": lambda s, d: rounded(report.against_truth(report.coefficients(s, both_fits(s)), synth.truth_table(s, CFG))),
        "last_loss": lambda s, d: rounded(report.last_loss(report.history(s, both_fits(s)))),
        "progress_gd": lambda s, d: rounded(report.progress(s, synth_fits(s, "gd")[0])),
        "progress_newton": lambda s, d: rounded(report.progress(s, *synth_fits(s, "newton"))),
        "loss_curves": lambda s, d: rounded(report.loss_curves(report.history(s, both_fits(s)))),
        "lineitem_planted_label_rate": lambda s, d: bindings.lineitem_planted(s, d).df.agg(F.sum("y").cast("bigint").alias("positives"), F.count("y").alias("n")),
        "lineitem_planted_gradient": lambda s, d: rounded(gradient_frame(*(lambda b: (b.df, b.features, b.label))(bindings.lineitem_planted(s, d)), PROBE_LINEITEM)),
        "lineitem_planted_hessian": lambda s, d: rounded(hessian_frame(*(lambda b: (b.df, b.features, b.label))(bindings.lineitem_planted(s, d)), PROBE_LINEITEM)),
        "lineitem_planted_newton": lambda s, d: binding_newton(bindings.lineitem_planted(s, d), s),
        "labels_quality_newton": lambda s, d: binding_newton(bindings.labels_quality(s, d), s),
        "embeddings_binary_newton": wide_evaluation,
        "embeddings_binary_optimum": wide_optimum,
    }


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding_newton(bindings.lineitem_planted(spark, sf_dir), spark)


# ---- SQL twins ----

def _d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _u(tag: str, key: str) -> str:
    return f"((CAST(('0x' || substr(md5('42:{tag}:' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT) + {_d(0.5)}) / {_d(float(2**52))})"


def _eta(names, beta) -> str:
    return " + ".join(f"{n} * {_d(float(b))}" for n, b in zip(names, beta, strict=True))


def _sig(eta: str) -> str:
    return f"(1e0 / (1e0 + exp(-({eta}))))"


def _r(e: str) -> str:
    return f"round({e}, {DIGITS}) + 0e0"


def _synth_ctes() -> str:
    z = [f"sqrt(-2e0 * ln({_u(f'a{j}', 'id')})) * cos({_d(6.283185307179586)} * {_u(f'b{j}', 'id')}) AS z{j}" for j in range(1, 6)]
    steps, prev = [], "zs"
    for j in range(1, 6):
        x = "z1" if j == 1 else f"{_d(0.2)} * x{j - 1} + {_d((1 - 0.2 * 0.2) ** 0.5)} * z{j}"
        steps.append(f"f{j} AS (SELECT *, {x} AS x{j} FROM {prev})")
        prev = f"f{j}"
    return (f"zs AS (SELECT id, {', '.join(z)} FROM (SELECT range AS id FROM range({CFG.n}))), " + ", ".join(steps)
            + ", design AS (SELECT id, 1e0 AS x0, x1, x2, x3, x4, x5 FROM f5), "
            + f"scored AS (SELECT *, {_sig(_eta(NAMES, CFG.beta))} AS p FROM design), "
            + f"data AS MATERIALIZED (SELECT *, CASE WHEN {_u('y', 'id')} < p THEN 1 ELSE 0 END AS y FROM scored)")


def _lineitem_ctes() -> str:
    xs = ", ".join(f"({c} - {_d(m)}) / {_d(s)} AS x{j}" for j, (c, m, s) in enumerate(bindings.LINEITEM_SCALING, 1))
    key = " || '-' || ".join(f"CAST({c} AS VARCHAR)" for c in bindings.LINEITEM_KEYS)
    names = [f"x{j}" for j in range(5)]
    return (f"base AS (SELECT {key} AS key, 1e0 AS x0, {xs} FROM lineitem), "
            f"data AS MATERIALIZED (SELECT {', '.join(names)}, CASE WHEN {_u('y', 'key')} < {_sig(_eta(names, bindings.LINEITEM_TRUTH))} THEN 1 ELSE 0 END AS y FROM base)")


def _term(p: str = "pr") -> str:
    return f"(y * ln({p} + 1e-10) + (1 - y) * ln((1 - {p}) + 1e-10))"


def _gd_cte(names, lr: float, max_iter: int, tol: float, name: str = "gd") -> str:
    """Gradient descent as a recursive CTE over ``data``: it, loss (pre-update), b0.., step."""
    k = len(names)
    bs = [f"b{i}" for i in range(k)]
    eta = " + ".join(f"d.{n} * g.{b}" for n, b in zip(names, bs, strict=True))
    new = ", ".join(f"{b} - {_d(lr)} * g{i}" for i, b in enumerate(bs))
    step = " + ".join(f"pow({_d(lr)} * g{i}, 2)" for i in range(k))
    grads = ", ".join(f"sum((pr - y) * {n}) / count(*) AS g{i}" for i, n in enumerate(names))
    return (f"{name}(it, loss, {', '.join(bs)}, step) AS (SELECT CAST(0 AS BIGINT), 0e0, {', '.join(['0e0'] * k)}, 1e300 UNION ALL "
            f"SELECT it + 1, loss, {new}, sqrt({step}) FROM (SELECT it, {', '.join(bs)}, -avg({_term()}) AS loss, {grads} FROM "
            f"(SELECT g.*, d.*, {_sig(eta)} AS pr FROM (SELECT it, {', '.join(bs)}, step FROM {name}) g, data d WHERE g.it < {max_iter} AND g.step >= {_d(tol)}) t GROUP BY it, {', '.join(bs)}) s)")


def _newton_cte(names, max_iter: int, tol: float, name: str = "nt") -> str:
    """Newton as a recursive CTE over ``data``: it, loss (pre-update), b0.., step. The symmetric system is solved by elimination, a subquery a pivot."""
    k = len(names)
    bs, gs = [f"b{i}" for i in range(k)], [f"g{i}" for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    eta = " + ".join(f"d.{n} * g.{b}" for n, b in zip(names, bs, strict=True))
    sums = [f"avg((pr - y) * {n}) AS g{i}" for i, n in enumerate(names)] + [f"avg(pr * (1 - pr) * {names[i]} * {names[j]}) AS h{i}_{j}" for i, j in cells]
    inner = (f"SELECT it, {', '.join(bs)}, -avg({_term()}) AS loss, {', '.join(sums)} FROM (SELECT g.*, d.*, {_sig(eta)} AS pr FROM (SELECT it, {', '.join(bs)}, step FROM {name}) g, data d "
             f"WHERE g.it < {max_iter} AND g.step >= {_d(tol)}) t GROUP BY it, {', '.join(bs)}")
    head = f"it, {', '.join(bs)}, loss"
    for p in range(k - 1):  # forward: row p leaves the rows below it
        g = [f"g{i}" if i <= p else f"g{i} - h{p}_{i} / h{p}_{p} * g{p} AS g{i}" for i in range(k)]
        h = [f"h{i}_{j}" if i <= p else f"h{i}_{j} - h{p}_{i} / h{p}_{p} * h{p}_{j} AS h{i}_{j}" for i, j in cells]
        inner = f"SELECT {head}, {', '.join(g + h)} FROM ({inner}) e{p}"
    for p in range(k - 1, -1, -1):  # back: the step's components from the last to the first
        known = "".join(f" - h{p}_{j} * s{j}" for j in range(p + 1, k))
        inner = f"SELECT *, (g{p}{known}) / h{p}_{p} AS s{p} FROM ({inner}) r{p}"
    new, length = ", ".join(f"b{i} - s{i}" for i in range(k)), " + ".join(f"s{i} * s{i}" for i in range(k))
    return (f"{name}(it, loss, {', '.join(bs)}, step) AS (SELECT CAST(0 AS BIGINT), 0e0, {', '.join(['0e0'] * k)}, 1e300 UNION ALL "
            f"SELECT it + 1, loss, {new}, sqrt({length}) FROM ({inner}) s)")


def _final(cte: str, k: int, algo: str | None = None) -> str:
    """idx, estimate of the last iteration."""
    head = f"'{algo}' AS algo, " if algo else ""
    return " UNION ALL ".join(f"SELECT {head}{i} AS idx, b{i} AS estimate, it AS iterations FROM {cte} WHERE it = (SELECT max(it) FROM {cte})" for i in range(k))


def oracle_sql() -> dict[str, str]:
    s, li = _synth_ctes(), _lineitem_ctes()
    gd, nt = _gd_cte(NAMES, 0.5, 1000, 1e-6), _newton_cte(NAMES, 100, 1e-6)
    probed = f"(SELECT *, {_sig(_eta(NAMES, PROBE))} AS pr FROM data)"
    li_names = NAMES[:5]
    li_probed = f"(SELECT *, {_sig(_eta(li_names, PROBE_LINEITEM))} AS pr FROM data)"
    rec, both = f"WITH RECURSIVE {s}, {gd} ", f"WITH RECURSIVE {s}, {gd}, {nt}, "
    hist = "hist AS (SELECT 'gd' AS algo, it AS iteration, loss FROM gd WHERE it > 0 UNION ALL SELECT 'newton', it, loss FROM nt WHERE it > 0) "
    bs = ", ".join(f"{_r(f'b{i}')} AS b{i}" for i in range(6))

    def grads(names, src):
        return " UNION ALL ".join(f"SELECT {i} AS idx, {_r(f'sum((pr - y) * {n}) / count(*)')} AS grad FROM {src}" for i, n in enumerate(names))

    def hess(names, src):
        return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {_r(f'sum(pr * (1 - pr) * {a} * {b}) / count(*)')} AS h FROM {src}" for i, a in enumerate(names) for j, b in enumerate(names))

    def newton_by_gd(ctes, names):
        return f"WITH RECURSIVE {ctes}, {_gd_cte(names, 3.0, 5000, 1e-11)} SELECT idx, {_r('estimate')} AS estimate FROM ({_final('gd', len(names))})"

    quality = ("data AS MATERIALIZED (SELECT 1e0 AS x0, ln(1e0 + n_chars) - 7e0 AS x1, CASE WHEN lang = 'en' THEN 1e0 ELSE 0e0 END AS x2, quality AS y "
               "FROM labels JOIN documents USING (doc_id))")
    truth = "(VALUES " + ", ".join(f"({i}, 'x{i}', {_d(b)})" for i, b in enumerate(CFG.beta)) + ") t(idx, name, truth)"
    return {
        "corr_matrix": f"SELECT CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j, {_r('pow(' + _d(0.2) + ', abs(i.range - j.range))')} AS sigma FROM range(5) i, range(5) j",
        "truth_table": f"SELECT idx, name, truth FROM {truth}",
        "synth_features": f"WITH {s} SELECT id, " + ", ".join(f"{_r(n)} AS {n}" for n in NAMES[1:]) + " FROM design",
        "design_matrix": f"WITH {s} SELECT id, " + ", ".join(f"{_r(n)} AS {n}" for n in NAMES) + " FROM design",
        "linear_predictor": f"WITH {s} SELECT id, {_r(_eta(NAMES, PROBE))} AS value FROM data",
        "sigmoid_scores": f"WITH {s} SELECT id, {_r('pr')} AS value FROM {probed}",
        "row_log_loss": f"WITH {s} SELECT id, {_r(_term())} AS value FROM {probed}",
        "irls_weights": f"WITH {s} SELECT id, {_r('pr * (1 - pr)')} AS value FROM {probed}",
        "bernoulli_label": f"WITH {s} SELECT id, y FROM data",
        "label_rate": f"WITH {s} SELECT round(avg(y), 3) AS rate FROM data",
        "log_loss": f"WITH {s} SELECT {_r(f'-avg({_term()})')} AS loss FROM {probed}",
        "gradient_at_beta": f"WITH {s} " + grads(NAMES, probed),
        "hessian_at_beta": f"WITH {s} " + hess(NAMES, probed),
        "step_norm": f"WITH {s} SELECT {_r('sqrt(' + ' + '.join(f'pow(0.5e0 * g{i}, 2)' for i in range(6)) + ')')} AS norm FROM (SELECT " + ", ".join(f"sum((0.5e0 - y) * {n}) / count(*) AS g{i}" for i, n in enumerate(NAMES)) + " FROM data)",
        "gd_trace_25": f"WITH RECURSIVE {s}, {_gd_cte(NAMES, 0.5, 25, 1e-6)} SELECT it AS iteration, {_r('loss')} AS loss, {bs} FROM gd WHERE it > 0",
        "gd_fit": rec + f"SELECT idx, {_r('estimate')} AS estimate, iterations FROM ({_final('gd', 6)})",
        "newton_trace": f"WITH RECURSIVE {s}, {nt} SELECT it AS iteration, {_r('loss')} AS loss, {bs} FROM nt WHERE it > 0",
        "newton_trace_2": f"WITH RECURSIVE {s}, {_newton_cte(['x0', 'x5'], 100, 1e-6)} SELECT it AS iteration, {_r('loss')} AS loss, {_r('b0')} AS b0, {_r('b1')} AS b1 FROM nt WHERE it > 0",
        "newton_fit": f"WITH RECURSIVE {s}, {nt} SELECT idx, {_r('estimate')} AS estimate, iterations FROM ({_final('nt', 6)})",
        "newton_singular": "SELECT 'singular' AS status, CAST(1 AS BIGINT) AS iterations",
        "fit_summary": both + hist + f"SELECT algo, max(iteration) AS iterations, 'converged' AS status, {_r('arg_max(loss, iteration)')} AS last_loss FROM hist GROUP BY algo",
        "estimates_vs_truth": f"WITH RECURSIVE {s}, {gd}, {nt} SELECT algo, e.idx, {_r('estimate')} AS estimate, {_r('truth')} AS truth, {_r('abs(estimate - truth)')} AS abs_error FROM ({_final('gd', 6, 'gd')} UNION ALL {_final('nt', 6, 'newton')}) e JOIN {truth} ON e.idx = t.idx",
        "last_loss": both + hist + f"SELECT algo, {_r('arg_max(loss, iteration)')} AS last_loss FROM hist GROUP BY algo",
        "progress_gd": rec + f"SELECT it AS iteration, {_r('loss')} AS loss FROM gd WHERE it > 0 AND (it - 1) % 100 = 0 AND NOT (step < 1e-6)",
        "progress_newton": f"WITH RECURSIVE {s}, {nt} SELECT it AS iteration, {_r('loss')} AS loss FROM nt WHERE it > 0 AND it % 5 = 0 AND NOT (step < 1e-6)",
        "loss_curves": both + hist + f"SELECT algo, iteration - 1 AS iteration, {_r('loss')} AS loss FROM hist",
        "lineitem_planted_label_rate": f"WITH {li} SELECT CAST(sum(y) AS BIGINT) AS positives, count(*) AS n FROM data",
        "lineitem_planted_gradient": f"WITH {li} " + grads(li_names, li_probed),
        "lineitem_planted_hessian": f"WITH {li} " + hess(li_names, li_probed),
        "lineitem_planted_newton": newton_by_gd(li, li_names),
        "labels_quality_newton": newton_by_gd(quality, NAMES[:3]),
        "embeddings_binary_optimum": "SELECT CAST(range AS INTEGER) AS idx, 0e0 AS grad FROM range(65)",
    }
