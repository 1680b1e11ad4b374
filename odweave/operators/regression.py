"""Least squares, its diagnostics, and spatial lag and error models.

The cluster reduces rows to cross-products (one aggregate a pass, of columns centred and scaled so that the products are
well conditioned, and summed so that the order of rows does not matter); the driver solves k x k systems.  Of the data, only the edges of up
to EXACT_EIGENVALUES areas are collected, for the log-determinant.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odweave.functions import distributions as D
from odweave.operators import elimination, exact, spatial
from odweave.operators.quality import complete_cases
from odweave.storage import release, stored


def cross_products(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """[k, k] sums of products of the columns: one aggregate of their bounds and one of sums that are the same for any order of rows."""
    k = len(columns)
    df = df.select(*(c.cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))
    n, bounds = exact.column_bounds(df, {c: F.col(c) for c in df.columns})
    reach = [max(abs(low), abs(high)) for low, high in bounds.values()]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    sums = exact.exact_sums(df, {f"_{a}_{b}": (F.col(f"_c{a}") * F.col(f"_c{b}"), reach[a] * reach[b]) for a, b in pairs}, n)
    m = np.zeros((k, k))
    for a, b in pairs:
        m[a, b] = m[b, a] = sums[f"_{a}_{b}"]
    return m


@dataclass
class Fit:
    """A fitted linear model: coefficients (constant first), covariances, metrics, and the columns it is made of."""

    response: str
    predictors: list[str]
    beta: np.ndarray
    cov: np.ndarray
    robust: np.ndarray
    n: int
    ssr: float
    sst: float
    data: DataFrame = field(repr=False)
    inverse: np.ndarray = field(repr=False)
    centre: np.ndarray = field(repr=False)
    scale: np.ndarray = field(repr=False)
    mae: float = 0.0

    @property
    def k(self) -> int:
        return len(self.beta)

    def fitted(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for b, x in zip(self.beta[1:], self.predictors, strict=True):
            out = out + F.lit(float(b)) * F.col(x)
        return out

    def residual(self) -> Column:
        return F.col(self.response) - self.fitted()

    def leverage(self) -> Column:
        z = [F.lit(1.0)] + [(F.col(x) - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(self.predictors, self.centre, self.scale, strict=True)]
        out = F.lit(0.0)
        for a in range(self.k):
            for b in range(self.k):
                out = out + F.lit(float(self.inverse[a, b])) * z[a] * z[b]
        return out

    def metrics(self) -> dict[str, float]:
        n, k = self.n, self.k
        r2 = 1 - self.ssr / self.sst
        ll = -n / 2 * (math.log(2 * math.pi) + math.log(self.ssr / n) + 1) if self.ssr > 0 else math.inf
        f = (self.sst - self.ssr) / max(k - 1, 1) / (self.ssr / (n - k)) if self.ssr > 0 and n > k else math.inf
        return {
            "n": n, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k) if n > k else math.nan, "rmse": math.sqrt(self.ssr / n), "mae": self.mae, "ssr": self.ssr,
            "log_likelihood": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(n) - 2 * ll, "f_statistic": f, "f_p_value": D.f_upper(f, max(k - 1, 1), n - k) if n > k and math.isfinite(f) else 0.0,
            "df_model": k - 1, "df_resid": n - k, "residual_standard_error": math.sqrt(self.ssr / (n - k)) if n > k else math.nan,
        }

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """(term, estimate, std_error, t, p, robust_se, robust_t, robust_p, low, high, std_beta): HC3 and 95% interval."""
        df = self.n - self.k
        crit = D.t_quantile(0.05, df)
        sy = math.sqrt(self.sst / self.n)
        rows = []
        for i, name in enumerate(["const", *self.predictors]):
            b, se, hc = float(self.beta[i]), math.sqrt(max(self.cov[i, i], 0)), math.sqrt(max(self.robust[i, i], 0))
            t, rt = b / se if se else math.inf, b / hc if hc else math.inf
            beta = b * float(self.scale[i - 1]) / sy if i and sy else None
            rows.append((name, b, se, t, D.t_two_sided(t, df), hc, rt, D.t_two_sided(rt, df), b - crit * hc, b + crit * hc, beta))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t double, p double, robust_se double, robust_t double, robust_p double, low double, high double, std_beta double")


def fit_ols(df: DataFrame, response: str, predictors: list[str]) -> Fit:
    """OLS with a constant and HC3 covariance over complete finite cases.  Moments, products, and the leverage-weighted squares of
    the residuals are two aggregates each; all sums are the same for any order of rows."""
    data = complete_cases(df, [response, *predictors])
    cols = [response, *predictors]
    n, means, sds = exact.moments(data, cols)
    mean, sd = np.array([means[c] for c in cols]), np.array([sds[c] for c in cols])
    if not n or n <= len(predictors):
        raise ValueError(f"{n} complete rows for {len(predictors)} predictors")
    sd[sd == 0] = 1.0
    z = [F.lit(1.0)] + [(F.col(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(predictors, mean[1:], sd[1:], strict=True)]
    y = (F.col(response) - F.lit(float(mean[0]))) / F.lit(float(sd[0]))
    g = cross_products(data, [*z, y])
    inv = np.linalg.inv(g[:-1, :-1])
    b = inv @ g[:-1, -1]
    to = np.zeros((len(b), len(b)))  # from standardised to original coefficients
    to[0, 0] = sd[0]
    for i in range(1, len(b)):
        to[i, i] = sd[0] / sd[i]
        to[0, i] = -sd[0] * mean[i] / sd[i]
    beta = to @ b
    beta[0] += mean[0]
    ssr = max(float(g[-1, -1] - b @ g[:-1, -1]), 0.0) * sd[0] ** 2
    sst = float(g[-1, -1]) * sd[0] ** 2
    fit = Fit(response, predictors, beta, np.zeros((len(b), len(b))), np.zeros((len(b), len(b))), n, ssr, sst, data, inv, mean[1:], sd[1:])
    e = fit.residual() / F.lit(float(sd[0]))
    h = F.least(fit.leverage(), F.lit(1 - 1e-12))
    w = data.select(*(c.alias(f"_z{i}") for i, c in enumerate(z)), e.alias("_e"), h.alias("_h"))
    u = F.col("_e") / (1 - F.col("_h"))
    meat = cross_products(w, [*(F.col(f"_z{i}") * u for i in range(len(z))), F.sqrt(F.abs("_e")), F.col("_e")])
    fit.mae = float(meat[len(z), len(z)]) / n * sd[0]
    fit.ssr = float(meat[-1, -1]) * sd[0] ** 2
    s2 = fit.ssr / max(n - len(b), 1) / sd[0] ** 2
    fit.cov = to @ (inv * s2) @ to.T
    fit.robust = to @ inv @ meat[: len(z), : len(z)] @ inv @ to.T
    return fit


def compare(models: dict[str, Fit], spark: SparkSession) -> DataFrame:
    names = ["n", "r2", "adj_r2", "rmse", "mae", "log_likelihood", "aic", "bic"]
    return spark.createDataFrame([(k, *(float(f.metrics()[x]) for x in names)) for k, f in models.items()], "model string, " + ", ".join(f"{x} double" for x in names))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    ssr, n = F.sum((a - p) * (a - p)), F.count("*")
    return df.agg(n.alias("n"), (1 - ssr / (F.var_pop(a) * n)).alias("r2"), F.sqrt(ssr / n).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"))


def diagnostics(fit: Fit) -> dict[str, float]:
    """Jarque-Bera, Breusch-Pagan (studentised), RESET of power 2, and the largest internally studentised residual."""
    d = fit.data.withColumns({"_e": fit.residual(), "_f": fit.fitted(), "_h": fit.leverage()})
    s2 = fit.ssr / (fit.n - fit.k)
    m = d.agg(F.skewness("_e").alias("s"), F.kurtosis("_e").alias("k"), F.max(F.abs(F.col("_e")) / F.sqrt(F.lit(s2) * (1 - F.col("_h")))).alias("t")).first()
    jb = fit.n / 6 * (m["s"] ** 2 + m["k"] ** 2 / 4)
    q = len(fit.predictors)
    bp = fit_ols(d.withColumn("_e2", F.col("_e") * F.col("_e")), "_e2", fit.predictors).metrics()
    full = fit_ols(d.withColumn("_f2", F.col("_f") * F.col("_f")), fit.response, [*fit.predictors, "_f2"])
    df = fit.n - full.k
    reset = (fit.ssr - full.ssr) / (full.ssr / df) if full.ssr else math.nan
    lm = fit.n * bp["r2"]
    return {
        "jarque_bera": jb, "jarque_bera_p": D.chi2_upper(jb, 2), "skewness": m["s"], "kurtosis": m["k"] + 3, "breusch_pagan": lm, "breusch_pagan_p": D.chi2_upper(lm, q),
        "breusch_pagan_f": bp["f_statistic"], "breusch_pagan_f_p": bp["f_p_value"], "reset_f": reset, "reset_p": D.f_upper(reset, 1, df), "max_abs_studentised": m["t"],
    }


# --- spatial tests and models ---------------------------------------------------------------


def trace_term(weights: DataFrame) -> float:
    """tr(W'W + WW) from the edge table."""
    back = weights.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("v"))
    r = weights.join(back, ["i", "j"], "left").agg(F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("v", F.lit(0.0)))).first()
    return float(r[0] or 0.0)


def lm_tests(fit: Fit, weights: DataFrame, key: str) -> dict[str, tuple[float, float, int]]:
    """Lagrange multiplier tests for spatial lag and error, their robust forms, and the joint one: statistic, p, degrees."""
    d = fit.data.withColumns({"_e": fit.residual(), "_f": fit.fitted()})
    x = fit.predictors
    d = spatial.lag(d, weights, key, ["_e", "_f", fit.response])
    z = [F.lit(1.0)] + [(F.col(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(x, fit.centre, fit.scale, strict=True)]
    g = cross_products(d, [*z, F.col("lag__f"), F.col("_e"), F.col("lag__e"), F.col(f"lag_{fit.response}")])
    k = len(z)
    s2 = fit.ssr / fit.n
    t = trace_term(weights)
    wf = g[k, k] - g[:k, k] @ fit.inverse @ g[:k, k]  # (W X b)' M (W X b)
    d_error, d_lag = g[k + 1, k + 2] / s2, g[k + 1, k + 3] / s2
    nj = wf / s2 + t
    error, lag = d_error**2 / t, d_lag**2 / nj
    robust_error = (d_error - t / nj * d_lag) ** 2 / (t * (1 - t / nj))
    robust_lag = (d_lag - d_error) ** 2 / (nj - t)
    p = lambda v, q: (float(v), D.chi2_upper(float(v), q), q)
    return {"LM-lag": p(lag, 1), "LM-error": p(error, 1), "Robust LM-lag": p(robust_lag, 1), "Robust LM-error": p(robust_error, 1), "LM-SARMA": p(robust_lag + error, 2)}


#: Areas up to which the eigenvalues of the weights are computed on the driver: a dense matrix of this side and the solver's copy are 420 MB
#: at most.  Points of the interpolant beyond.
EXACT_EIGENVALUES, POINTS = 5120, 64


class LogDeterminant:
    """rho -> ln |I - rho W| with its first two derivatives, from eigenvalues or from a polynomial.  ``error`` bounds what is left open
    (0 where it is exact)."""

    def __init__(self, value: Callable[[float], float], slope: Callable[[float], float], curvature: Callable[[float], float], error: Callable[[float], float] = lambda rho: 0.0):
        self.value, self.slope, self.curvature, self.error = value, slope, curvature, error

    def __call__(self, rho: float) -> float:
        return self.value(rho)

    @classmethod
    def of_eigenvalues(cls, e: np.ndarray) -> LogDeterminant:
        return cls(lambda r: float(np.log1p(-r * e).sum()), lambda r: -float((e / (1 - r * e)).sum()), lambda r: -float(((e / (1 - r * e)) ** 2).sum()))

    @classmethod
    def of_values(cls, at: np.ndarray, values: np.ndarray, low: float, high: float) -> LogDeterminant:
        """The Chebyshev interpolant of values at the interval's Chebyshev points; its last terms tell its error."""
        from numpy.polynomial import Chebyshev

        f = Chebyshev.fit(at, values, len(at) - 1, domain=[low, high])
        d, dd = f.deriv(), f.deriv(2)
        rest = float(np.abs(f.coef[-4:]).max()) * 4
        return cls(lambda r: float(f(r)), lambda r: float(d(r)), lambda r: float(dd(r)), lambda r: rest)


def log_determinant(weights: DataFrame, n: int, bounds: tuple[float, float] = (-0.95, 0.95)) -> LogDeterminant:
    """ln |I - rho W| of row-standardised symmetric contiguity.  Up to EXACT_EIGENVALUES areas from the eigenvalues of a dense matrix, for
    which all edges go to the driver; beyond, by distributed elimination at POINTS Chebyshev points between the bounds (the function is
    analytic for |rho| < 1: with bounds of 0.95, the interpolant's error is about 1.38 ** -POINTS of the function's size)."""
    if n <= EXACT_EIGENVALUES:
        rows = weights.select("i", "j").collect()
        ids = {v: k for k, v in enumerate(sorted({r["i"] for r in rows} | {r["j"] for r in rows}))}
        a = np.zeros((len(ids), len(ids)))
        for r in rows:
            a[ids[r["i"]], ids[r["j"]]] = 1.0
        root = 1 / np.sqrt(np.maximum(a.sum(1), 1))
        a *= root[:, None]
        a *= root[None]
        return LogDeterminant.of_eigenvalues(np.linalg.eigvalsh(a))
    low, high = bounds
    at = (low + high) / 2 + (high - low) / 2 * np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS)
    return LogDeterminant.of_values(at, elimination.log_determinants(weights, at), low, high)


def minimise(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9) -> tuple[float, bool]:
    """Golden-section search to an interval of length tol: its middle, and whether that is inside the bounds."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a >= tol:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    x = (a + b) / 2
    return x, low + 1e-6 < x < high - 1e-6 or abs(high - low) < 1e-6


@dataclass
class SpatialFit:
    kind: str
    response: str
    predictors: list[str]
    beta: np.ndarray
    se: np.ndarray
    spatial: float
    spatial_se: float
    sigma2: float
    log_likelihood: float
    n: int
    rmse: float
    mae: float
    converged: bool
    log_determinant_error: float = 0.0

    @property
    def k(self) -> int:
        """Coefficients with constant, the spatial parameter, and the variance."""
        return len(self.beta) + 2

    @property
    def aic(self) -> float:
        return 2 * self.k - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return self.k * math.log(self.n) - 2 * self.log_likelihood

    def inference(self, spark: SparkSession) -> DataFrame:
        name = "rho" if self.kind == "SAR" else "lambda"
        rows = []
        for t, b, s in [*zip(["const", *self.predictors], self.beta, self.se, strict=True), (name, self.spatial, self.spatial_se)]:
            z = float(b / s) if s else math.inf
            rows.append((t, float(b), float(s), z, D.normal_two_sided(z)))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")


@dataclass
class Products:
    """What the likelihoods of both models need of the rows: products of centred and scaled columns, and the log-determinant.

    Rows without neighbours have lag 0, so a column's constant part m becomes m (1 - r one) under the filter, where one marks rows with neighbours.
    """

    n: int
    mean: np.ndarray
    sd: np.ndarray
    my: float
    sy: float
    share: float
    g: np.ndarray
    logdet: LogDeterminant


def _products(data: DataFrame, weights: DataFrame, response: str, predictors: list[str], bounds: tuple[float, float]) -> Products:
    n, means, sds = exact.moments(data, [*predictors, response, "_one"])
    mean, sd = (np.array([x[c] for c in predictors]) for x in (means, sds))
    sd[sd == 0] = 1.0
    my, sy, share = means[response], sds[response] or 1.0, means["_one"]
    z = [(F.col(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip([*predictors, response], [*mean, my], [*sd, sy], strict=True)]
    wz = [(F.col(f"lag_{c}") - F.lit(float(a)) * F.col("_one")) / F.lit(float(s)) for c, a, s in zip([*predictors, response], [*mean, my], [*sd, sy], strict=True)]
    g = cross_products(data, [F.lit(1.0), *z[:-1], F.col("_one") - F.lit(share), *wz[:-1], z[-1], wz[-1]])
    return Products(n, mean, sd, my, sy, share, g, log_determinant(weights, n, bounds))


def _profile(kind: str, data: DataFrame, m: Products, response: str, predictors: list[str], bounds: tuple[float, float]) -> SpatialFit:
    """The likelihood in the spatial parameter r alone, from one matrix of products of centred and scaled columns."""
    n, mean, sd, my, sy, share, g, logdet = m.n, m.mean, m.sd, m.my, m.sy, m.share, m.g, m.logdet
    p = len(predictors) + 1
    # columns of the model at r are fixed + r * moving, in terms of those of g
    fixed, moving = np.zeros((p + 1, 2 * p + 2)), np.zeros((p + 1, 2 * p + 2))
    fixed[:p, :p] = np.eye(p)
    fixed[p, 2 * p], moving[p, 2 * p + 1] = 1, -1
    if kind == "SEM":
        moving[:p, p : 2 * p] = -np.eye(p)
        moving[0, 0] = -share
    else:
        moving[p, p] = -my / sy
    q0, q1, q2 = fixed @ g @ fixed.T, fixed @ g @ moving.T + moving @ g @ fixed.T, moving @ g @ moving.T

    def value(r: float) -> tuple[float, float, float, np.ndarray, float, np.ndarray]:
        """Log-likelihood, its two derivatives, coefficients, variance (of the scaled response) and X'X at r.  The sum of squares is the least over
        coefficients, so its first derivative leaves them fixed."""
        q, d, c = q0 + r * q1 + r * r * q2, q1 + 2 * r * q2, 2 * q2
        xx = q[:p, :p]
        b = np.linalg.solve(xx, q[:p, p])
        along = np.append(-b, 1.0)
        s, s1 = max(float(along @ q @ along), 1e-300), float(along @ d @ along)
        slope = (d @ along)[:p]
        s2 = float(along @ c @ along) - 2 * float(slope @ np.linalg.solve(xx, slope))
        first = -n / 2 * s1 / s + logdet.slope(r)
        second = -n / 2 * (s2 / s - (s1 / s) ** 2) + logdet.curvature(r)
        return -n / 2 * (math.log(2 * math.pi) + math.log(s / n * sy**2) + 1) + logdet(r), first, second, b, s / n, xx

    best, inner = minimise(lambda r: -value(r)[0], *bounds, tol=1e-6)
    for _ in range(20 if inner else 0):  # the search is as sharp as the likelihood is round; its slope is sharper
        _, first, second, *_ = value(best)
        if not second < 0 or not bounds[0] < best - first / second < bounds[1]:
            break
        best, last = best - first / second, best
        if abs(best - last) < 1e-14:
            break
    ll, _, curve, b, s2, xx = value(best)
    if not curve < 0:
        raise ValueError(f"{kind}: the likelihood is not curved at {best:.6f}, so the spatial parameter has no standard error")
    cov = s2 * np.linalg.inv(xx)
    to = np.eye(p)
    for i in range(1, p):
        to[i, i] = 1 / sd[i - 1]
        to[0, i] = -mean[i - 1] / sd[i - 1]
    beta, cov = sy * (to @ b), sy**2 * (to @ cov @ to.T)
    beta[0] += my * (1 - best * share) if kind == "SAR" else my
    fitted = F.lit(float(beta[0]))
    for c, x in zip(beta[1:], predictors, strict=True):
        fitted = fitted + F.lit(float(c)) * F.col(x)
    if kind == "SAR":
        fitted = fitted + F.lit(float(best)) * F.col(f"lag_{response}")
    e = regression_metrics(data.withColumn("_fit", fitted), response, "_fit").first()
    return SpatialFit(kind, response, predictors, beta, np.sqrt(np.diag(cov)), best, 1 / math.sqrt(-curve), s2 * sy**2, ll, n, e["rmse"], e["mae"], inner, logdet.error(best))


def fit_spatial(df: DataFrame, weights: DataFrame, key: str, response: str, predictors: list[str], kinds: tuple[str, ...] = ("SAR", "SEM"), bounds: tuple[float, float] = (-0.95, 0.95)) -> list[SpatialFit]:
    """Fits of the kinds by concentrated maximum likelihood.  Rows, their lags, products and the log-determinant are made once for all of them."""
    cols = [response, *predictors]
    rows = stored(df.select(key, *cols), "rows")
    whole = complete_cases(rows, cols)
    if whole.count() < rows.count():
        weights = spatial.subset_weights(weights, whole, key)
    weights = stored(weights, "weights")
    has = weights.select(F.col("i").alias(key), F.lit(1.0).alias("_one")).distinct()
    data = stored(spatial.lag(whole, weights, key, cols).join(has, key, "left").fillna(0.0, ["_one"]), "lags")
    m = _products(data, weights, response, predictors, bounds)
    fits = [_profile(kind, data, m, response, predictors, bounds) for kind in kinds]
    release(rows, weights, data)
    return fits


def fit_sar(df: DataFrame, weights: DataFrame, key: str, response: str, predictors: list[str], bounds: tuple[float, float] = (-0.95, 0.95)) -> SpatialFit:
    """Spatial lag model by concentrated maximum likelihood: y = rho W y + X b + e.  Fitted values are rho W y + X b."""
    return fit_spatial(df, weights, key, response, predictors, ("SAR",), bounds)[0]


def fit_sem(df: DataFrame, weights: DataFrame, key: str, response: str, predictors: list[str], bounds: tuple[float, float] = (-0.95, 0.95)) -> SpatialFit:
    """Spatial error model by concentrated maximum likelihood: y = X b + u, u = lambda W u + e.  Fitted values are X b."""
    return fit_spatial(df, weights, key, response, predictors, ("SEM",), bounds)[0]


def spatial_comparison(ols: Fit, fits: list[SpatialFit], spark: SparkSession) -> DataFrame:
    m = {k: float(v) for k, v in ols.metrics().items()}
    rows = [("OLS", m["log_likelihood"], m["aic"], m["bic"], m["rmse"], m["mae"], None, True)]
    rows += [(f.kind, *map(float, (f.log_likelihood, f.aic, f.bic, f.rmse, f.mae, f.spatial)), bool(f.converged)) for f in fits]
    return spark.createDataFrame(rows, "model string, log_likelihood double, aic double, bic double, rmse double, mae double, spatial double, converged boolean")
