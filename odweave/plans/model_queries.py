"""Queries of descriptives, regression, spatial models and tree models, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from odweave.functions import scalars as S
from odweave.operators import boosting, learning, quality, shapes, spatial, stats
from odweave.operators import regression as R
from odweave.plans import sql_models as Q
from odweave.plans import views as V
from odweave.plans.flow_queries import _MONTHLY as MONTHLY
from odweave.plans.flow_queries import _with
from odweave.plans.registry import query
from odweave.plans.spatial_queries import PERMUTED_ROW, permuted_ctes
from odweave.storage import release, stored

Y, X = "log_revenue", V.PREDICTORS
FR = V.FRAME
#: Ensemble sizes of the queries; the operators' defaults are 500 trees and 500 rounds.
TREES, DEPTH, ROUNDS = 20, 6, 20


@query("SELECT 'value' AS variable, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, min(value) AS min, max(value) AS max, round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, count(*) FILTER (value = 0) AS zeros, 0::BIGINT AS missing FROM events")
def descriptives(spark, sf):
    return V.rounded(stats.descriptives(V.table(spark, sf, "events"), ["value"]))


@query("WITH d AS (SELECT 'value' AS variable, skewness(value) AS s, kurtosis(value) AS k, min(value) AS m FROM events) SELECT variable, round(s, 6) AS skewness, round(k, 6) AS kurtosis, CASE WHEN m >= 0 THEN 'log1p' ELSE 'none' END AS recommendation FROM d WHERE abs(s) >= 1.5 OR k >= 10")
def transform_screening(spark, sf):
    return V.rounded(stats.screening(stats.descriptives(V.table(spark, sf, "events"), ["value"]), 1.5))


@query(" UNION ALL ".join(f"SELECT '{c}' AS variable, q1, q3, (SELECT count(*) FROM lineitem WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM (SELECT round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem)" for c in ("l_extendedprice", "l_quantity")))
def iqr_outliers(spark, sf):
    return V.rounded(stats.iqr_outliers(V.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


_C3 = ["l_quantity", "l_extendedprice", "l_discount"]
_CORR = " UNION ALL ".join((f"SELECT '{a}' AS a, '{a}' AS b, 1.0 AS correlation" if a == b else f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem") for a in _C3 for b in _C3)


@query(_CORR)
def pearson_matrix(spark, sf):
    return V.rounded(stats.correlation_matrix(V.table(spark, sf, "lineitem"), _C3))


_RANKS = "ranks AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _C3) + " FROM lineitem)"


@query(_with(_RANKS) + _CORR.replace("FROM lineitem", "FROM ranks"))
def spearman_matrix(spark, sf):
    return V.rounded(stats.correlation_matrix(V.table(spark, sf, "lineitem").select(*_C3), _C3, "spearman"))


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in (("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_extendedprice", "l_quantity"))) + ") WHERE abs(correlation) >= 0.003")
def high_correlations(spark, sf):
    return V.rounded(stats.high_correlations(stats.correlation_matrix(V.table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"]), 0.003))


_BIN = "e AS (SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM lineitem), b AS (SELECT l_extendedprice AS f, l_quantity AS v, CASE " + " ".join(f"WHEN l_extendedprice <= e{i} THEN {i}" for i in range(1, 10)) + " ELSE 10 END AS bin FROM lineitem, e)"


@query(_with(_BIN) + "SELECT bin, count(*) AS n, round(min(f), 4) AS min_feature, round(max(f), 4) AS max_feature, round(median(f), 4) AS median_feature, round(avg(f), 4) AS mean_feature, round(avg(v), 4) AS mean_value, round(median(v), 4) AS median_value, round(quantile_cont(v, 0.25), 4) AS p25_value, round(quantile_cont(v, 0.75), 4) AS p75_value FROM b GROUP BY bin")
def binned_profile(spark, sf):
    return V.rounded(stats.binned_profile(V.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 10), 4)


@query(_with(_BIN) + "SELECT bin, round(nx - v, 4) AS slope FROM (SELECT bin, avg(v) AS v, lead(avg(v)) OVER (ORDER BY bin) AS nx FROM b GROUP BY bin) WHERE nx IS NOT NULL")
def profile_slopes(spark, sf):
    return V.rounded(stats.profile_slopes(stats.binned_profile(V.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 10)), 4)


@query(None)
def shape_summary(spark, sf):
    """Shapes of the SHAP values of each feature over 20 quantile bins (E5)."""
    f, m = _model(spark, sf)
    joined = stored(f.join(learning.shap_values(m, f, X, "area"), "area"), "shap")
    t = V.rounded(shapes.shape_table(joined, {c: f"shap_{c}" for c in X}))
    release(joined)
    return t


_PAIRS = [(a, b) for i, a in enumerate([Y, *X]) for b in [Y, *X][i:]]


@query(_with(FR) + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS product FROM frame" for a, b in _PAIRS))
def gram_matrix(spark, sf):
    g = R.cross_products(V.model_frame(spark, sf), [F.col(c) for c in [Y, *X]])
    at = {c: i for i, c in enumerate([Y, *X])}
    return V.rounded(spark.createDataFrame([(a, b, float(g[at[a], at[b]])) for a, b in _PAIRS], "a string, b string, product double"), 4)


_TWO = """m AS (SELECT avg(log_revenue) AS my, avg(quantity) AS m1, avg(lines) AS m2, var_pop(quantity) AS v1, var_pop(lines) AS v2, covar_pop(quantity, lines) AS c12, covar_pop(log_revenue, quantity) AS cy1, covar_pop(log_revenue, lines) AS cy2, var_pop(log_revenue) AS vy, count(*)::DOUBLE AS n FROM frame),
b AS (SELECT *, (cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12) AS b1, (cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM m), b0 AS (SELECT *, my - b1 * m1 - b2 * m2 AS a FROM b)"""


@query(_with(FR, _TWO) + "SELECT term, round(estimate, 6) AS estimate FROM (SELECT 'const' AS term, a AS estimate FROM b0 UNION ALL SELECT 'quantity', b1 FROM b0 UNION ALL SELECT 'lines', b2 FROM b0)")
def ols_two_predictor(spark, sf):
    return V.rounded(R.fit_ols(V.model_frame(spark, sf), Y, ["quantity", "lines"]).coefficients(spark).select("term", "estimate"))


@query(_with(FR, _TWO) + """, z AS (SELECT (quantity - m1) / sqrt(v1) AS x1, (lines - m2) / sqrt(v2) AS x2, log_revenue - a - b1 * quantity - b2 * lines AS e, n, c12 / sqrt(v1 * v2) AS r, v1, v2 FROM frame, b0),
h AS (SELECT *, (1 + (x1 * x1 - 2 * r * x1 * x2 + x2 * x2) / (1 - r * r)) / n AS lev FROM z), u AS (SELECT *, e / (1 - lev) AS q FROM h),
g AS (SELECT sum(q * q * power((x1 - r * x2) / (n * (1 - r * r)), 2)) / max(v1) AS s1, sum(q * q * power((x2 - r * x1) / (n * (1 - r * r)), 2)) / max(v2) AS s2 FROM u)
SELECT term, round(robust_se, 6) AS robust_se FROM (SELECT 'quantity' AS term, sqrt(s1) AS robust_se FROM g UNION ALL SELECT 'lines', sqrt(s2) FROM g)""")
def ols_hc3(spark, sf):
    return V.rounded(R.fit_ols(V.model_frame(spark, sf), Y, ["quantity", "lines"]).coefficients(spark).where("term != 'const'").select("term", "robust_se"))


@query(_with(FR, _TWO) + """, e AS (SELECT sum(power(log_revenue - a - b1 * quantity - b2 * lines, 2)) AS ssr, avg(abs(log_revenue - a - b1 * quantity - b2 * lines)) AS mae, max(n) AS n, max(vy) * max(n) AS sst FROM frame, b0), l AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM e)
SELECT n::BIGINT AS n, round(1 - ssr / sst, 6) AS r2, round(1 - (ssr / sst) * (n - 1) / (n - 3), 6) AS adj_r2, round(sqrt(ssr / n), 6) AS rmse, round(mae, 6) AS mae, round(ll, 4) AS log_likelihood, round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic FROM l""")
def ols_metrics(spark, sf):
    m = R.fit_ols(V.model_frame(spark, sf), Y, ["quantity", "lines"]).metrics()
    row = (int(m["n"]), *(round(float(m[k]), 6) for k in ("r2", "adj_r2", "rmse", "mae")), *(round(float(m[k]), 4) for k in ("log_likelihood", "aic", "bic")))
    return spark.createDataFrame([row], "n long, r2 double, adj_r2 double, rmse double, mae double, log_likelihood double, aic double, bic double")


@query(_with(FR) + "SELECT c AS variable, round(1 / (1 - r * r), 6) AS vif FROM (SELECT corr(quantity, lines) AS r FROM frame), (VALUES ('quantity'), ('lines')) AS t(c)")
def vif_two(spark, sf):
    return V.rounded(stats.vif(V.model_frame(spark, sf), ["quantity", "lines"]).select("variable", "vif"))


_VIF = [c for x in X for c in (*Q.orthogonal(f"v_{x}", "frame", x, [o for o in X if o != x]), f"i_{x} AS (SELECT '{x}' AS variable, var_pop({x}) * count(*) / sum(e * e) AS vif FROM v_{x})")]


@query(_with(FR, *_VIF) + "SELECT variable, round(vif, 6) AS vif, round(1 / vif, 6) AS tolerance, CASE WHEN vif >= 10 THEN 'high' WHEN vif >= 5 THEN 'moderate' ELSE 'low' END AS status FROM (" + " UNION ALL ".join(f"SELECT * FROM i_{x}" for x in X) + ")")
def vif(spark, sf):
    return V.rounded(stats.vif(V.model_frame(spark, sf), X))


_FIT = (*Q.orthogonal("fit", "frame", Y, X), Q.metrics("fit", Y, len(X) + 1))
#: The auxiliary regressions: of the squared residuals, and with the squared fitted values beside the predictors.
_AUXILIARY = (
    "bp0 AS (SELECT area, log_revenue, quantity, discount, tax, returns, lines, e * e AS e2, fit * fit AS fit2 FROM fit)",
    *Q.orthogonal("bp", "bp0", "e2", X), Q.metrics("bp", "e2", len(X) + 1), *Q.orthogonal("rs", "bp0", Y, [*X, "fit2"]), Q.metrics("rs", Y, len(X) + 2),
)


@query(
    _with(FR, *_FIT, *_AUXILIARY)
    + f""", g AS (SELECT avg(pow(e, 3)) / pow(avg(e * e), 1.5) AS skew, avg(pow(e, 4)) / pow(avg(e * e), 2) AS kurt, max(abs(e) / sqrt((SELECT ssr / (n - 6) FROM fit_m) * (1 - lev))) AS student FROM fit),
h AS (SELECT n, skew, kurt, student, n / 6 * (skew * skew + pow(kurt - 3, 2) / 4) AS jb, n * (SELECT r2 FROM bp_m) AS bp, (SELECT (sst - ssr) / 5 / (ssr / (n - 6)) FROM bp_m) AS bpf,
  (SELECT (fit_m.ssr - rs_m.ssr) / (rs_m.ssr / (rs_m.n - 7)) FROM rs_m) AS reset FROM g, fit_m)
SELECT diagnostic, round(value, 6) + 0.0 AS value FROM (SELECT 'jarque_bera' AS diagnostic, jb AS value FROM h UNION ALL SELECT 'jarque_bera_p', {Q.chi2_upper("jb", 2)} FROM h UNION ALL SELECT 'skewness', skew FROM h
UNION ALL SELECT 'kurtosis', kurt FROM h UNION ALL SELECT 'breusch_pagan', bp FROM h UNION ALL SELECT 'breusch_pagan_p', {Q.chi2_upper("bp", 5)} FROM h UNION ALL SELECT 'breusch_pagan_f', bpf FROM h
UNION ALL SELECT 'breusch_pagan_f_p', {Q.f_upper("bpf", 5, "(n - 6)")} FROM h UNION ALL SELECT 'reset_f', reset FROM h UNION ALL SELECT 'reset_p', {Q.t_two_sided("sqrt(greatest(reset, 0))", "(n - 7)")} FROM h UNION ALL SELECT 'max_abs_studentised', student FROM h)"""
)
def ols_diagnostics(spark, sf):
    d = R.diagnostics(R.fit_ols(V.model_frame(spark, sf), Y, X))
    return V.rounded(spark.createDataFrame([(k, float(v)) for k, v in d.items()], "diagnostic string, value double"))


#: Contiguity of the frame's lattice, and lags of the fitted values, the residuals and the response.
_FW = """fe AS (SELECT a.area AS i, b.area AS j FROM frame a, frame b WHERE abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.area <> b.area), fw AS (SELECT i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY i) AS w FROM fe)"""
_FL = """fl AS (SELECT fit.*, coalesce(l.wf, 0) AS wf, coalesce(l.we, 0) AS we, coalesce(l.wy, 0) AS wy FROM fit LEFT JOIN (SELECT i, sum(w * b.fit) AS wf, sum(w * b.e) AS we, sum(w * b.log_revenue) AS wy FROM fw JOIN fit b ON b.area = fw.j GROUP BY i) l ON l.i = fit.area)"""


@query(
    _with(FR, *_FIT, _FW, _FL)
    + f""", tr AS (SELECT sum(a.w * a.w) + sum(a.w * coalesce(b.w, 0)) AS t FROM fw a LEFT JOIN fw b ON b.i = a.j AND b.j = a.i),
d AS (SELECT sum(wf * wf) - pow(sum(wf), 2) / count(*) {"".join(f" - pow(sum(wf * q{i}), 2) / sum(q{i} * q{i})" for i in range(1, 6))} AS mwf, sum(e * we) AS de, sum(e * wy) AS dl, sum(e * e) / count(*) AS s2 FROM fl),
t AS (SELECT t, de / s2 AS de, dl / s2 AS dl, mwf / s2 + t AS nj FROM d, tr),
st AS (SELECT dl * dl / nj AS lag, de * de / t AS error, pow(dl - de, 2) / (nj - t) AS rlag, pow(de - t / nj * dl, 2) / (t * (1 - t / nj)) AS rerror FROM t)
SELECT diagnostic, round(s, 6) AS statistic, round(p, 6) AS p_value, df FROM (SELECT 'LM-lag' AS diagnostic, lag AS s, {Q.chi2_upper("lag", 1)} AS p, 1 AS df FROM st UNION ALL SELECT 'LM-error', error, {Q.chi2_upper("error", 1)}, 1 FROM st
UNION ALL SELECT 'Robust LM-lag', rlag, {Q.chi2_upper("rlag", 1)}, 1 FROM st UNION ALL SELECT 'Robust LM-error', rerror, {Q.chi2_upper("rerror", 1)}, 1 FROM st UNION ALL SELECT 'LM-SARMA', rlag + error, {Q.chi2_upper("(rlag + error)", 2)}, 2 FROM st)"""
)
def lm_tests(spark, sf):
    f = V.model_frame(spark, sf)
    t = R.lm_tests(R.fit_ols(f.select("area", Y, *X), Y, X), V.frame_weights(f), "area")
    return V.rounded(spark.createDataFrame([(k, *v) for k, v in t.items()], "diagnostic string, statistic double, p_value double, df int"))


_RZ = "z AS (SELECT area, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS z FROM fit), weights AS (SELECT * FROM fw)"


@query(_with(FR, *_FIT, _FW, _RZ) + f", {permuted_ctes(999)} " + PERMUTED_ROW)
def residual_moran(spark, sf):
    f = stored(V.model_frame(spark, sf), "frame")
    fit = R.fit_ols(f, Y, X)
    m = V.rounded(spatial.moran_permutation(fit.data.select("area", fit.residual().alias("residual")), V.frame_weights(f), "area", "residual", 999))
    return m.withColumn("z_sim", F.round("z_sim", 4))


def _spatial(spark, sf, *kinds):
    """The frame, a stored table, and its fits of the kinds."""
    f = stored(V.model_frame(spark, sf), "frame")
    return f, R.fit_spatial(f, V.frame_weights(f), "area", Y, X, kinds)


def _inference(spark, sf, kind):
    f, (fit,) = _spatial(spark, sf, kind)
    release(f)
    return V.rounded(fit.inference(spark), 5)


@query(None)
def sar_fit(spark, sf):
    return _inference(spark, sf, "SAR")


@query(None)
def sem_fit(spark, sf):
    return _inference(spark, sf, "SEM")


@query(None)
def spatial_model_comparison(spark, sf):
    f, fits = _spatial(spark, sf, "SAR", "SEM")
    ols = R.fit_ols(f, Y, X)
    release(f)
    return V.rounded(R.spatial_comparison(ols, fits, spark), 4)


@query("SELECT round(1 - sum(power(l_extendedprice - p, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, count(*) AS n, round(sqrt(avg(power(l_extendedprice - p, 2))), 4) AS rmse, round(avg(abs(l_extendedprice - p)), 4) AS mae FROM (SELECT l_extendedprice, l_quantity * 1500.0 AS p FROM lineitem)")
def regression_metrics(spark, sf):
    m = R.regression_metrics(V.table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p")
    return m.select(F.round("r2", 6).alias("r2"), "n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


def _folded(spark, sf):
    """The frame with folds, a stored table: models read it once a round."""
    return stored(learning.strip_folds(stored(V.model_frame(spark, sf), "frame")), "folds")


@query(None)
def rf_cv(spark, sf):
    return learning.cross_validate(_folded(spark, sf), learning.random_forest(TREES, DEPTH), X, Y)


@query(None)
def gbt_cv(spark, sf):
    """Second-order boosting with L2, row and column samples, one model a left-out fold, all grown side by side."""
    return boosting.cross_validated(_folded(spark, sf), X, Y, "fold", boosting.Settings(rounds=ROUNDS), "area")


_FOLDED = "folded AS (SELECT *, least((x - (SELECT min(x) FROM frame)) * 5 // (SELECT max(x) - min(x) + 1 FROM frame), 4) AS fold FROM frame)"


@query(_with(FR, _FOLDED, *Q.orthogonal("ho", "folded", Y, X, "fold <> 0")) + "SELECT count(*) AS n, round(1 - sum(e * e) / (var_pop(log_revenue) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM ho WHERE fold = 0")
def held_out_ols(spark, sf):
    """OLS fitted without fold 0 and scored on it (E4)."""
    f = _folded(spark, sf).withColumn("part", S.partition_label(F.col("fold")))
    fit = R.fit_ols(f.where("part = 'train'"), Y, X)
    return V.rounded(R.regression_metrics(f.where("part = 'test'").withColumn("p", fit.fitted()), Y, "p"))


def _model(spark, sf):
    f = V.model_frame(spark, sf)
    return f, learning.fit_model(learning.assembled(f, X), learning.boosted_trees(ROUNDS), Y)


@query(None)
def permutation_importance(spark, sf):
    f, m = _model(spark, sf)
    return V.rounded(learning.permutation_importance(m, f, X, Y, "area"))


@query(None)
def shap_values(spark, sf):
    f, m = _model(spark, sf)
    return V.rounded(learning.shap_values(m, f, X, "area"))


# --- robustness: each experiment is a composition -------------------------------------------


def _experiment(spark, fits):
    return V.rounded(R.compare(fits, spark).withColumnRenamed("model", "name"), 5)


_M5 = "n, round(r2, 5) AS r2, round(adj_r2, 5) AS adj_r2, round(rmse, 5) AS rmse, round(mae, 5) AS mae, round(log_likelihood, 5) AS log_likelihood, round(aic, 5) AS aic, round(bic, 5) AS bic"


def _metric_rows(**names: str) -> str:
    """One row a fit of its metrics, by the names of their CTEs."""
    return " UNION ALL ".join(f"SELECT '{shown}' AS name, {_M5} FROM {cte}_m" for cte, shown in names.items())


@query(_with(FR, *_FIT, *Q.orthogonal("sub", "frame", Y, X[:3]), Q.metrics("sub", Y, 4)) + f"SELECT *, r2 - first_value(r2) OVER w AS delta_r2, aic - first_value(aic) OVER w AS delta_aic FROM ({_metric_rows(fit='baseline', sub='subset')}) WINDOW w AS (ORDER BY name)")
def e1_subset_predictors(spark, sf):
    """The model with some predictors against all (E1)."""
    f = V.model_frame(spark, sf)
    t = _experiment(spark, {"baseline": R.fit_ols(f, Y, X), "subset": R.fit_ols(f, Y, X[:3])})
    return stats.delta_vs_baseline(t, "name", "baseline", ["r2", "aic"])


_LOGGED = "logged AS (SELECT area, log_revenue, " + ", ".join(f"ln(1 + {c}) AS {c}" for c in X[:4]) + ", lines, x, y FROM frame)"


def _logged(spark, sf):
    """The frame, a stored table, and the same with logged predictors."""
    f = stored(V.model_frame(spark, sf), "frame")
    low = f.agg(*(F.min(c).alias(c) for c in X[:4])).first()
    if any(low[c] < 0 for c in X[:4]):
        raise ValueError("log1p needs predictors that are not negative")
    return f, f.withColumns({c: F.log1p(c) for c in X[:4]})


def _terms(source: str, tag: str) -> list[str]:
    return [c for x in X for c in Q.coefficient(f"{tag}_{x}", source, Y, x, [o for o in X if o != x])]


_TERM_ROWS = " UNION ALL ".join(
    f"SELECT '{x}' AS term, a.estimate AS re, {Q.t_two_sided('abs(a.estimate / a.robust_se)', 'a.df')} AS rp, b.estimate AS le, {Q.t_two_sided('abs(b.estimate / b.robust_se)', 'b.df')} AS lp FROM er_{x}_c a, el_{x}_c b" for x in X
)


@query(
    _with(FR, _LOGGED, *_terms("frame", "er"), *_terms("logged", "el"))
    + f"SELECT term, round(re, 6) + 0.0 AS raw_estimate, round(rp, 6) + 0.0 AS raw_p, round(le, 6) + 0.0 AS log_estimate, round(lp, 6) + 0.0 AS log_p, sign(re) = sign(le) AS same_sign, (rp < 0.05) = (lp < 0.05) AS same_significance FROM ({_TERM_ROWS})"
)
def e6_log_predictors(spark, sf):
    """log1p of non-negative predictors; stability of sign and significance (E6)."""
    f, g = _logged(spark, sf)
    a, b = (R.fit_ols(x, Y, X).coefficients(spark).where("term != 'const'").select("term", F.col("estimate").alias(f"{n}_estimate"), F.col("robust_p").alias(f"{n}_p")) for x, n in ((f, "raw"), (g, "log")))
    same_sig = (F.col("raw_p") < 0.05) == (F.col("log_p") < 0.05)
    return V.rounded(a.join(b, "term").withColumns({"same_sign": S.same_direction(F.col("raw_estimate"), F.col("log_estimate")), "same_significance": same_sig}))


_LDIAG = (
    *Q.orthogonal("fit", "logged", Y, X), Q.metrics("fit", Y, len(X) + 1), *_AUXILIARY,
    "zfit AS (SELECT area, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS z FROM fit)",
)


@query(
    _with(FR, _LOGGED, *_LDIAG, _FW, "z AS (SELECT * FROM zfit), weights AS (SELECT * FROM fw)")
    + f""", t AS (SELECT (SELECT n * r2 FROM bp_m) AS bp, (SELECT (sst - ssr) / 5 / (ssr / (n - 6)) FROM bp_m) AS bpf, (SELECT (fit_m.ssr - rs_m.ssr) / (rs_m.ssr / (rs_m.n - 7)) FROM rs_m, fit_m) AS reset, (SELECT n FROM bp_m) AS n),
{permuted_ctes(999)}, pm AS ({PERMUTED_ROW})
SELECT diagnostic, round(s, 6) + 0.0 AS statistic, round(p, 6) + 0.0 AS p_value FROM (SELECT 'Breusch-Pagan LM' AS diagnostic, bp AS s, {Q.chi2_upper("bp", 5)} AS p FROM t UNION ALL SELECT 'Breusch-Pagan F', bpf, {Q.f_upper("bpf", 5, "(n - 6)")} FROM t
UNION ALL SELECT 'Ramsey RESET F', reset, {Q.t_two_sided("sqrt(greatest(reset, 0))", "(n - 7)")} FROM t UNION ALL SELECT 'Residual Moran I', moran_i, p_sim FROM pm)"""
)
def e6_diagnostics(spark, sf):
    """Diagnostics of the model with logged predictors (E6)."""
    f, g = _logged(spark, sf)
    fit = R.fit_ols(g.select("area", Y, *X), Y, X)
    d = R.diagnostics(fit)
    m = spatial.moran_permutation(fit.data.select("area", fit.residual().alias("residual")), V.frame_weights(g), "area", "residual", 999).first()
    release(f)
    rows = [("Breusch-Pagan LM", d["breusch_pagan"], d["breusch_pagan_p"]), ("Breusch-Pagan F", d["breusch_pagan_f"], d["breusch_pagan_f_p"]), ("Ramsey RESET F", d["reset_f"], d["reset_p"]), ("Residual Moran I", m["moran_i"], m["p_sim"])]
    return V.rounded(spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], "diagnostic string, statistic double, p_value double"))


def _monthly_frame(spark, sf):
    from odweave.operators import flows

    m = flows.monthly_indicators(V.areas(spark, sf), V.records(spark, sf), V.expected(spark))
    return m.withColumns({"y": F.log1p("mobility_inflow_total"), "e": F.col("flow_entropy"), "h": S.normalised_entropy(F.col("flow_entropy"), F.col("unique_origins"))})


_MF = "mf AS (SELECT area, ln(1 + mobility_inflow_total) AS y, flow_entropy, unique_origins::DOUBLE AS unique_origins, weekday_inflow_total, weekend_inflow_total, CASE WHEN unique_origins > 1 THEN flow_entropy / ln(unique_origins) END AS h FROM m)"
_RENAMED = "mg AS (SELECT area, y AS resp, flow_entropy, unique_origins, weekday_inflow_total, weekend_inflow_total, h FROM mf)"


@query(
    MONTHLY + ", " + ",\n".join([_MF, _RENAMED, *Q.orthogonal("aw", "mg", "resp", ["flow_entropy", "weekday_inflow_total"]), Q.metrics("aw", "resp", 3), *Q.orthogonal("we", "mg", "resp", ["flow_entropy", "weekend_inflow_total"]), Q.metrics("we", "resp", 3)]) + "\n" + _metric_rows(aw="all days", we="weekend")
)
def e7_weekend_model(spark, sf):
    """Inflow at weekends in place of all inflow (E7)."""
    m = _monthly_frame(spark, sf)
    return _experiment(spark, {"all days": R.fit_ols(m, "y", ["e", "weekday_inflow_total"]), "weekend": R.fit_ols(m, "y", ["e", "weekend_inflow_total"])})


@query(
    MONTHLY + ", " + ",\n".join([_MF, _RENAMED, *Q.orthogonal("rw", "mg", "resp", ["flow_entropy", "unique_origins"]), Q.metrics("rw", "resp", 3), "mh AS (SELECT * FROM mg WHERE h IS NOT NULL)", *Q.orthogonal("nh", "mh", "resp", ["h", "unique_origins"]), Q.metrics("nh", "resp", 3)]) + "\n" + _metric_rows(rw="raw", nh="normalised")
)
def e8_normalised_entropy(spark, sf):
    """Normalised entropy in place of entropy: the OLS fits (E8)."""
    m = _monthly_frame(spark, sf)
    return _experiment(spark, {"raw": R.fit_ols(m, "y", ["flow_entropy", "unique_origins"]), "normalised": R.fit_ols(m, "y", ["h", "unique_origins"])})


def _estimators():
    return {"Random Forest": learning.random_forest(TREES, DEPTH), "Gradient boosting": learning.boosted_trees(ROUNDS)}


@query(None)
def held_out_comparison(spark, sf):
    """OLS and both tree models on the same held-out fold, and the best tree model (E4)."""
    estimators = _estimators() | {"Gradient boosting": boosting.Settings(rounds=ROUNDS)}
    f = _folded(spark, sf)
    t = learning.compare_held_out(f, X, Y, estimators, key="area")[0]
    release(f)
    return V.rounded(t)


@query(None)
def e8_tree_models(spark, sf):
    """Raw and normalised entropy in the boosted model: test metrics, importance with its rank, mean absolute SHAP value and shape of the
    entropy (E8).  Areas with one origin at most have no normalised entropy, which is an error."""
    m = _monthly_frame(spark, sf).select("area", "y", "flow_entropy", "h", F.col("unique_origins").cast("double").alias("unique_origins"), "weekday_weekend_ratio")
    m = learning.strip_folds(m.fillna(0.0, ["weekday_weekend_ratio"]).join(V.areas(spark, sf).select("area", "x", F.col("y").alias("row")), "area"))
    m = stored(m, "entropy")
    if m.where("h IS NULL").limit(1).count():
        release(m)
        raise ValueError("normalised entropy is missing where an area has one origin at most")
    rows = []
    for basis, entropy, rules in (("raw", "flow_entropy", shapes.RULES), ("normalised", "h", shapes.SHORT_RULES)):
        names = [entropy, "unique_origins", "weekday_weekend_ratio"]
        table, fitted = learning.compare_held_out(m, names, "y", {"Gradient boosting": learning.boosted_trees(ROUNDS)})
        model, t = fitted["Gradient boosting"], table.where("model != 'OLS'").first()
        imp = learning.permutation_importance(model, m.where("fold = 0"), names, "y", "area").where(F.col("feature") == entropy).first()
        shap = stored(m.join(learning.shap_values(model, m, names, "area"), "area").select(entropy, f"shap_{entropy}"), "shap")
        shape = shapes.shape_table(shap, {entropy: f"shap_{entropy}"}, rules=rules).first()
        release(shap)
        rows.append((basis, t["cv_r2"], t["test_r2"], t["rmse"], imp["mean"], int(imp["rank"]), shape["mean_abs_value"], shape["shape"]))
    release(m)
    return V.rounded(spark.createDataFrame(rows, "basis string, cv_r2 double, test_r2 double, rmse double, entropy_importance double, entropy_importance_rank int, entropy_mean_abs_shap double, entropy_shape string"))


_VERSIONS = ("quantity", "discount", "lines")


@query(
    _with(FR, "two AS (SELECT area, " + ", ".join(f"CASE WHEN area % 7 = 0 THEN {c} + 0.5 ELSE {c} END AS {c}" for c in _VERSIONS) + " FROM frame WHERE area % 11 <> 0)")
    + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS rows, count(*) FILTER (b.area IS NULL) AS only_old, count(*) FILTER (b.area IS NULL OR abs(a.{c} - b.{c}) > 0.000001) AS outside, round(max(abs(a.{c} - b.{c})), 6) AS max_abs_diff FROM frame a LEFT JOIN two b USING (area)" for c in _VERSIONS)
)
def table_comparison(spark, sf):
    """Two versions of a table, of which the second lacks some areas and changes others."""
    old = V.model_frame(spark, sf).select("area", *_VERSIONS)
    new = old.where("area % 11 != 0").withColumns({c: F.when(F.col("area") % 7 == 0, F.col(c) + 0.5).otherwise(F.col(c)) for c in _VERSIONS})
    d = quality.table_differences(old, new, "area", list(_VERSIONS))
    return V.rounded(d.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(F.col("new").isNull()).alias("only_old"), F.count_if(~F.col("within")).alias("outside"), F.max("abs_diff").alias("max_abs_diff")))


_GAPS = "gaps AS (SELECT area, log_revenue, CASE WHEN area % 5 = 0 THEN NULL ELSE quantity END AS quantity, CASE WHEN area % 9 = 0 THEN 'nan'::DOUBLE ELSE discount END AS discount, 3.0::DOUBLE AS tax, returns, lines FROM frame)"


@query(
    _with(FR, _GAPS, "whole AS (SELECT * FROM gaps WHERE quantity IS NOT NULL AND NOT isnan(discount))")
    + "SELECT count(*) AS complete, (SELECT count(*) FROM (" + " UNION ALL ".join(f"SELECT min({c}) = max({c}) AS same FROM whole" for c in X) + ") WHERE same) AS constants FROM whole"
)
def complete_cases(spark, sf):
    """Complete finite rows of a frame with nulls, values that are no numbers, and a constant column."""
    f = V.model_frame(spark, sf).withColumns({"quantity": F.when(F.col("area") % 5 != 0, F.col("quantity")), "discount": F.when(F.col("area") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("discount")), "tax": F.lit(3.0)})
    f = quality.complete_cases(f, [Y, *X])
    return f.agg(F.count("*").alias("complete")).withColumn("constants", F.lit(len(quality.constant_columns(f, X))).cast("long"))
