"""SQL of linear models for the queries' DuckDB text: orthogonal predictors by window sums, and tail probabilities.

``orthogonal`` makes each predictor orthogonal to the constant and to those before it (Gram and Schmidt), so that fitted values, residuals
and leverages are sums over columns q1 .. qk, and the coefficient of the last predictor is that of the full model.
"""

from __future__ import annotations


def orthogonal(name: str, source: str, y: str, xs: list[str], learn: str = "true") -> list[str]:
    """CTEs that end in ``name``: source with q1 .. qk, fit, e (residual) and lev (leverage).  Sums are over rows where ``learn`` holds."""
    over = f"FILTER (WHERE {learn}) OVER ()"
    slope = lambda v, i: f"q{i} * (sum({v} * q{i}) {over} / sum(q{i} * q{i}) {over})"
    out, at = [], source
    for j, x in enumerate(xs, 1):
        less = "".join(f" - {slope(f'({x})', i)}" for i in range(1, j))
        out.append(f"{name}{j} AS (SELECT *, {x} - avg({x}) {over}{less} AS q{j} FROM {at})")
        at = f"{name}{j}"
    ks = range(1, len(xs) + 1)
    fit = f"avg({y}) {over}" + "".join(f" + {slope(f'({y})', i)}" for i in ks)
    lev = f"1.0::DOUBLE / count(*) {over}" + "".join(f" + q{i} * q{i} / sum(q{i} * q{i}) {over}" for i in ks)
    out.append(f"{name}f AS (SELECT *, {fit} AS fit, {lev} AS lev FROM {at})")
    out.append(f"{name} AS (SELECT *, {y} - fit AS e FROM {name}f)")
    return out


def metrics(name: str, y: str, k: int) -> str:
    """A one-row CTE name_m of a fit: n, ssr, r2, adj_r2, rmse, mae, log_likelihood, aic, bic; k counts the constant."""
    return f"""{name}_s AS (SELECT count(*)::DOUBLE AS n, sum(e * e) AS ssr, var_pop({y}) * count(*) AS sst, avg(abs(e)) AS mae FROM {name}),
{name}_l AS (SELECT *, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM {name}_s),
{name}_m AS (SELECT n, ssr, sst, 1 - ssr / sst AS r2, 1 - ssr / sst * (n - 1) / (n - {k}) AS adj_r2, sqrt(ssr / n) AS rmse, mae, ll AS log_likelihood, 2 * {k} - 2 * ll AS aic, {k} * ln(n) - 2 * ll AS bic FROM {name}_l)"""


def coefficient(name: str, source: str, y: str, x: str, others: list[str]) -> list[str]:
    """CTEs that end in the one row name_c: estimate of x beside the others, robust_se (HC3) and df."""
    q = f"q{len(others) + 1}"
    return [
        *orthogonal(name, source, y, [*others, x]),
        f"{name}_c AS (SELECT sum({y} * {q}) / sum({q} * {q}) AS estimate, sqrt(sum(pow({q} * e / (1 - lev), 2))) / sum({q} * {q}) AS robust_se, count(*) - {len(others) + 2}::DOUBLE AS df FROM {name})",
    ]


def _simpson(density: str, high: str, steps: int) -> str:
    """Integral from 0 to high of a density in u."""
    body = density.replace("[u]", f"({high}) * i / {steps}.0::DOUBLE")
    return f"(({high}) / {3 * steps} * list_sum([(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {body} FOR i IN range(0, {steps + 1})]))"


def normal_two_sided(z: str) -> str:
    """P(|Z| > z) for z >= 0."""
    return f"greatest(0.0, 1 - 2 * {_simpson('exp(-pow([u], 2) / 2) / sqrt(2 * pi())', f'least({z}, 9.0)', 2000)})"


def t_two_sided(t: str, df: str) -> str:
    """P(|T| > t) for t >= 0."""
    constant = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())"
    return f"greatest(0.0, 1 - 2 * {constant} * {_simpson(f'pow(1 + pow([u], 2) / {df}, -({df} + 1) / 2)', f'least({t}, 60.0)', 4000)})"


def chi2_upper(x: str, df: int) -> str:
    """P(chi-square > x): closed forms."""
    if df % 2 == 0:
        terms, last = ["1.0::DOUBLE"], "1.0::DOUBLE"
        for i in range(1, df // 2):
            last = f"{last} * ({x}) / {2 * i}"
            terms.append(last)
        return f"exp(-({x}) / 2) * ({' + '.join(terms)})"
    out, product = normal_two_sided(f"sqrt({x})"), 1
    for r in range(1, (df - 1) // 2 + 1):
        product *= 2 * r - 1
        out += f" + 2 * exp(-({x}) / 2) / sqrt(2 * pi()) * pow({x}, {r - 0.5}) / {product}"
    return f"({out})"


def f_upper(f: str, d1: int, d2: str) -> str:
    """P(F > f) for d1 of 3 or more: the incomplete beta integral."""
    a, b = f"({d2} / 2.0)", f"{d1 / 2}"
    constant = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    return f"({constant} * {_simpson(f'pow([u], {a} - 1) * pow(1 - [u], {b} - 1)', f'{d2} / ({d2} + {d1} * ({f}))', 4000)})"
