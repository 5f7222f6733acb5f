"""Special functions and decompositions as DuckDB SQL, for checking the operators' own.

They are made another way than those of :mod:`cytolake.functions.special`: tail probabilities by Simpson's rule, the
prior's equation by bisection in a recursive table, eigenvectors by squaring a matrix.
"""

from __future__ import annotations


def _simpson(term: str, points: int) -> str:
    """Simpson's sum of ``term``, an expression of ``i``, over 0, ..., ``points`` (an even number), times the step / 3."""
    return f"list_sum(list_transform(range(0, {points + 1}), lambda i: (CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)::DOUBLE * ({term}))) / 3"


def t_pvalue(t: str, df: str, points: int = 2000) -> str:
    """Two-sided p-value of Student's t: one less the integral of a power of the cosine."""
    angle = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    inside = _simpson(f"pow(cos({angle} * i / {points}), ({df}) - 1)", points)
    return f"greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) * {angle} / {points} * {inside})"


def f_pvalue(f: str, d1: str, d2: str, points: int = 20000, far: float = 60.0) -> str:
    """Upper tail of Fisher's F: the incomplete beta integral over the logarithm of its argument."""
    a, b, x, step = f"({d2} / 2.0::DOUBLE)", f"({d1} / 2.0::DOUBLE)", f"({d2} / ({d2} + {d1} * {f}))", far / points
    inside = _simpson(f"exp(-i * {step!r}::DOUBLE) * pow(1 - {x} * exp(-i * {step!r}::DOUBLE / {a}), {b} - 1)", points)
    return f"(exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x})) / {a} * {step!r}::DOUBLE * {inside})"


def _sum_inverse(x: str, power: int) -> str:
    return f"list_sum(list_transform(range(0, 40), lambda i: pow({x} + i, -{power})))"


def trigamma(x: str) -> str:
    y = f"({x} + 40)"
    return f"({_sum_inverse(x, 2)} + 1 / {y} + pow({y}, -2) / 2 + pow({y}, -3) / 6 - pow({y}, -5) / 30 + pow({y}, -7) / 42)"


def digamma(x: str) -> str:
    y = f"({x} + 40)"
    return f"(ln({y}) - 1 / (2 * {y}) - pow({y}, -2) / 12 + pow({y}, -4) / 120 - pow({y}, -6) / 252 - {_sum_inverse(x, 1)})"


def prior(variances: str, most: float = 50.0) -> str:
    """Tables ``bis`` and ``prior(chunk, d0, s0)``: the prior of the log variances of ``variances(chunk, s2)``, by bisection."""
    return (f"mom AS (SELECT chunk, median(ln(s2)) AS middle, var_samp(ln(s2)) AS spread FROM {variances} WHERE s2 > 0 GROUP BY 1), "
            "bis AS (SELECT 0 AS k, chunk, middle, spread, 1e-6::DOUBLE AS lo, 1e6::DOUBLE AS hi FROM mom UNION ALL "
            f"SELECT k + 1, chunk, middle, spread, CASE WHEN g > spread THEN x ELSE lo END, CASE WHEN g > spread THEN hi ELSE x END FROM (SELECT *, sqrt(lo * hi) AS x, {trigamma('sqrt(lo * hi)')} AS g FROM bis WHERE k < 90)), "
            f"prior AS (SELECT chunk, least(2 * x, {most}::DOUBLE) AS d0, exp(middle - {digamma('x')} + ln(x)) AS s0 FROM (SELECT *, sqrt(lo * hi) AS x FROM bis WHERE k = 90))")


def normal_cdf(z: str, i: str = "i") -> str:
    """The series of the normal distribution around 0; ``i`` names its terms."""
    term = f"{z} * exp({i} * ln({z} * {z}) - ({i} + 1) * ln(2.0::DOUBLE) - lgamma({i} + 1.5::DOUBLE) + ln(pi()) / 2)"
    return f"(0.5::DOUBLE + CASE WHEN {z} = 0 THEN 0 ELSE exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda {i}: {term})) END)"


def normal_quantiles(table: str, column: str) -> str:
    """Tables ``newton`` and ``z(id, z)``: the normal quantiles of ``1 - column`` of ``table(id, ...)``, by Newton's steps from 0."""
    return (f"newton AS (SELECT 0 AS k, id, 1 - {column} AS q, 0.0::DOUBLE AS z FROM {table} UNION ALL "
            f"SELECT k + 1, id, q, z - ({normal_cdf('z')} - q) * sqrt(2 * pi()) * exp(z * z / 2) FROM newton WHERE k < 25), z AS (SELECT id, z FROM newton WHERE k = 25)")


def principal(gram: str, n: int, k: int) -> str:
    """Tables ``m{k}`` and ``e{k}(v, value)``: the first eigenvector of the ``n`` x ``n`` matrix ``gram(g)``, from its powers."""
    return (f"m{k} AS (SELECT 0 AS k, g AS p FROM {gram} UNION ALL SELECT k + 1, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: list_dot_product(p[i], p[j]) / tr)) "
            f"FROM (SELECT *, list_sum(list_transform(range(1, {n + 1}), lambda i: list_dot_product(p[i], p[i]))) AS tr FROM m{k} WHERE k < 45)), "
            f"c{k} AS (SELECT p[list_position(d, list_max(d))] AS c FROM (SELECT p, list_transform(range(1, {n + 1}), lambda i: p[i][i]) AS d FROM m{k} WHERE k = 45)), "
            f"u{k} AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM c{k}), "
            f"e{k} AS (SELECT v, list_dot_product(v, list_transform(range(1, {n + 1}), lambda i: list_dot_product(g[i], v))) AS value FROM u{k}, {gram})")


def deflated(gram: str, n: int, k: int) -> str:
    """Table ``g{k}(g)``: ``gram`` without its first eigenvector ``e{k}``."""
    return f"g{k} AS (SELECT list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: g[i][j] - value * v[i] * v[j])) AS g FROM {gram}, e{k})"


def nnls3(g: str = "g", b: str = "b") -> str:
    """The non-negative minimum of ``w'Gw/2 - b'w`` for three weights: the best of all supports' solutions that are feasible.
    ``g`` and ``b`` are prefixes of columns ``g_0_0, ..., g_2_2`` and ``b_0, b_1, b_2``; a list of three."""
    G = lambda i, j: f"{g}_{min(i, j)}_{max(i, j)}"
    B = lambda i: f"{b}_{i}"
    det2 = lambda i, j: f"({G(i, i)} * {G(j, j)} - {G(i, j)} * {G(i, j)})"
    det3 = lambda m: (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) "  # noqa: E731
                      f"+ {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")
    whole = [[G(i, j) for j in range(3)] for i in range(3)]
    cramer = [f"{det3([[B(i) if j == k else whole[i][j] for j in range(3)] for i in range(3)])} / {det3(whole)}" for k in range(3)]
    supports = [["0.0::DOUBLE"] * 3, cramer]
    for i in range(3):
        supports.append([f"{B(i)} / {G(i, i)}" if k == i else "0.0::DOUBLE" for k in range(3)])
        for j in range(i + 1, 3):
            one = {i: f"({B(i)} * {G(j, j)} - {B(j)} * {G(i, j)}) / {det2(i, j)}", j: f"({B(j)} * {G(i, i)} - {B(i)} * {G(i, j)}) / {det2(i, j)}"}
            supports.append([one.get(k, "0.0::DOUBLE") for k in range(3)])
    lists = ", ".join(f"[{', '.join(s)}]" for s in supports)
    square = " + ".join(f"w[{i + 1}] * w[{j + 1}] * {G(i, j)}" for i in range(3) for j in range(3))
    linear = " + ".join(f"w[{i + 1}] * {B(i)}" for i in range(3))
    cost = f"({square}) / 2 - ({linear})"
    feasible = f"list_filter([{lists}], lambda w: list_min(w) >= 0)"
    return f"list_reduce({feasible}, lambda a, z: CASE WHEN {cost.replace('w[', 'a[')} <= {cost.replace('w[', 'z[')} THEN a ELSE z END)"


def t_critical(alpha: str, df: str, points: int = 400) -> str:
    """The t beyond which both tails hold ``alpha``, by bisection: a list of steps folded over the interval's ends."""
    start = "{'lo': 0.0::DOUBLE, 'hi': 60.0::DOUBLE}"
    middle = "((e.lo + e.hi) / 2)"
    fold = f"CASE WHEN {t_pvalue(middle, df, points)} > {alpha} THEN {{'lo': {middle}, 'hi': e.hi}} ELSE {{'lo': e.lo, 'hi': {middle}}} END"
    steps = f"list_prepend({start}, list_transform(range(0, 60), lambda s: {start}))"
    return f"list_reduce({steps}, lambda e, s: {fold}).lo"


def nct_tail(t: str, df: str, shift: str, points: int = 400) -> str:
    """Upper tail of the non-central t: the normal tail of ``t * s - shift`` over the chi density of ``s``."""
    low, width = f"greatest(1e-9::DOUBLE, 1 - 10 / sqrt(2 * {df}))", f"(1 + 10 / sqrt(2 * {df}) - greatest(1e-9::DOUBLE, 1 - 10 / sqrt(2 * {df})))"
    s = f"({low} + {width} * i / {points})"
    density = f"exp(ln(2.0::DOUBLE) + {df} / 2 * ln({df} / 2) - lgamma({df} / 2) + ({df} - 1) * ln({s}) - {df} * {s} * {s} / 2)"
    z = f"greatest(-8.0::DOUBLE, least(8.0::DOUBLE, {t} * {s} - {shift}))"
    term = f"{density} * (1 - {normal_cdf(z, 'j')})"
    return f"({width} / {points} * {_simpson(term, points)})"
