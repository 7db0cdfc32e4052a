"""SQL text for the DuckDB twins: ranks, tail probabilities by quadrature, and models by determinants."""

from __future__ import annotations

from collections.abc import Sequence


def _simpson(value: str, steps: int, variable: str = "i") -> str:
    """Sum of ``value`` at 0..steps with Simpson's weights."""
    weight = f"(CASE WHEN {variable} = 0 OR {variable} = {steps} THEN 1 WHEN {variable} % 2 = 1 THEN 4 ELSE 2 END)"
    return f"list_sum(list_transform(range(0, {steps + 1}), lambda {variable}: {weight} * {value}))"


def normal_sf(z: str, steps: int = 200) -> str:
    return f"(0.5 - ({z}) * {_simpson(f'exp(-pow(({z}) * i / {steps}.0, 2) / 2)', steps)} / {3 * steps}.0 / sqrt(2 * pi()))"


def chi2_sf(x: str, df: str, steps: int = 400) -> str:
    at = f"(sqrt({x}) * i / {steps}.0)"
    density = f"pow({at}, ({df}) - 1) * exp(-pow({at}, 2) / 2)"
    return f"(1 - 2 * sqrt({x}) * {_simpson(density, steps)} / {3 * steps}.0 * exp(-({df}) / 2.0 * ln(2) - lgamma(({df}) / 2.0)))"


def t_two_sided(t: str, df: str, steps: int = 400) -> str:
    end = f"atan(least(abs({t}), 12) / sqrt(({df})::DOUBLE))"
    area = _simpson(f"pow(cos({end} * i / {steps}.0), ({df}) - 1)", steps)
    return f"greatest(0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {end} * {area} / {3 * steps}.0)"


def correlation_p(r: str, n: str) -> str:
    return t_two_sided(f"(({r}) * sqrt((({n}) - 2) / (1 - ({r}) * ({r}))))", f"(({n}) - 2)")


def u_p(u: str, n1: str, n2: str, ties: str, alternative: str = "two-sided") -> str:
    """Normal approximation with corrections for ties and continuity."""
    top = {"greater": u, "less": f"({n1} * {n2} - {u})"}.get(alternative, f"greatest({u}, {n1} * {n2} - {u})")
    var = f"({n1} * {n2} / 12.0 * (({n1} + {n2} + 1) - {ties} / (({n1} + {n2}) * ({n1} + {n2} - 1.0))))"
    p = normal_sf(f"(({top} - {n1} * {n2} / 2.0 - 0.5) / sqrt({var}))")
    return p if alternative in ("greater", "less") else f"least(1, 2 * {p})"


def fisher_p(a: str, b: str, c: str, d: str, alternative: str = "two-sided") -> str:
    row, col, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"

    def choose(m: str, k: str) -> str:
        return f"(lgamma(({m}) + 1.0) - lgamma(({k}) + 1.0) - lgamma(({m}) - ({k}) + 1.0))"

    def log_p(k: str) -> str:
        return f"({choose(col, k)} + {choose(f'{n} - {col}', f'{row} - {k}')} - {choose(n, row)})"

    if alternative == "greater":
        return f"least(1, list_sum(list_transform(range({a}, least({row}, {col}) + 1), lambda k: exp({log_p('k')}))))"
    every = f"list_filter(list_transform(range(greatest(0, {row} + {col} - {n}), least({row}, {col}) + 1), lambda k: {log_p('k')}), lambda x: x <= {log_p(a)} + 1e-7)"
    return f"least(1, list_sum(list_transform({every}, lambda x: exp(x))))"


def _scattered(rows: str, name: str, start: str) -> str:
    """``rows`` with a column ``name``: the 32-bit mix of ``start``, step by step."""
    at = f"SELECT *, CAST({start} AS UBIGINT) AS {name} FROM {rows}"
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        at = f"SELECT * REPLACE (xor({name}, {name} >> {shift}) AS {name}) FROM ({at})"
        if factor:
            at = f"SELECT * REPLACE (({name} * {factor}::UBIGINT) % 4294967296::UBIGINT AS {name}) FROM ({at})"
    return f"({at})"


def draws(rows: str, low: int, high: int, key: str = "gene", seed: int = 42) -> str:
    """``rows`` for each replicate low..high with ``draw``, a 32-bit number made of hashes of key and replicate."""
    replicates = _scattered(f"(SELECT unnest(range({low}, {high + 1})) AS replicate)", "mixed", "replicate")
    keyed = f"(SELECT *, CAST(('0x' || substr(md5(concat({key}, '|{seed}')), 1, 8)) AS UBIGINT) AS h FROM {rows})"
    return f"(SELECT * EXCLUDE (h, mixed) FROM {_scattered(f'(SELECT * FROM {keyed}, {replicates})', 'draw', 'xor(h, mixed)')})"


def det(m: Sequence[Sequence[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    parts = []
    for j, x in enumerate(m[0]):
        minor = det([[*row[:j], *row[j + 1 :]] for row in m[1:]])
        parts.append(f"{'-' if j % 2 else '+'} {x} * ({minor})")
    return " ".join(parts).removeprefix("+ ")


def _solved(h: list[list[str]], g: list[str]) -> tuple[list[str], list[str], str]:
    """Numerators of the solution and of the inverse's diagonal, and the determinant."""
    k = len(h)
    swap = lambda i: [[g[r] if c == i else h[r][c] for c in range(k)] for r in range(k)]
    minor = lambda i: [[h[r][c] for c in range(k) if c != i] for r in range(k) if r != i]
    return [det(swap(i)) for i in range(k)], [det(minor(i)) if k > 1 else "1.0" for i in range(k)], det(h)


def _h(k: int) -> list[list[str]]:
    return [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]


def ols(name: str, rows: str, xs: Sequence[str], by: str, least: int = 20) -> str:
    """CTEs ending in ``name``: by, n, k, b<i>, se<i>, r2, adj_r2, llf, aic of y on 1 and xs for the rows (by, y, xs)."""
    cols = ["1.0", *xs]
    k = len(cols)
    sums = ", ".join(f"sum({cols[i]} * {cols[j]}) AS h{i}{j}" for i in range(k) for j in range(i, k))
    g = ", ".join(f"sum({c} * y) AS g{i}" for i, c in enumerate(cols))
    b, v, d = _solved(_h(k), [f"g{i}" for i in range(k)])
    live = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    return f"""{name}_s AS (SELECT {by}, count(*) AS n, sum(y) AS sy, sum(y * y) AS yy, {sums}, {g} FROM {rows} WHERE {live} GROUP BY {by} HAVING count(*) >= {least}),
{name}_b AS (SELECT *, {d} AS d, {', '.join(f'({x}) / ({d}) AS b{i}' for i, x in enumerate(b))}, {', '.join(f'({x}) / ({d}) AS v{i}' for i, x in enumerate(v))} FROM {name}_s),
{name}_r AS (SELECT *, yy - ({' + '.join(f'b{i} * g{i}' for i in range(k))}) AS rss, yy - sy * sy / n AS tss, {k} AS k FROM {name}_b),
{name} AS (SELECT {by}, n, k, {', '.join(f'b{i}, sqrt(v{i} * rss / (n - k)) AS se{i}' for i in range(k))}, 1 - rss / tss AS r2, 1 - rss / tss * (n - 1) / (n - k) AS adj_r2, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS llf, 2 * k + n * (ln(2 * pi() * rss / n) + 1) AS aic FROM {name}_r)"""


def logit(name: str, rows: str, xs: Sequence[str], by: str, least: int = 20, positive: int = 5, steps: int = 12) -> str:
    """CTEs ending in ``name``: by, n, pos, b<i>, se<i> of a logistic model of y (0, 1) for the rows (by, y, xs)."""
    cols = ["1.0", *xs]
    k = len(cols)
    b, v, d = _solved(_h(k), [f"g{i}" for i in range(k)])
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(cols))
    live = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    hess = ", ".join(f"sum({cols[i]} * {cols[j]} * pr * (1 - pr)) AS h{i}{j}" for i in range(k) for j in range(i, k))
    grad = ", ".join(f"sum({c} * (y - pr)) AS g{i}" for i, c in enumerate(cols))
    out = [f"{name}_0 AS MATERIALIZED (SELECT {by}, count(*) AS n, sum(y) AS pos, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM {rows} WHERE {live} GROUP BY {by} HAVING count(*) >= {least} AND least(sum(y), count(*) - sum(y)) >= {positive})"]
    for s in range(1, steps + 1):
        out.append(f"{name}_h{s} AS MATERIALIZED (SELECT {by}, {hess}, {grad} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS pr FROM {rows} JOIN {name}_{s - 1} USING ({by}) WHERE {live}) GROUP BY {by})")
        out.append(f"{name}_{s} AS MATERIALIZED (SELECT {by}, n, pos, {', '.join(f'b{i} + ({x}) / ({d}) AS b{i}' for i, x in enumerate(b))}, {', '.join(f'sqrt(({x}) / ({d})) AS se{i}' for i, x in enumerate(v))} FROM {name}_{s - 1} JOIN {name}_h{s} USING ({by}))")
    out.append(f"{name} AS (SELECT * FROM {name}_{steps})")
    return ",\n".join(out)


def firth(name: str, rows: str, xs: Sequence[str], by: str, least: int = 20, positive: int = 5, steps: int = 30) -> str:
    """As ``logit``, by the score of the penalised likelihood: rows count as y + h / 2 of 1 + h trials, h being their leverage."""
    cols = ["1.0", *xs]
    k = len(cols)
    h = _h(k)
    b, v, d = _solved(h, [f"g{i}" for i in range(k)])

    def cofactor(i: int, j: int) -> str:
        minor = [[h[r][c] for c in range(k) if c != j] for r in range(k) if r != i]
        return f"{'-' if (i + j) % 2 else ''}({det(minor) if k > 1 else '1.0'})"

    inverse = ", ".join(f"{cofactor(i, j)} / ({d}) AS v{i}{j}" for i in range(k) for j in range(i, k))
    lever = " + ".join(f"{cols[i]} * {cols[j]} * v{min(i, j)}{max(i, j)}" for i in range(k) for j in range(k))
    eta = " + ".join(f"b{i} * {c}" for i, c in enumerate(cols))
    live = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    hess = ", ".join(f"sum({cols[i]} * {cols[j]} * pr * (1 - pr)) AS h{i}{j}" for i in range(k) for j in range(i, k))
    grad = ", ".join(f"sum({c} * (y - pr + pr * (1 - pr) * ({lever}) * (0.5 - pr))) AS g{i}" for i, c in enumerate(cols))
    out = [f"{name}_0 AS MATERIALIZED (SELECT {by}, count(*) AS n, sum(y) AS pos, {', '.join(f'0.0::DOUBLE AS b{i}' for i in range(k))} FROM {rows} WHERE {live} GROUP BY {by} HAVING count(*) >= {least} AND least(sum(y), count(*) - sum(y)) >= {positive})"]
    for s in range(1, steps + 1):
        at = f"(SELECT *, 1 / (1 + exp(-({eta}))) AS pr FROM {rows} JOIN {name}_{s - 1} USING ({by}) WHERE {live})"
        out.append(f"{name}_h{s} AS MATERIALIZED (SELECT {by}, {hess} FROM {at} GROUP BY {by})")
        out.append(f"{name}_v{s} AS MATERIALIZED (SELECT *, {inverse} FROM {name}_h{s})")
        out.append(f"{name}_g{s} AS MATERIALIZED (SELECT {by}, {grad} FROM {at} JOIN {name}_v{s} USING ({by}) GROUP BY {by})")
        out.append(f"{name}_{s} AS MATERIALIZED (SELECT {by}, n, pos, {', '.join(f'b{i} + ({x}) / ({d}) AS b{i}' for i, x in enumerate(b))}, {', '.join(f'sqrt(v{i}{i}) AS se{i}' for i in range(k))} FROM {name}_{s - 1} JOIN {name}_v{s} USING ({by}) JOIN {name}_g{s} USING ({by}))")
    out.append(f"{name} AS (SELECT * FROM {name}_{steps})")
    return ",\n".join(out)


def logistic(name: str, rows: str, xs: Sequence[str], by: str, steps: int = 14) -> str:
    """CTEs ending in ``name``: by, n, pos, b<i>, se<i>, method; Firth's model where the last step of ``logit`` splits the outcomes."""
    cols = ["1.0", *xs]
    way = " + ".join(f"(late.b{i} - early.b{i}) * {c}" for i, c in enumerate(cols))
    live = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *xs))
    kept = f"{by}, n, pos, {', '.join(f'b{i}, se{i}' for i in range(len(cols)))}"
    return f"""{logit(f'{name}_m', rows, xs, by, steps=steps)},
{firth(f'{name}_f', rows, xs, by)},
{name}_w AS (SELECT {by}, max((2 * y - 1) * ({way})) AS good, max(-(2 * y - 1) * ({way})) AS bad FROM {rows} JOIN {name}_m_{steps} late USING ({by}) JOIN {name}_m_{steps - 1} early USING ({by}) WHERE {live} GROUP BY {by}),
{name} AS (SELECT {kept}, 'mle' AS method FROM {name}_m JOIN {name}_w USING ({by}) WHERE NOT (good > 0.1 AND bad <= 0.001 * good)
  UNION ALL SELECT {kept}, 'firth' FROM {name}_f JOIN {name}_w USING ({by}) WHERE good > 0.1 AND bad <= 0.001 * good)"""


def terms(name: str, names: Sequence[str], columns: str) -> str:
    """A row per group and term; ``columns`` may use term, coef, se and the model's own columns."""
    every = ", ".join(f"b{j}, se{j}" for j in range(len(names) + 1))
    parts = [f"SELECT '{n}' AS term, b{i} AS coef, se{i} AS se, * EXCLUDE ({every}) FROM {name}" for i, n in enumerate(["intercept", *names])]
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


def adjusted(rows: str, family: str = "1") -> str:
    """``rows`` with p_value at six decimals and p_adj, Benjamini-Hochberg within ``family``; null p count as 1."""
    return f"""SELECT * EXCLUDE (_p, _r, _m) REPLACE (round(greatest(p_value, 0.0), 6) AS p_value), round(least(1, min(_p * _m / _r) OVER (PARTITION BY {family} ORDER BY _p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adj FROM (
SELECT *, coalesce(greatest(p_value, 0.0), 1) AS _p, count(*) OVER (PARTITION BY {family} ORDER BY coalesce(greatest(p_value, 0.0), 1) RANGE UNBOUNDED PRECEDING) AS _r, count(*) OVER (PARTITION BY {family}) AS _m FROM ({rows}))"""


def p6(p: str) -> str:
    """A p-value at six decimals."""
    return f"round(greatest({p}, 0.0), 6)"


def leading(name: str, gram: str, squarings: int = 14) -> str:
    """CTEs ending in ``name``: i, v, l of the leading eigenvector and value of the symmetric table ``gram`` (i, j, w), by repeated squaring."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT i, j, w / (SELECT sqrt(sum(w * w)) FROM {gram}) AS w FROM {gram})"]
    for k in range(squarings):
        out.append(f"{name}_q{k} AS MATERIALIZED (SELECT a.i AS i, b.j AS j, sum(a.w * b.w) AS w FROM {name}_{k} a JOIN {name}_{k} b ON a.j = b.i GROUP BY ALL)")
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT i, j, w / (SELECT sqrt(sum(w * w)) FROM {name}_q{k}) AS w FROM {name}_q{k})")
    last = f"{name}_{squarings}"
    out.append(f"{name}_v AS MATERIALIZED (SELECT i, w / (SELECT sqrt(sum(w * w)) FROM {last} WHERE j = (SELECT arg_max(i, w) FROM {last} WHERE i = j)) AS v FROM {last} WHERE j = (SELECT arg_max(i, w) FROM {last} WHERE i = j))")
    out.append(f"{name} AS MATERIALIZED (SELECT i, v, (SELECT sum(a.v * w * b.v) FROM {gram} g JOIN {name}_v a ON a.i = g.i JOIN {name}_v b ON b.i = g.j) AS l FROM {name}_v)")
    return ",\n".join(out)
