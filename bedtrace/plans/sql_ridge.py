"""SQL of ridge fits for the checks: centred normal equations, solved by generated elimination steps.

A fit with coefficients >= 0 is the best of the unconstrained fits over the subsets of its members whose coefficients are
all >= 0, so the SQL side solves every subset.
"""

from __future__ import annotations

from collections.abc import Sequence


def sql_moments(cols: Sequence[str], y: str, source: str, keys: str = "f", name: str = "mo") -> str:
    """CTE ``name``: mean and centred sums of the columns (``m_i``, ``g_i_j``, ``c_i``) and of ``y`` (``my``) per key."""
    k = range(len(cols))
    parts = [f"avg({y}) AS my", *[f"avg({cols[i]}) AS m_{i}" for i in k], *[f"covar_pop({cols[i]}, {y}) * count(*) AS c_{i}" for i in k]]
    parts += [f"covar_pop({cols[i]}, {cols[j]}) * count(*) AS g_{i}_{j}" for i in k for j in k if j >= i]
    return f"{name} AS (SELECT {keys}, {', '.join(parts)} FROM {source} GROUP BY {keys})"


def sql_solved(members: Sequence[int], size: int, alphas: Sequence[float], keys: str = "f", moments: str = "mo", name: str = "s") -> list[str]:
    """CTEs that solve the ridge fit on ``members`` (numbers below ``size``); the last one, ``name``, has ``w_0 ..``, the
    others' coefficients being 0, and ``gain``, the part of the objective the fit removes."""
    g = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    first = [f"{g(i, j)}{' + alpha' if i == j else ''} AS a_{i}_{j}" for i in members for j in members] + [f"c_{i} AS b_{i}" for i in members]
    steps = [f"{name}_0 AS (SELECT {keys}, alpha, {', '.join(first)} FROM {moments} CROSS JOIN (SELECT unnest({[float(a) for a in alphas]}::DOUBLE[]) AS alpha))"]
    for n, p in enumerate(members):
        out = []
        for i in members:
            less = (lambda c, at: c) if i == p else (lambda c, at: f"{c} - a_{i}_{p} / a_{p}_{p} * {at}")
            out += [f"{less(f'a_{i}_{j}', f'a_{p}_{j}')} AS a_{i}_{j}" for j in members] + [f"{less(f'b_{i}', f'b_{p}')} AS b_{i}"]
        steps.append(f"{name}_{n + 1} AS (SELECT {keys}, alpha, {', '.join(out)} FROM {name}_{n})")
    w = [f"b_{i} / a_{i}_{i} AS w_{i}" if i in members else f"CAST(0 AS DOUBLE) AS w_{i}" for i in range(size)]
    gain = " + ".join(f"b_{i} / a_{i}_{i} * c_{i}" for i in members)
    on = ", ".join(k.strip() for k in keys.split(","))
    steps.append(f"{name} AS (SELECT {keys}, alpha, {', '.join(w)}, {gain} AS gain FROM {name}_{len(members)} JOIN {moments} USING ({on}))")
    return steps


def sql_subsets(size: int, alphas: Sequence[float], keys: str = "f") -> str:
    """CTE ``sub``: the fit of every non-empty subset, ``mask`` having bit i for member i, where no coefficient is negative;
    the empty fit is always among them."""
    ctes, rows = [], [f"SELECT {keys}, alpha, {', '.join(f'CAST(0 AS DOUBLE) AS w_{i}' for i in range(size))}, CAST(0 AS DOUBLE) AS gain, 0 AS mask FROM s1"]
    for mask in range(1, 2**size):
        ctes += sql_solved([i for i in range(size) if mask >> i & 1], size, alphas, keys, name=f"s{mask}")
        rows.append(f"SELECT *, {mask} AS mask FROM s{mask} WHERE " + " AND ".join(f"w_{i} >= 0" for i in range(size)))
    return ", ".join(ctes) + f", sub AS ({' UNION ALL '.join(rows)})"


def sql_prediction(cols: Sequence[str]) -> str:
    return "my + " + " + ".join(f"w_{i} * ({c} - m_{i})" for i, c in enumerate(cols))
