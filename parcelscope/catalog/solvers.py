"""Iterative methods in SQL, independent of the Spark code: Newton's method, clusters, leading axes."""

from __future__ import annotations

from collections.abc import Sequence


def newton_sql(source: str, features: Sequence[str], standardise: bool, at: str, rounds: int = 14) -> str:
    """Tables nx{at} (order_id, y, x: the features, scaled if wanted, and 1) and rw{at} (w: the weights and the intercept).

    Each round forms gradient and curvature of the penalised loss from the rows and solves the system by
    Gauss-Jordan elimination of a list of lists. The penalty is |weights|^2 / 2.
    """
    d = len(features)
    scaled = [f"coalesce(({f} - m{i}) / nullif(s{i}, 0), 0)" if standardise else f"{f}::DOUBLE" for i, f in enumerate(features)]
    moments = ", ".join(f"avg({f}) AS m{i}, stddev_samp({f}) AS s{i}" for i, f in enumerate(features))
    entry = lambda i, j: f"sum(p * (1 - p) * x[{i}] * x[{j}])" + (" + 1" if i == j <= d else "")
    rows = ", ".join("[" + ", ".join([*(entry(i, j) for j in range(1, d + 2)),
                                      f"sum((p - y) * x[{i}])" + (f" + w[{i}]" if i <= d else "")]) + "]" for i in range(1, d + 2))
    solve = f"""SELECT k, w, [{rows}] AS m FROM (SELECT k, w, x, y, 1 / (1 + exp(-list_dot_product(x, w))) AS p
        FROM rw_{at}, nx{at} WHERE k < {rounds}) e GROUP BY k, w"""
    for p in range(1, d + 2):
        solve = f"""SELECT k, w, list_transform(m, lambda r, i: CASE WHEN i = {p} THEN list_transform(r, lambda v: v / m[{p}][{p}])
            ELSE list_transform(r, lambda v, j: v - r[{p}] / m[{p}][{p}] * m[{p}][j]) END) AS m FROM ({solve}) e{p}"""
    return f"""mo{at} AS MATERIALIZED (SELECT {moments} FROM {source}),
    nx{at} AS MATERIALIZED (SELECT order_id, label::DOUBLE AS y, [{", ".join(scaled)}, 1.0::DOUBLE] AS x FROM {source}, mo{at}),
    rw_{at} AS (SELECT 0 AS k, list_transform(range({d + 1}), lambda i: 0.0::DOUBLE) AS w UNION ALL
        SELECT k + 1, list_transform(w, lambda v, i: v - m[i][{d + 2}]) FROM ({solve}) s),
    rw{at} AS MATERIALIZED (SELECT w FROM rw_{at} WHERE k = {rounds})"""


def clusters_sql(source: str, key: str, features: Sequence[str], ks: Sequence[int], at: str, rounds: int = 100,
                 starts: int = 10) -> str:
    """Tables kx{at} (key, x: the scaled features) and kb{at} (k, cs: the best centres, inertia).

    Rows at places s k .. s k + k - 1 in the order of the hash of their key are the centres of start s; each round moves
    all centres of all starts to the mean of their rows.
    """
    scaled = ", ".join(f"coalesce((f{i} - m{i}) / nullif(s{i}, 0), 0)" for i in range(len(features)))
    filled = ", ".join(f"coalesce({f}, 0)::DOUBLE AS f{i}" for i, f in enumerate(features))
    moments = ", ".join(f"avg(f{i}) AS m{i}, stddev_samp(f{i}) AS s{i}" for i in range(len(features)))
    means = ", ".join(f"avg(x[{i + 1}])" for i in range(len(features)))
    far = "list_transform(cs, lambda c: list_sum(list_transform(c, lambda v, i: (v - x[i]) * (v - x[i]))))"
    return f"""kf{at} AS MATERIALIZED (SELECT {key} AS key, {filled} FROM {source}), kz{at} AS (SELECT {moments} FROM kf{at}),
    kx{at} AS MATERIALIZED (SELECT key, [{scaled}] AS x, row_number() OVER (ORDER BY md5(key::VARCHAR), key) - 1 AS place,
        count(*) OVER () AS n FROM kf{at}, kz{at}),
    km{at} AS (SELECT 0 AS r, k, s, list(x ORDER BY c) AS cs FROM (SELECT unnest({list(ks)}) AS k) a, range({starts}) b(s), range({max(ks)}) d(c),
        kx{at} WHERE c < least(k, n) AND place = (s * k + c) % least(n, {starts * max(ks)}) GROUP BY k, s
        UNION ALL SELECT r + 1, k, s, list_transform(cs, lambda v, i: coalesce(m[i], v)) FROM (
            SELECT r, k, s, cs, map_from_entries(list((c, mean))) AS m FROM (
                SELECT r, k, s, cs, c, [{means}] AS mean FROM (
                    SELECT r, k, s, cs, x, list_position(ds, list_min(ds)) AS c FROM (
                        SELECT r, k, s, cs, x, {far} AS ds FROM km{at}, kx{at} WHERE r < {rounds}) e1) e2
                GROUP BY r, k, s, cs, c) e3 GROUP BY r, k, s, cs) e4),
    ki{at} AS (SELECT k, s, cs, sum(list_min({far})) AS inertia FROM km{at}, kx{at} WHERE r = {rounds} GROUP BY k, s, cs),
    kb{at} AS MATERIALIZED (SELECT k, list_sort(arg_min(cs, (round(inertia, 9), s))) AS cs, min(inertia) AS inertia FROM ki{at} GROUP BY k)"""


def assigned_sql(k: int, at: str) -> str:
    """Table ka{at} (key, cluster): the nearest of the k best centres, counted from 0."""
    return f"""ka{at} AS MATERIALIZED (SELECT key, list_position(ds, list_min(ds))::INT - 1 AS cluster FROM (SELECT key, list_transform(cs,
        lambda c: list_sum(list_transform(c, lambda v, i: (v - x[i]) * (v - x[i])))) AS ds FROM kb{at}, kx{at} WHERE k = {k}) e)"""


def axes_sql(width: int, at: str, rounds: int = 50) -> str:
    """Table ax{at} (v1, v2, e1, e2): main axes of kx{at} and the share of the variance each explains.

    The matrix of products, squared again and again, turns into the projector on its main axis; the second axis comes from
    what is left without the first.
    """
    cell = lambda i, j: f"sum(x[{i}] * x[{j}]) / greatest(count(*) - 1, 1)"
    rows = ", ".join("[" + ", ".join(cell(i, j) for j in range(1, width + 1)) + "]" for i in range(1, width + 1))
    trace = lambda m: "(" + " + ".join(f"{m}[{i}][{i}]" for i in range(1, width + 1)) + ")"
    each = f"range(1, {width + 1})"

    def axis(name: str, matrix: str) -> str:
        biggest = f"list_position(list_transform({each}, lambda i: p[i][i]), list_max(list_transform({each}, lambda i: p[i][i])))"
        return f"""{name}_ AS (SELECT 0 AS r, m AS p FROM {matrix} UNION ALL
        SELECT r + 1, list_transform(q, lambda w: list_transform(w, lambda v: v / {trace("q")})) FROM (SELECT r, list_transform({each},
            lambda i: list_transform({each}, lambda j: list_dot_product(p[i], p[j]))) AS q FROM {name}_ WHERE r < {rounds}) e),
    {name} AS MATERIALIZED (SELECT list_transform(v, lambda w: w / sqrt(list_dot_product(v, v)) * sign(v[list_position(
        list_transform(v, lambda u: round(abs(u), 9)), list_max(list_transform(v, lambda u: round(abs(u), 9))))])) AS v
        FROM (SELECT p[{biggest}] AS v FROM {name}_ WHERE r = {rounds}) e)"""

    share = f"list_dot_product(v, list_transform(m, lambda w: list_dot_product(w, v)))"
    return f"""ma{at} AS MATERIALIZED (SELECT [{rows}] AS m FROM kx{at}), {axis(f"va{at}", f"ma{at}")},
    mb{at} AS MATERIALIZED (SELECT list_transform(m, lambda w, i: list_transform(w, lambda u, j: u - l * v[i] * v[j])) AS m
        FROM (SELECT m, v, {share} AS l FROM ma{at}, va{at}) e), {axis(f"vb{at}", f"mb{at}")},
    ax{at} AS MATERIALIZED (SELECT a.v AS v1, b.v AS v2, (SELECT {share} / {trace("m")} FROM ma{at}, va{at}) AS e1,
        (SELECT {share} / {trace("m")} FROM ma{at}, vb{at}) AS e2 FROM va{at} a, vb{at} b)"""
