"""SQL for the segmentation queries."""

from __future__ import annotations

from skarn.plans.oracle.views import _values, with_views
from skarn.plans.segmentation import START

_CENTROIDS = f"SELECT * FROM (VALUES {_values([(i, *c) for i, c in enumerate(START)])}) AS t(cluster, cx, cy)"


def _nearest(centroids: str) -> str:
    return f"""
    SELECT id, income, spend, cluster::INTEGER AS cluster, d FROM (
      SELECT p.*, c.cluster, pow(income - cx, 2) + pow(spend - cy, 2) AS d,
             row_number() OVER (PARTITION BY id ORDER BY pow(income - cx, 2) + pow(spend - cy, 2), c.cluster) AS rn
      FROM v_customers p, {centroids} c) WHERE rn = 1"""


def _means(assigned: str, before: str) -> str:
    return f"""
    SELECT c.cluster, coalesce(m.cx, c.cx) AS cx, coalesce(m.cy, c.cy) AS cy FROM {before} c
    LEFT JOIN (SELECT cluster, avg(income) AS cx, avg(spend) AS cy FROM {assigned} GROUP BY 1) m USING (cluster)"""


_BASE = {"c0": _CENTROIDS, "assigned": _nearest("c0")}
_LLOYD = {"c0": _CENTROIDS}
for _step in (1, 2, 3):
    _LLOYD[f"a{_step}"] = _nearest(f"c{_step - 1}")
    _LLOYD[f"c{_step}"] = _means(f"a{_step}", f"c{_step - 1}")
_LLOYD["a4"] = _nearest("c3")


def _sql(body: str, extra: dict[str, str] = _BASE) -> str:
    return with_views(["v_customers"], body, extra=extra)




def _fit(seed: int, ks: range) -> dict[str, str]:
    """Starts drawn by hash, each the farthest from those before it; then steps until no centroid of a k moves far."""
    parts = {
        "drawn": f"""SELECT income, spend, row_number() OVER (ORDER BY h, income, spend) AS place
            FROM (SELECT *, md5('{seed}:' || id::VARCHAR) AS h FROM v_customers ORDER BY h, income, spend LIMIT 1024)""",
        "s0": "SELECT income AS cx, spend AS cy FROM drawn WHERE place = 1",
        "far": "SELECT tol FROM (SELECT sqrt(1e-4 * (var_pop(income) + var_pop(spend)) / 2) AS tol FROM v_customers)",
    }
    for j in range(1, max(ks)):
        near = ", ".join(f"pow(income - s{i}.cx, 2) + pow(spend - s{i}.cy, 2)" for i in range(j))
        before = ", ".join(f"s{i}" for i in range(j))
        parts[f"s{j}"] = f"SELECT income AS cx, spend AS cy FROM drawn, {before} ORDER BY least({near}) DESC, place LIMIT 1"
    every = " UNION ALL ".join(f"SELECT {j} AS cluster, cx, cy FROM s{j}" for j in range(max(ks)))
    wanted = ", ".join(f"({k})" for k in ks)
    parts["walk"] = f"""
        SELECT 0 AS step, k, cluster, cx, cy, true AS moving FROM (VALUES {wanted}) AS t(k), ({every}) WHERE cluster < k
        UNION ALL
        SELECT step + 1, k, cluster, nx, ny, max(sqrt(pow(nx - cx, 2) + pow(ny - cy, 2))) OVER (PARTITION BY k) > tol
        FROM (
          SELECT w.*, coalesce(m.mx, w.cx) AS nx, coalesce(m.my, w.cy) AS ny FROM walk w LEFT JOIN (
            SELECT k, cluster, avg(income) AS mx, avg(spend) AS my FROM (
              SELECT c.k, income, spend, arg_min(c.cluster, (pow(income - cx, 2) + pow(spend - cy, 2), c.cluster)) AS cluster
              FROM v_customers p, walk c GROUP BY c.k, p.id, income, spend) GROUP BY ALL) m
          ON m.k = w.k AND m.cluster = w.cluster WHERE w.moving AND w.step < 300), far"""
    parts["fitted"] = "SELECT k, cluster, cx, cy FROM (SELECT *, max(step) OVER (PARTITION BY k) AS last FROM walk) WHERE step = last"
    return parts


def _recursive(body: str, parts: dict[str, str]) -> str:
    return with_views(["v_customers"], body, recursive=True, extra=parts)


SQL = {
    "kmeans_elbow": _recursive(
        """SELECT k::INTEGER AS k, round(sum(d), -2) AS wcss FROM (
          SELECT k, p.id, min(pow(income - cx, 2) + pow(spend - cy, 2)) AS d FROM v_customers p, fitted GROUP BY ALL) GROUP BY 1""",
        _fit(42, range(1, 11)),
    ),
    "kmeans_segments": _recursive(
        """SELECT id, income, spend, arg_min(c, (pow(income - cx, 2) + pow(spend - cy, 2), c))::INTEGER AS cluster
        FROM v_customers, (SELECT cx, cy, row_number() OVER (ORDER BY cx, cy) - 1 AS c FROM fitted) GROUP BY ALL""",
        _fit(0, range(5, 6)),
    ),
    "assign_fixed_centroids": _sql("SELECT id, cluster, round(d, 3) AS sq_dist FROM assigned"),
    "wcss_fixed_centroids": _sql("SELECT round(sum(d), 1) AS wcss, count(*) AS n FROM assigned"),
    "centroid_means": _sql(
        """SELECT cluster, count(*) AS n, round(avg(income), 5) AS mean_income, round(avg(spend), 5) AS mean_spend
        FROM assigned GROUP BY 1"""
    ),
    "cluster_members": _sql("SELECT id, cluster, income, spend FROM assigned WHERE cluster = 1"),
    "segment_profile": _sql(
        """SELECT cluster, count(*) AS n,
          round(avg(income), 5) AS mean_income, round(stddev_samp(income), 5) AS std_income,
          min(income) AS min_income, max(income) AS max_income,
          round(avg(spend), 5) AS mean_spend, round(stddev_samp(spend), 5) AS std_spend,
          min(spend) AS min_spend, max(spend) AS max_spend,
          CASE WHEN avg(income) >= (SELECT avg(income) FROM assigned) THEN 'High income' ELSE 'Low income' END || ' / ' ||
          CASE WHEN avg(spend) >= (SELECT avg(spend) FROM assigned) THEN 'High spend' ELSE 'Low spend' END AS persona
        FROM assigned GROUP BY cluster"""
    ),
    "cluster_bins": _sql(
        """SELECT 'cell' AS kind, cluster, floor(income / 500) * 500 AS x, floor(spend / 250) * 250 AS y, count(*) AS n
        FROM assigned GROUP BY ALL
        UNION ALL SELECT 'centroid', cluster::INTEGER, cx::DOUBLE, cy::DOUBLE, NULL::BIGINT FROM c0"""
    ),
    "elbow_k1": with_views(
        ["v_customers"],
        """SELECT 1::INTEGER AS k, round(sum(pow(income - mx, 2) + pow(spend - my, 2)), 1) AS wcss
        FROM v_customers, (SELECT avg(income) AS mx, avg(spend) AS my FROM v_customers)""",
    ),
    "kmeans_lloyd_3": _sql(
        """SELECT cluster, count(*) AS n, round(avg(income), 4) AS mean_income, round(avg(spend), 4) AS mean_spend,
        round(sum(d), 1) AS wcss FROM a4 GROUP BY 1""",
        _LLOYD,
    ),
}
