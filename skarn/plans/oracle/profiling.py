"""SQL for the inspection, projection and predicate queries."""

from __future__ import annotations

from skarn.plans.oracle.views import with_views

_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_REVIEW_COLUMNS = [("Id", "bigint"), ("Score", "int"), ("Text", "string"), ("lang", "string")]


def _describe() -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, count({c}) AS "count", round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,
        round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50,
        round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max FROM lineitem"""
        for c in _LINE_NUMBERS
    ]
    return "\nUNION ALL\n".join(parts)


def _correlation() -> str:
    parts = []
    for a in _LINE_NUMBERS:
        for b in _LINE_NUMBERS:
            r = "1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 6)"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM lineitem" + (" LIMIT 1" if a == b else ""))
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


def _profile() -> str:
    parts = [
        f"""SELECT {i}::INTEGER AS position, '{c}' AS column_name, '{t}' AS dtype, count("{c}") AS non_null FROM v_reviews"""
        for i, (c, t) in enumerate(_REVIEW_COLUMNS)
    ]
    return "\nUNION ALL\n".join(parts)


def _nulls() -> str:
    parts = [
        f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS n_missing FROM v_reviews""" for c, _ in _REVIEW_COLUMNS
    ]
    return "\nUNION ALL\n".join(parts)


SQL = {
    "preview": with_views(["v_customers"], "SELECT * FROM v_customers ORDER BY id LIMIT 5"),
    "table_shape": with_views(["v_customers"], "SELECT count(*) AS n_rows, 4::INTEGER AS n_cols FROM v_customers"),
    "column_profile": with_views(["v_reviews"], _profile()),
    "null_counts": with_views(["v_reviews"], _nulls()),
    "describe_numeric": _describe(),
    "correlation_matrix": _correlation(),
    "project_named": with_views(["v_prices"], 'SELECT series_id, dt, "close" FROM v_prices'),
    "project_positional": with_views(["v_customers"], "SELECT income, spend FROM v_customers"),
    "project_numeric": f"SELECT {', '.join(_LINE_NUMBERS)} FROM lineitem",
    "review_sample": with_views(["v_reviews"], 'SELECT * FROM v_reviews ORDER BY "Id" LIMIT 500'),
    "row_at": with_views(
        ["v_reviews"],
        'SELECT "Id", "Text" FROM (SELECT *, row_number() OVER (ORDER BY "Id") - 1 AS i FROM v_reviews) WHERE i = 50',
    ),
    "filter_by_rating": with_views(["v_reviews"], 'SELECT * FROM v_reviews WHERE "Score" = 1'),
    "rating_counts": with_views(
        ["v_reviews"], 'SELECT "Score", count(*) AS n FROM v_reviews WHERE "Score" IS NOT NULL GROUP BY 1'
    ),
    "date_range_open": with_views(
        ["v_prices"], "SELECT * FROM v_prices WHERE dt > DATE '1996-01-01' AND dt < DATE '1997-01-01'"
    ),
    "date_range_closed": with_views(
        ["v_prices"], "SELECT * FROM v_prices WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'"
    ),
    "parse_dates": with_views(
        ["v_date_text"],
        """SELECT id, strptime(s, '%Y-%m-%d')::DATE AS parsed, try_strptime(s, '%Y-%m-%d')::DATE AS tried,
        s::DATE AS general, (strptime(s, '%Y-%m-%d') + INTERVAL 7 DAY)::DATE AS week_later FROM v_date_text""",
    ),
    "date_parts": with_views(
        ["v_date_text"],
        """SELECT id, split_part(s, '-', 1)::INTEGER AS "year", split_part(s, '-', 2)::INTEGER AS "month",
        split_part(s, '-', 3)::INTEGER AS "day" FROM v_date_text""",
    ),
    "dedup_last_wins": """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
}
