"""The input views as common table expressions."""

from __future__ import annotations

from skarn.sources.views import LEXICON

_BARS = """
  min_by({value}, {order}) AS open, max({value}) AS high, min({value}) AS low,
  max_by({value}, {order}) AS "close", count(*) AS volume"""


def _values(rows) -> str:
    def literal(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


_MODEL_Z = """
  SELECT doc_id AS "Id",
    0.8::DOUBLE * (length(text) / 1000.0::DOUBLE) - 0.5::DOUBLE * th AS z0,
    0.6::DOUBLE * (length(split_part(text, chr(10), 1)) / 200.0::DOUBLE) AS z1,
    0.4::DOUBLE * th - 0.3::DOUBLE * (length(text) / 1000.0::DOUBLE) AS z2
  FROM (SELECT doc_id, text,
               (length(text) - length(replace(text, 'th', ''))) * 50.0::DOUBLE / greatest(length(text), 1) AS th
        FROM documents)"""

VIEWS = {
    "v_customers": """
  SELECT c_custkey AS id, c_acctbal AS income,
         round(coalesce(total, 0.0::DOUBLE) / 1000, 5) AS spend, c_mktsegment AS segment
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) t
    ON t.o_custkey = c_custkey""",
    "v_reviews": """
  SELECT d.doc_id AS "Id", (1 + 2 * quality + 2 * (1 - toxic))::INTEGER AS "Score", text AS "Text", lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "v_prices": f"""
  SELECT o_orderpriority AS series_id, o_orderdate::DATE AS dt,
  {_BARS.format(value="o_totalprice", order="o_orderkey")}
  FROM orders GROUP BY 1, 2""",
    "v_prices_all": f"""
  SELECT 'ALL' AS series_id, o_orderdate::DATE AS dt,
  {_BARS.format(value="o_totalprice", order="o_orderkey")}
  FROM orders GROUP BY 1, 2""",
    "v_hourly": """
  SELECT event_type AS series_id, ts::DATE AS dt, hour(ts)::INTEGER AS hr,
         arg_max(value, (ts, event_id)) AS "close", count(*) AS volume
  FROM events GROUP BY 1, 2, 3""",
    "v_ticks": "SELECT event_type AS series_id, ts, event_id, value FROM events",
    "v_date_text": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders",
    "v_lexicon": f"SELECT token, valence::DOUBLE AS valence FROM (VALUES {_values(LEXICON)}) AS t(token, valence)",
    "v_logits": _MODEL_Z,
    "v_model": """
  SELECT "Id", round(e0 / (e0 + e1 + e2), 6) AS neg, round(e1 / (e0 + e1 + e2), 6) AS neu,
         round(e2 / (e0 + e1 + e2), 6) AS pos
  FROM (SELECT "Id", exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
               exp(z2 - greatest(z0, z1, z2)) AS e2 FROM v_logits)""",
}


def with_views(names: list[str], body: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """A query that starts with the named views, then the extra expressions, then `body`."""
    parts = {name: VIEWS[name] for name in names} | (extra or {})
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    head = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n" if ctes else ""
    return head + body
