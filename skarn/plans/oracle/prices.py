"""SQL for the price-series queries."""

from __future__ import annotations

from skarn.plans.oracle.views import with_views
from skarn.plans.prices import FIRST, FIXED_COEFS, FIXED_INTERCEPT, LAST, MEMORY, SCALE, WEIGHT

_BY_DT = "OVER (PARTITION BY series_id ORDER BY dt)"
_BY_HOUR = "OVER (PARTITION BY series_id ORDER BY dt, hr)"
_BY_TICK = "OVER (PARTITION BY series_id ORDER BY ts, event_id)"


def _lag_view(n: int, view: str = "v_prices") -> str:
    lags = ", ".join(f'lag("close", {k}) {_BY_DT} AS lag_{k}' for k in range(n, 0, -1))
    return f"""
    SELECT series_id, dt, {', '.join(f'lag_{k}' for k in range(n, 0, -1))}, target, gap_days FROM (
      SELECT series_id, dt, {lags}, "close" AS target, date_diff('day', lag(dt) {_BY_DT}, dt)::INTEGER AS gap_days,
             row_number() {_BY_DT} AS rn FROM {view}) WHERE rn > {n}"""


def _split(table: str) -> str:
    return f"""
    SELECT *, CASE WHEN row_idx < floor(n * 0.8::DOUBLE) THEN 'train' WHEN row_idx < floor(n * 0.9::DOUBLE) THEN 'val'
              ELSE 'test' END AS split
    FROM (SELECT *, row_number() {_BY_DT} - 1 AS row_idx, count(*) OVER (PARTITION BY series_id) AS n FROM {table})"""


_L1 = {"t": _lag_view(1), "s": _split("t")}
_L3 = {"t": _lag_view(3), "s": _split("t")}

_AR1 = _L1 | {
    "m": """SELECT series_id, regr_slope(target, lag_1) AS b, regr_intercept(target, lag_1) AS a
            FROM s WHERE split = 'train' GROUP BY 1""",
    "p": "SELECT s.*, a + b * lag_1 AS prediction FROM s JOIN m USING (series_id)",
}

# Three normal equations solved by determinants.
_AR3 = _L3 | {
    "c": """SELECT series_id, avg(target) AS my, avg(lag_3) AS m1, avg(lag_2) AS m2, avg(lag_1) AS m3,
      covar_pop(lag_3, lag_3) AS g11, covar_pop(lag_3, lag_2) AS g12, covar_pop(lag_3, lag_1) AS g13,
      covar_pop(lag_2, lag_2) AS g22, covar_pop(lag_2, lag_1) AS g23, covar_pop(lag_1, lag_1) AS g33,
      covar_pop(lag_3, target) AS h1, covar_pop(lag_2, target) AS h2, covar_pop(lag_1, target) AS h3
      FROM s WHERE split = 'train' GROUP BY 1""",
    "d": """SELECT *, g11*(g22*g33-g23*g23) - g12*(g12*g33-g23*g13) + g13*(g12*g23-g22*g13) AS det,
      h1*(g22*g33-g23*g23) - g12*(h2*g33-g23*h3) + g13*(h2*g23-g22*h3) AS d1,
      g11*(h2*g33-g23*h3) - h1*(g12*g33-g23*g13) + g13*(g12*h3-h2*g13) AS d2,
      g11*(g22*h3-h2*g23) - g12*(g12*h3-h2*g13) + h1*(g12*g23-g22*g13) AS d3 FROM c""",
    "p": """SELECT s.*, my + d1/det*(lag_3-m1) + d2/det*(lag_2-m2) + d3/det*(lag_1-m3) AS prediction
      FROM s JOIN d USING (series_id)""",
}

_INDEXED = f"""SELECT series_id, dt, "close", row_number() {_BY_DT} - 1 AS row_idx,
    count(*) OVER (PARTITION BY series_id) AS n FROM v_prices"""


# The fitted lag model fed with its own values, from the last training rows of the lag table on.
_ROLLED = _AR3 | {
    "w": """SELECT series_id, cut, n, max(CASE WHEN row_idx = cut - 3 THEN target END) AS w1,
      max(CASE WHEN row_idx = cut - 2 THEN target END) AS w2, max(CASE WHEN row_idx = cut - 1 THEN target END) AS w3
      FROM (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS cut FROM s) GROUP BY 1, 2, 3""",
    "f": "SELECT *, my + d1/det*(w1-m1) + d2/det*(w2-m2) + d3/det*(w3-m3) AS v FROM w JOIN d USING (series_id) WHERE cut < n",
    "r": """SELECT series_id, cut AS k, w2 AS w1, w3 AS w2, v AS w3, v FROM f
      UNION ALL SELECT series_id, k + 1, w2, w3, v, v FROM (
        SELECT r.series_id, k, n, r.w2, r.w3, my + d1/det*(r.w1-m1) + d2/det*(r.w2-m2) + d3/det*(r.w3-m3) AS v
        FROM r JOIN f USING (series_id)) WHERE k + 1 < n""",
}

_SIDE = "CASE WHEN {x} >= level THEN ha + hb * {x} ELSE la + lb * {x} END"
_THRESHOLD = _L3 | {
    "l": """SELECT series_id, level, coalesce(ha, la) AS ha, coalesce(hb, lb) AS hb, coalesce(la, ha) AS la, coalesce(lb, hb) AS lb FROM (
      SELECT series_id, level, regr_intercept(target, lag_1) FILTER (lag_1 >= level) AS ha, regr_slope(target, lag_1) FILTER (lag_1 >= level) AS hb,
        regr_intercept(target, lag_1) FILTER (lag_1 < level) AS la, regr_slope(target, lag_1) FILTER (lag_1 < level) AS lb
      FROM (SELECT *, avg(lag_1) OVER (PARTITION BY series_id) AS level FROM s WHERE split = 'train') GROUP BY 1, 2)""",
    "w": _ROLLED["w"],
    "f": f"SELECT *, {_SIDE.format(x='w3')} AS v FROM w JOIN l USING (series_id) WHERE cut < n",
    "r": f"""SELECT series_id, cut AS k, v FROM f
      UNION ALL SELECT series_id, k + 1, v FROM (
        SELECT r.series_id, k, n, {_SIDE.format(x='r.v')} AS v FROM r JOIN f USING (series_id)) WHERE k + 1 < n""",
}

# One model over all series, on values of single precision.
_F = {c: f"{c}::FLOAT::DOUBLE" for c in ("lag_3", "lag_2", "lag_1", "target")}
_POOLED = _L3 | {
    "x": f"SELECT series_id, dt, split, {', '.join(f'{v} AS {c}' for c, v in _F.items())} FROM s",
    "c": _AR3["c"].replace("SELECT series_id, avg", "SELECT avg").replace("FROM s", "FROM x").replace(" GROUP BY 1", ""),
    "d": _AR3["d"],
}


def _window_at(offset: int) -> str:
    """w1 (oldest) .. w3 of each series, the newest `offset` rows before the cut."""
    return f"""SELECT series_id, cut, n,
      max(CASE WHEN row_idx = cut - {2 + offset} - 1 THEN "close" END) AS w1,
      max(CASE WHEN row_idx = cut - {1 + offset} - 1 THEN "close" END) AS w2,
      max(CASE WHEN row_idx = cut - {offset} - 1 THEN "close" END) AS w3
      FROM (SELECT *, floor(n * 0.8::DOUBLE)::BIGINT AS cut FROM i) GROUP BY 1, 2, 3"""


_STATE = "0.0"
for _lag in ("lag_3", "lag_2", "lag_1"):
    _STATE = f"tanh({WEIGHT} * {_lag} / {SCALE} + {MEMORY} * {_STATE})"

_NEXT = " + ".join([f"{FIXED_INTERCEPT}::DOUBLE", *[f"{c}::DOUBLE * w{k}" for k, c in enumerate(FIXED_COEFS, 1)]])

SQL = {
    "row_index": with_views(
        ["v_prices"],
        f"""SELECT series_id, dt, "close", row_number() {_BY_DT} - 1 AS row_idx,
        count(*) OVER (PARTITION BY series_id) AS n_rows FROM v_prices""",
    ),
    "row_index_ticks": with_views(
        ["v_ticks"],
        f"""SELECT series_id, event_id, row_number() {_BY_TICK} - 1 AS row_idx,
        count(*) OVER (PARTITION BY series_id) AS n_rows FROM v_ticks""",
    ),
    "lag_features": with_views(
        ["v_prices"], f"SELECT * FROM t WHERE dt BETWEEN DATE '{FIRST}' AND DATE '{LAST}'", extra={"t": _lag_view(3)}
    ),
    "lag_features_capped_gap": with_views(
        ["v_prices_all"],
        """SELECT * FROM t WHERE dt < coalesce(
          (SELECT min(dt) FROM t WHERE gap_days > 3 AND dt > (SELECT min(dt) FROM t)), DATE '9999-01-01')""",
        extra={"t": _lag_view(3, "v_prices_all")},
    ),
    "lag_features_ticks": with_views(
        ["v_ticks"],
        f"""SELECT * FROM (SELECT series_id, event_id, lag(value, 3) {_BY_TICK} AS lag_3, lag(value, 2) {_BY_TICK} AS lag_2,
        lag(value, 1) {_BY_TICK} AS lag_1, value FROM v_ticks) WHERE lag_3 IS NOT NULL""",
    ),
    "lag_to_arrays": with_views(
        ["v_prices"],
        f"""SELECT series_id, dt, pos::INTEGER AS pos, round(x::FLOAT::DOUBLE, 1) AS x, round(target::FLOAT::DOUBLE, 1) AS y FROM (
          SELECT series_id, dt, target, 0 AS pos, lag_3 AS x FROM t UNION ALL
          SELECT series_id, dt, target, 1, lag_2 FROM t UNION ALL
          SELECT series_id, dt, target, 2, lag_1 FROM t)
        WHERE dt BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
        extra={"t": _lag_view(3)},
    ),
    "history_windows": with_views(
        ["v_hourly"],
        """SELECT a.series_id, a.i AS row_idx, (b.i - (a.i - 60))::INTEGER AS pos, b."close" AS value
        FROM x a JOIN x b ON b.series_id = a.series_id AND b.i BETWEEN a.i - 60 AND a.i - 1 WHERE a.i >= 60""",
        extra={"x": f'SELECT series_id, "close", row_number() {_BY_HOUR} - 1 AS i FROM v_hourly'},
    ),
    "history_windows_ticks": with_views(
        ["v_ticks"],
        f"""SELECT series_id, event_id, oldest, newest, round(mean, 5) AS mean FROM (
          SELECT series_id, event_id, lag(value, 60) {_BY_TICK} AS oldest, lag(value, 1) {_BY_TICK} AS newest,
                 avg(value) OVER (PARTITION BY series_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS mean
          FROM v_ticks) WHERE oldest IS NOT NULL""",
    ),
    "next_observation": with_views(
        ["v_prices_all"],
        f"""SELECT series_id, dt, lead(dt) {_BY_DT} AS next_dt, date_diff('day', dt, lead(dt) {_BY_DT})::INTEGER AS gap_days,
        coalesce(lead(dt) {_BY_DT} <= dt + INTERVAL 7 DAY, false) AS within FROM v_prices_all""",
    ),
    "split_chrono": with_views(["v_prices"], "SELECT series_id, dt, row_idx, split FROM s", extra=_L3),
    "split_holdout": with_views(
        ["v_hourly"],
        f"""SELECT series_id, dt, hr, row_idx, CASE WHEN row_idx < ceil(n * 0.95::DOUBLE) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, row_number() {_BY_HOUR} - 1 AS row_idx, count(*) OVER (PARTITION BY series_id) AS n FROM v_hourly)""",
    ),
    "last_k_per_series": with_views(
        ["v_prices"],
        """SELECT series_id, dt, "close", rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY dt DESC) AS rank FROM v_prices) WHERE rank <= 4""",
    ),
    "last_k_ticks": with_views(
        ["v_ticks"],
        """SELECT series_id, event_id, value, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, event_id DESC) AS rank FROM v_ticks)
        WHERE rank <= 4""",
    ),
    "asof_price": with_views(
        ["v_prices"],
        """SELECT p.series_id, p.dt, f.dt AS fact_dt, f."close" FROM p
        ASOF LEFT JOIN v_prices f ON f.series_id = p.series_id AND f.dt <= p.dt""",
        extra={
            "mo": "SELECT DISTINCT series_id, date_trunc('month', dt)::DATE AS m FROM v_prices",
            "p": """SELECT series_id, (m + INTERVAL 14 DAY)::DATE AS dt FROM mo
                    UNION ALL SELECT series_id, (last_day(m) - INTERVAL 1 DAY)::DATE FROM mo""",
        },
    ),
    "asof_ticks": with_views(
        ["v_ticks"],
        """SELECT p.series_id, p.event_id AS probe_id, f.event_id, f.value
        FROM (SELECT s AS series_id, ts, event_id FROM v_ticks, (VALUES ('click'), ('purchase'), ('signup'), ('view')) AS w(s)
              WHERE series_id = 'error') p
        ASOF LEFT JOIN v_ticks f ON f.series_id = p.series_id AND f.ts <= p.ts""",
    ),
    "zscore_series": with_views(
        ["v_prices"],
        """SELECT series_id, dt, split, round(("close" - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z
        FROM s JOIN (SELECT series_id, avg("close") AS m, stddev_pop("close") AS sd FROM s WHERE split = 'train' GROUP BY 1)
        USING (series_id)""",
        extra={"s": _split("v_prices")},
    ),
    "zscore_roundtrip": with_views(
        ["v_prices"],
        """SELECT series_id, dt, round(("close" - m) / sd, 6) AS z, round("close", 4) AS "close" FROM v_prices
        JOIN (SELECT series_id, avg("close") AS m, stddev_pop("close") AS sd FROM v_prices GROUP BY 1) USING (series_id)""",
    ),
    "zscore_ticks": with_views(
        ["v_ticks"],
        """SELECT series_id, event_id, round((value - avg(value) OVER (PARTITION BY series_id)) /
        stddev_pop(value) OVER (PARTITION BY series_id), 6) AS z FROM v_ticks""",
    ),
    "minmax_series": with_views(
        ["v_prices"],
        """SELECT series_id, dt, round(("close" - min("close") OVER w) / (max("close") OVER w - min("close") OVER w), 6) AS scaled
        FROM v_prices WINDOW w AS (PARTITION BY series_id)""",
    ),
    "persistence_forecast": with_views(
        ["v_prices"], "SELECT series_id, dt, split, target, lag_1 AS prediction FROM s", extra=_L1
    ),
    "ar1_forecast": with_views(
        ["v_prices"], "SELECT series_id, dt, split, target, round(prediction, 3) AS prediction FROM p", extra=_AR1
    ),
    "ar3_forecast": with_views(
        ["v_prices"], "SELECT series_id, dt, split, target, round(prediction, 3) AS prediction FROM p", extra=_AR3
    ),
    "forecast_metrics": with_views(
        ["v_prices"],
        """SELECT series_id, split, count(*) AS n, round(avg(pow(target - prediction, 2)), 0) AS mse,
        round(avg(abs(target - prediction)), 3) AS mae, round(sqrt(avg(pow(target - prediction, 2))), 3) AS rmse
        FROM p GROUP BY 1, 2""",
        extra=_AR1,
    ),
    "forecast_vs_actual": with_views(
        ["v_prices"],
        "SELECT series_id, row_idx, dt, target, round(prediction, 3) AS prediction FROM p WHERE split = 'test'",
        extra=_AR3,
    ),
    "forecast_horizon": with_views(
        ["v_prices"], "SELECT series_id, dt, split FROM s WHERE split IN ('val', 'test')", extra=_L3
    ),
    "recursive_forecast": with_views(
        ["v_prices"],
        """SELECT r.series_id, r.k AS row_idx, i.dt, round(r.v, 4) AS prediction
        FROM r JOIN i ON i.series_id = r.series_id AND i.row_idx = r.k""",
        recursive=True,
        extra={
            "i": _INDEXED,
            "w": _window_at(0),
            "r": f"""SELECT series_id, cut AS k, n, w2 AS w1, w3 AS w2, {_NEXT} AS w3, {_NEXT} AS v FROM w
              UNION ALL SELECT series_id, k + 1, n, w2, w3, {_NEXT}, {_NEXT} FROM r WHERE k + 1 < n""",
        },
    ),
    "recursive_forecast_ar3": with_views(
        ["v_prices"],
        """SELECT r.series_id, k AS row_idx, dt, round(v, 3) AS prediction FROM r JOIN s ON s.series_id = r.series_id AND row_idx = k""",
        recursive=True,
        extra=_ROLLED,
    ),
    "forecast_overlay": with_views(
        ["v_prices"],
        """SELECT series_id, dt, split, 'observed' AS kind, target AS value FROM p UNION ALL
        SELECT series_id, dt, split, 'predicted', round(prediction, 3) FROM p UNION ALL
        SELECT series_id, dt, split, 'baseline', lag_1 FROM p UNION ALL
        SELECT r.series_id, dt, split, 'recursive', round(v, 3) FROM r JOIN s ON s.series_id = r.series_id AND row_idx = k""",
        recursive=True,
        extra=_ROLLED,
    ),
    "threshold_forecast": with_views(
        ["v_prices"],
        f"""SELECT s.series_id, dt, split, round({_SIDE.format(x='lag_1')}, 3) AS prediction, round(v, 3) AS recursive
        FROM s JOIN l USING (series_id) LEFT JOIN r ON r.series_id = s.series_id AND row_idx = k""",
        recursive=True,
        extra=_THRESHOLD,
    ),
    "sequence_forecast": with_views(
        ["v_prices"],
        f"""SELECT series_id, dt, round({SCALE} * {_STATE}, 3) AS prediction FROM t""",
        extra={"t": _lag_view(3)},
    ),
    "forecast_by_split": with_views(
        ["v_prices"],
        """SELECT series_id, dt, split, target::FLOAT AS y,
        round(my + d1/det*(lag_3-m1) + d2/det*(lag_2-m2) + d3/det*(lag_1-m3), 2) AS prediction FROM x, d""",
        extra=_POOLED,
    ),
    "frozen_forecast": with_views(
        ["v_prices"],
        f"""SELECT i.series_id, i.row_idx, i.dt, round({_NEXT}, 4) AS prediction
        FROM i JOIN w USING (series_id) WHERE i.row_idx >= w.cut""",
        extra={"i": _INDEXED, "w": _window_at(1)},
    ),
    "forecast_long": with_views(
        ["v_prices"],
        """SELECT series_id, dt, split, 'observed' AS kind, target AS value FROM p UNION ALL
        SELECT series_id, dt, split, 'predicted', round(prediction, 3) FROM p UNION ALL
        SELECT series_id, dt, split, 'baseline', lag_1 FROM p""",
        extra=_AR1,
    ),
    "volume_outliers": with_views(
        ["v_prices"],
        """SELECT series_id, dt, volume, round(q1, 4) AS q1, round(q3, 4) AS q3,
          volume < q1 - 1.5 * (q3 - q1) OR volume > q3 + 1.5 * (q3 - q1) AS is_outlier
        FROM v_prices JOIN (SELECT series_id, quantile_cont(volume::DOUBLE, 0.25) AS q1, quantile_cont(volume::DOUBLE, 0.75) AS q3
                            FROM v_prices GROUP BY 1) USING (series_id)""",
    ),
    "value_outliers_ticks": with_views(
        ["v_ticks"],
        """SELECT series_id, event_id, value, round(q1, 5) AS q1, round(q3, 5) AS q3
        FROM v_ticks JOIN (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
                           FROM v_ticks GROUP BY 1) USING (series_id)
        WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    ),
    "price_downsample": with_views(
        ["v_prices"],
        """SELECT series_id, date_trunc('month', dt)::DATE AS bucket, min_by(open, dt) AS open, max(high) AS high,
        min(low) AS low, max_by("close", dt) AS "close", round(avg("close"), 6) AS avg_close,
        sum(volume)::BIGINT AS volume, count(*) AS n_bars FROM v_prices GROUP BY 1, 2""",
    ),
}
