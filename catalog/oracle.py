"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Statements are assembled from named common table expressions; ``_sql`` adds those a final
SELECT refers to, in order of dependency.
"""

from __future__ import annotations

import re

START, END = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-01-30 23:00:00'"
NIGHT = "(22, 23, 0, 1, 2, 3, 4)"

_CTE: dict[str, str] = {}


def _sql(final: str) -> str:
    """``final`` preceded by every named expression it needs."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _CTE:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                need(_CTE[name])
                if name not in ordered:
                    ordered.append(name)

    need(final)
    if not ordered:
        return final
    # Features and fits are read more than once; computed anew each time they take minutes.
    kept = {n: " MATERIALIZED" if n == "y_features" or n.startswith(("b_", "m_")) else "" for n in ordered}
    return "WITH " + ",\n".join(f"{n} AS{kept[n]} ({_CTE[n]})" for n in ordered) + "\n" + final


def _split(ts: str, bounds: tuple[str, str, str, str]) -> str:
    """Label from the first instants of train, val, test and of the time after."""
    a, b, c, d = (f"TIMESTAMP '{x} 00:00:00'" for x in bounds)
    return (
        f"CASE WHEN {ts} >= {a} AND {ts} < {b} THEN 'train' "
        f"WHEN {ts} >= {b} AND {ts} < {c} THEN 'val' WHEN {ts} >= {c} AND {ts} < {d} THEN 'test' END"
    )


JANUARY = ("2024-01-01", "2024-01-21", "2024-01-26", "2024-01-31")
YEARS = ("1995-01-01", "1999-01-01", "2000-01-01", "2002-01-01")

# --- stand-in feeds ------------------------------------------------------------------------

_CTE["f_readings"] = """
SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts) AS ts,
  CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(18,2)) - 5 END) AS DOUBLE)
    AS generation,
  CASE WHEN user_id % 15 = 0 THEN 0.0::DOUBLE
       WHEN user_id % 15 > 1 THEN CAST(80 + 10 * (user_id % 12) AS DOUBLE) END AS capacity,
  CAST(sum(CAST(value AS DECIMAL(18,2))) + 100 AS DOUBLE) AS load
FROM events GROUP BY user_id, date_trunc('hour', ts)"""

_CTE["f_weather"] = """
SELECT CAST(user_id AS VARCHAR) AS series_id, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS ts,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 40.0::DOUBLE AS temperature,
  CAST(sum(CASE WHEN event_type IN ('view', 'click', 'purchase')
    THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) * 2.0::DOUBLE AS direct,
  CAST(sum(CASE WHEN event_type <> 'click' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE)
    AS diffuse
FROM events GROUP BY user_id, date_trunc('hour', ts + INTERVAL 30 MINUTE)"""


def _site(n: str) -> str:
    return (
        f"CAST(({n} * 37) % 121 - 60 AS DOUBLE) AS latitude_deg, "
        f"CAST(({n} * 53) % 360 - 180 AS DOUBLE) AS longitude_deg, "
        f"CAST(({n} * 7) % 91 + 0.25 AS DOUBLE) AS tilt_deg, "
        f"CAST(({n} * 11) % 360 AS DOUBLE) AS azimuth_deg"
    )


_CTE["f_sites"] = f"""
SELECT CAST(user_id AS VARCHAR) AS series_id, {_site("user_id")}
FROM (SELECT DISTINCT user_id FROM events)"""

_CTE["f_observed"] = f"""
SELECT l_orderkey, l_linenumber, l_shipdate + INTERVAL 1 HOUR * (l_orderkey % 24) AS ts,
  l_quantity * 16.0::DOUBLE AS direct, l_discount * 3000.0::DOUBLE AS diffuse,
  l_tax * 500.0::DOUBLE - 10.0::DOUBLE AS temperature, s.*
FROM lineitem JOIN (SELECT s_suppkey, {_site("s_suppkey")} FROM supplier) s
  ON l_suppkey = s_suppkey"""

_CTE["f_orders"] = """
SELECT o_orderpriority AS series_id, o_orderdate + INTERVAL 1 HOUR * (o_custkey % 24) AS ts,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS generation,
  CASE WHEN o_orderpriority <> '1-URGENT'
    THEN CAST(o_custkey % 500 + 10 * year(o_orderdate) AS DOUBLE) END AS capacity,
  o_totalprice AS load
FROM orders"""

_CTE["f_items"] = """
SELECT l_returnflag AS series_id, l_shipdate + INTERVAL 1 HOUR * (l_orderkey % 24) AS ts,
  CASE WHEN l_linestatus <> 'F' THEN l_tax * 500.0::DOUBLE - 10.0::DOUBLE END AS temperature,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity * 16.0::DOUBLE END AS direct,
  l_discount * 3000.0::DOUBLE AS diffuse
FROM lineitem"""

_CTE["d_orders"] = """
SELECT o_orderdate AS ts, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS generation
FROM orders GROUP BY o_orderdate"""

_CTE["d_items"] = """
SELECT l_shipdate AS ts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS direct,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS diffuse,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS temperature
FROM lineitem GROUP BY l_shipdate"""

_CTE["d_pairs"] = """
SELECT ts, generation, direct + diffuse AS ghi FROM d_orders JOIN d_items USING (ts)
WHERE generation IS NOT NULL AND direct IS NOT NULL AND diffuse IS NOT NULL
  AND temperature IS NOT NULL"""

_CTE["item_hours"] = """
SELECT l_returnflag AS series_id, l_shipdate + INTERVAL 1 HOUR * l_linenumber AS ts,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 1000.0::DOUBLE AS cf
FROM lineitem GROUP BY 1, 2"""

# --- cleaning, grid, gaps ------------------------------------------------------------------

_CTE["c_night"] = f"""
SELECT series_id, ts, CASE WHEN hour(ts) IN {NIGHT} AND generation > 1 THEN 0.0::DOUBLE
  ELSE generation END AS generation, capacity, load FROM f_readings"""


def _cf(source: str) -> str:
    return f"""
SELECT *, CASE WHEN capacity = 0 THEN CASE WHEN generation > 0 THEN 1.0::DOUBLE
      WHEN generation < 0 THEN 0.0::DOUBLE END
    WHEN generation / nullif(capacity, 0) < 0 THEN 0.0::DOUBLE
    WHEN generation / nullif(capacity, 0) > 1 THEN 1.0::DOUBLE
    ELSE generation / nullif(capacity, 0) END AS cf FROM {source}"""


_CTE["c_readings"] = _cf("c_night")

_CTE["c_weather"] = f"""
SELECT series_id, ts, temperature,
  CASE WHEN hour(ts) IN {NIGHT} AND direct + diffuse > 1 THEN 0.0::DOUBLE ELSE direct END AS direct,
  CASE WHEN hour(ts) IN {NIGHT} AND direct + diffuse > 1 THEN 0.0::DOUBLE ELSE diffuse END
    AS diffuse
FROM f_weather"""

_CTE["g_hours"] = f"""
SELECT ts FROM generate_series({START}, {END}, INTERVAL 1 HOUR) AS g(ts)"""

_CTE["g_grid"] = """
SELECT series_id, ts FROM (SELECT DISTINCT series_id FROM f_readings), g_hours"""

_CTE["g_aligned"] = """
SELECT series_id, ts, generation, capacity, load, cf
FROM g_grid LEFT JOIN c_readings USING (series_id, ts)"""


def _fill(c: str) -> str:
    span = f"date_diff('hour', {c}_t0, {c}_t1)"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {span} - 1 <= 3 THEN "
        f"{c}_x0 + ({c}_x1 - {c}_x0) * date_diff('hour', {c}_t0, ts) / {span} END AS {c}"
    )


def _filled(tag: str) -> None:
    """Short gaps of ``{tag}_aligned`` filled, as CTE ``{tag}_filled``."""
    neighbours = ",".join(
        f"""
  last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER before AS {c}_t0,
  last_value({c} IGNORE NULLS) OVER before AS {c}_x0,
  first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER after AS {c}_t1,
  first_value({c} IGNORE NULLS) OVER after AS {c}_x1"""
        for c in ("generation", "cf", "load")
    )
    _CTE[f"{tag}_neighbours"] = f"""
SELECT *,{neighbours}
FROM {tag}_aligned WINDOW
  before AS (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  after AS (PARTITION BY series_id ORDER BY ts
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    _CTE[f"{tag}_filled"] = f"""
SELECT series_id, ts, {_fill("generation")}, capacity, {_fill("load")}, {_fill("cf")}
FROM {tag}_neighbours"""


_filled("g")

_CTE["g_dataset"] = """
SELECT f.*, temperature, direct, diffuse, direct + diffuse AS ghi
FROM g_filled f LEFT JOIN c_weather USING (series_id, ts)
WHERE series_id IN (SELECT series_id FROM f_weather)"""

_CTE["g_lagged"] = """
SELECT *, lag(cf, 1) OVER s AS cf_lag_1h, lag(cf, 24) OVER s AS cf_lag_24h,
  lag(cf, 168) OVER s AS cf_lag_168h
FROM g_aligned WINDOW s AS (PARTITION BY series_id ORDER BY ts)"""

# Three plants over six years; their hours all lie in daytime, so nothing is clipped.
_CTE["y_readings"] = _cf("""(
SELECT translate(o_orderstatus, 'FOP', 'ANR') AS series_id,
  o_orderdate + INTERVAL 1 HOUR * (o_custkey % 6 + 8) AS ts,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000.0::DOUBLE AS generation,
  CAST(400 + 20 * (year(o_orderdate) - 1995) AS DOUBLE) AS capacity,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS load
FROM orders GROUP BY ALL)""")

_CTE["y_weather"] = """
SELECT l_returnflag AS series_id, l_shipdate + INTERVAL 1 HOUR * (l_orderkey % 6 + 8) AS ts,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 400.0::DOUBLE - 5.0::DOUBLE
    AS temperature,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) * 8.0::DOUBLE AS direct,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) * 1500.0::DOUBLE AS diffuse
FROM lineitem GROUP BY 1, 2"""

_CTE["y_aligned"] = """
SELECT series_id, ts, generation, capacity, load, cf
FROM (SELECT * FROM (SELECT DISTINCT series_id FROM y_readings), generate_series(
  TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31 23:00:00', INTERVAL 1 HOUR) AS g(ts))
LEFT JOIN y_readings USING (series_id, ts)"""

_filled("y")

_CTE["y_dataset"] = """
SELECT f.*, temperature, direct, diffuse, direct + diffuse AS ghi, 51.0::DOUBLE AS latitude_deg,
  10.5::DOUBLE AS longitude_deg, 35.0::DOUBLE AS tilt_deg, 180.0::DOUBLE AS azimuth_deg
FROM y_filled f LEFT JOIN y_weather USING (series_id, ts)"""


# --- physics -------------------------------------------------------------------------------


def _position(source: str, tag: str) -> None:
    """Sun position over ``source`` (ts, latitude, longitude) as CTE ``{tag}_sun``."""
    _CTE[f"{tag}_hour"] = f"""
SELECT *, hour(ts) + minute(ts) / 60.0::DOUBLE + second(ts) / 3600.0::DOUBLE AS utc_hour,
  radians((dayofyear(ts) - 81) * 360.0::DOUBLE / 365.0::DOUBLE) AS b FROM {source}"""
    _CTE[f"{tag}_angle"] = f"""
SELECT *, 9.87::DOUBLE * sin(2 * b) - 7.53::DOUBLE * cos(b) - 1.5::DOUBLE * sin(b) AS eot,
  23.45::DOUBLE * sin(b) AS decl,
  15.0::DOUBLE * (utc_hour + longitude_deg / 15.0::DOUBLE + (9.87::DOUBLE * sin(2 * b)
    - 7.53::DOUBLE * cos(b) - 1.5::DOUBLE * sin(b)) / 60.0::DOUBLE - 12.0::DOUBLE) AS ha
FROM {tag}_hour"""
    _CTE[f"{tag}_elev"] = f"""
SELECT *, degrees(asin(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  sin(radians(latitude_deg)) * sin(radians(decl))
  + cos(radians(latitude_deg)) * cos(radians(decl)) * cos(radians(ha)))))) AS elev
FROM {tag}_angle"""
    _CTE[f"{tag}_sun"] = f"""
SELECT *, degrees(atan2(-cos(radians(decl)) * sin(radians(ha)) / cos(radians(elev)),
  (sin(radians(decl)) - sin(radians(elev)) * sin(radians(latitude_deg)))
  / (cos(radians(elev)) * cos(radians(latitude_deg))))) AS bearing,
  CASE WHEN elev > 0 THEN 1098.0::DOUBLE * greatest(cos(radians(90.0::DOUBLE - elev)), 0.001::DOUBLE)
    * exp(-0.057::DOUBLE / greatest(cos(radians(90.0::DOUBLE - elev)), 0.001::DOUBLE))
    ELSE 0.0::DOUBLE END AS clear
FROM {tag}_elev"""


def _panel(tag: str, turn: int) -> None:
    """Panel quantities on top of ``{tag}_sun`` as CTE ``{tag}_cell``."""
    _CTE[f"{tag}_facing"] = f"""
SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  sin(radians(elev)) * cos(radians(tilt_deg)) + cos(radians(elev)) * sin(radians(tilt_deg))
  * cos(radians(bearing + {turn} - azimuth_deg)))) AS cos_aoi,
  CASE WHEN clear > 1 THEN CASE WHEN (direct + diffuse) / clear < 0 THEN 0.0::DOUBLE
      WHEN (direct + diffuse) / clear > 1.5 THEN 1.5::DOUBLE ELSE (direct + diffuse) / clear END
    ELSE 0.0::DOUBLE END AS clearness
FROM {tag}_sun"""
    _CTE[f"{tag}_sum"] = f"""
SELECT *, CASE WHEN elev > 0 THEN direct * greatest(cos_aoi, 0.0::DOUBLE)
      / sin(radians(greatest(elev, 1.0::DOUBLE))) ELSE 0.0::DOUBLE END
  + diffuse * (1 + cos(radians(tilt_deg))) / 2
  + (direct + diffuse) * 0.2::DOUBLE * (1 - cos(radians(tilt_deg))) / 2 AS total
FROM {tag}_facing"""
    _CTE[f"{tag}_poa"] = f"""
SELECT *, CASE WHEN total < 0 THEN 0.0::DOUBLE ELSE total END AS poa FROM {tag}_sum"""
    _CTE[f"{tag}_cell"] = f"""
SELECT *, temperature + 25.0::DOUBLE * poa / 800.0::DOUBLE AS cell,
  poa / 1000.0::DOUBLE * (1.0::DOUBLE - 0.004::DOUBLE
    * (temperature + 25.0::DOUBLE * poa / 800.0::DOUBLE - 25.0::DOUBLE)) AS theory
FROM {tag}_poa"""


_THEORY = "CASE WHEN theory < 0 THEN 0.0::DOUBLE WHEN theory > 1 THEN 1.0::DOUBLE ELSE theory END"

_position("f_observed", "o")
_panel("o", 0)

_CTE["w_sited"] = "SELECT * FROM f_weather JOIN f_sites USING (series_id)"
_position("w_sited", "w")
_panel("w", 180)


def _features(tag: str, dataset: str, bounds: tuple[str, str, str, str]) -> None:
    """Lags, physics, calendar and split label over ``dataset`` as CTE ``{tag}_features``."""
    _CTE[f"{tag}_lagged"] = f"""
SELECT *, lag(cf, 1) OVER s AS cf_lag_1h, lag(cf, 24) OVER s AS cf_lag_24h,
  lag(cf, 168) OVER s AS cf_lag_168h, {_split("ts", bounds)} AS split
FROM {dataset} WINDOW s AS (PARTITION BY series_id ORDER BY ts)"""
    _position(f"{tag}_lagged", tag)
    _panel(tag, 180)
    _CTE[f"{tag}_features"] = f"""
SELECT series_id, ts, cf, temperature, direct, diffuse, ghi, split, cf_lag_1h, cf_lag_24h,
  cf_lag_168h, elev AS solar_elevation_deg, 90.0::DOUBLE - elev AS solar_zenith_deg,
  clearness AS clearness_index, poa AS g_poa, cell AS t_cell_c, {_THEORY} AS cf_theory,
  sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
  sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_sin,
  cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE) AS doy_cos
FROM {tag}_cell"""


_CTE["t_dataset"] = "SELECT * FROM g_dataset JOIN f_sites USING (series_id)"
_features("t", "t_dataset", JANUARY)
_features("y", "y_dataset", YEARS)

# --- forecasters ---------------------------------------------------------------------------

_CTE["p_naive"] = f"""
SELECT *, lag(cf, 1) OVER s AS pred_1, lag(cf, 24) OVER s AS pred_24
FROM (SELECT *, {_split("ts", JANUARY)} AS split FROM g_aligned)
WINDOW s AS (PARTITION BY series_id, split ORDER BY ts)"""

_CTE["p_long"] = """
SELECT 'persistence' AS model, split, cf, pred_1 AS pred FROM p_naive
UNION ALL SELECT 'daily_seasonal_naive', split, cf, pred_24 FROM p_naive"""

_CTE["p_scores"] = """
SELECT model, split, sqrt(avg((cf - pred) * (cf - pred))) AS rmse, avg(abs(cf - pred)) AS mae,
  count(cf - pred) AS n FROM p_long GROUP BY model, split"""

# Two-feature least squares in closed form.
_CTE["m_moments"] = """
SELECT avg(cf) AS my, avg(ghi) AS mg, avg(temperature) AS mt, var_pop(ghi) AS vg,
  var_pop(temperature) AS vt, covar_pop(ghi, temperature) AS gt, covar_pop(ghi, cf) AS gy,
  covar_pop(temperature, cf) AS ty
FROM y_features
WHERE split = 'train' AND cf IS NOT NULL AND ghi IS NOT NULL AND temperature IS NOT NULL"""

_CTE["m_weather"] = """
SELECT (gy * vt - ty * gt) / (vg * vt - gt * gt) AS a,
  (ty * vg - gy * gt) / (vg * vt - gt * gt) AS b, my, mg, mt FROM m_moments"""


def _bounded(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0.0::DOUBLE WHEN {x} > 1 THEN 1.0::DOUBLE ELSE {x} END"


# Least squares on six features by orthogonalisation: each column is reduced by its
# projections on the ones before it, so the fit is a sum of one-column projections. Cell
# temperature is a combination of temperature and g_poa and adds nothing to the fit.
_BASIS = ("ghi", "temperature", "g_poa", "cf_theory", "clearness_index", "solar_elevation_deg")
_CTE["b_rows"] = f"""
SELECT series_id, ts, split, cf, {", ".join(_BASIS)},
  split = 'train' AND cf IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in _BASIS)} AS used
FROM y_features"""
_CTE["b_0"] = "SELECT series_id, ts, split, cf, used, " + ", ".join(
    f"{c} - (SELECT avg({c}) FROM b_rows WHERE used) AS {c}" for c in _BASIS
) + ", (SELECT avg(cf) FROM b_rows WHERE used) AS fit FROM b_rows"
for _i, _c in enumerate(_BASIS):
    _later = _BASIS[_i + 1 :]
    _CTE[f"b_w{_i}"] = (
        f"SELECT sum({_c} * (cf - fit)) / sum({_c} * {_c}) AS w_fit"
        + "".join(f", sum({_c} * {x}) / sum({_c} * {_c}) AS w_{x}" for x in _later)
        + f" FROM b_{_i} WHERE used"
    )
    _CTE[f"b_{_i + 1}"] = (
        f"SELECT series_id, ts, split, cf, used, fit + w_fit * {_c} AS fit"
        + "".join(f", {x} - w_{x} * {_c} AS {x}" for x in _later)
        + f" FROM b_{_i}, b_w{_i}"
    )
_CTE["m_physics"] = f"SELECT series_id, ts, split, cf, {_bounded('fit')} AS pred FROM b_{len(_BASIS)}"

_CTE["m_climate"] = """
SELECT series_id, month(ts) AS m, day(ts) AS d, hour(ts) AS h, avg(cf) AS mean
FROM y_features WHERE split = 'train' GROUP BY ALL"""

_LINEAR = _bounded("(a * (ghi - mg) + b * (temperature - mt) + my)")

_CTE["m_long"] = f"""
SELECT 'persistence' AS model, split, cf,
  CASE WHEN min(ts) OVER (PARTITION BY split) < ts THEN cf_lag_1h END AS pred FROM y_features
UNION ALL SELECT 'daily_seasonal_naive', split, cf,
  CASE WHEN min(ts) OVER (PARTITION BY split) + INTERVAL 24 HOUR <= ts THEN cf_lag_24h END
  FROM y_features
UNION ALL SELECT 'hour_of_year_climatology', split, cf, mean FROM y_features LEFT JOIN m_climate c
  ON c.series_id = y_features.series_id AND m = month(ts) AND d = day(ts) AND h = hour(ts)
UNION ALL SELECT 'linear_weather', split, cf, {_LINEAR} FROM y_features, m_weather
UNION ALL SELECT 'pure_physics', split, cf, cf_theory FROM y_features"""

_CTE["m_all"] = """
SELECT * FROM m_long UNION ALL SELECT 'linear_physics', split, cf, pred FROM m_physics"""


def _scored(source: str) -> str:
    return f"""
SELECT model, split, sqrt(avg((cf - pred) * (cf - pred))) AS rmse, avg(abs(cf - pred)) AS mae,
  count(cf - pred) AS n FROM {source} WHERE split IN ('train', 'val') GROUP BY model, split"""


_CTE["m_scores"] = _scored("m_all")

_CTE["gap_flags"] = """
SELECT series_id, ts, generation,
  count(generation) OVER (PARTITION BY series_id ORDER BY ts) AS run,
  min(ts) OVER (PARTITION BY series_id) AS first_ts, max(ts) OVER (PARTITION BY series_id) AS last_ts
FROM g_aligned"""

_CTE["gap_islands"] = """
SELECT series_id, run, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS gap_hours,
  min(first_ts) AS first_ts, max(last_ts) AS last_ts
FROM gap_flags WHERE generation IS NULL GROUP BY series_id, run"""


def _round(digits: int, *names: str) -> str:
    # Adding zero turns a rounded -0.0 into 0.0.
    return ", ".join(f"round({n}, {digits}) + 0.0::DOUBLE AS {n}" for n in names)


def _completeness(feeds: dict[str, tuple[str, tuple[str, ...]]], by: str = "") -> str:
    key, grouped = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"SELECT {key}'{label}' AS source, '{c}' AS \"column\", "
        f"round_even(100.0::DOUBLE * count({c}) / count(*), 2) AS present_pct FROM {feed}{grouped}"
        for label, (feed, columns) in feeds.items()
        for c in columns
    )


_CORR = "covar_pop(generation, ghi) / nullif(stddev_pop(generation) * stddev_pop(ghi), 0)"
_FEEDS = {
    "time_series": ("f_orders", ("generation", "capacity", "load")),
    "weather": ("f_items", ("temperature", "direct", "diffuse")),
}
_HEAT = ", ".join(
    f"round(avg(CASE WHEN month(ts) = {m} THEN CASE WHEN generation IS NULL THEN 1.0::DOUBLE "
    f"ELSE 0.0::DOUBLE END END), 6) AS m{m:02d}"
    for m in range(1, 13)
)
_COVERAGE = """
SELECT 'time_series' AS source, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows
FROM f_orders
UNION ALL SELECT 'weather', min(ts), max(ts), count(*) FROM f_items"""
_YEARLY = """
SELECT CAST(year(ts) AS INTEGER) AS year, round_even(min(capacity), 0) AS min_capacity,
  round_even(max(capacity), 0) AS max_capacity
FROM f_orders WHERE capacity IS NOT NULL GROUP BY 1"""
_YEARLY_SERIES = """
SELECT series_id, CAST(year(ts) AS INTEGER) AS year, round_even(min(capacity), 0) AS min_capacity,
  round_even(max(capacity), 0) AS max_capacity
FROM f_orders WHERE capacity IS NOT NULL GROUP BY 1, 2"""
_POSITION = """
SELECT l_orderkey, l_linenumber, round(elev, 6) AS elevation_deg,
  round(90.0::DOUBLE - elev, 6) AS zenith_deg, round(sin(radians(bearing + {turn})), 6) AS azimuth_sin,
  round(cos(radians(bearing + {turn})), 6) AS azimuth_cos FROM o_sun"""
_FILLED = f"SELECT series_id, ts, capacity, {_round(9, 'generation', 'cf', 'load')} FROM g_filled"
_ALIGNED = """
SELECT series_id, ts, generation, capacity, load FROM g_grid LEFT JOIN f_readings USING (series_id, ts)"""
_LAGGED = "SELECT * FROM g_lagged"

_STATEMENTS: dict[str, str] = {
    "coverage": _COVERAGE,
    "usable_overlap": f"""
SELECT max(start_ts) AS overlap_start, min(end_ts) AS overlap_end,
  CAST(date_sub('hour', max(start_ts), min(end_ts)) + 1 AS BIGINT) AS overlap_hours,
  (date_sub('hour', max(start_ts), min(end_ts)) + 1) / 8760.0::DOUBLE AS overlap_years
FROM ({_COVERAGE})""",
    "column_completeness": _completeness(_FEEDS),
    "column_completeness_by_series": _completeness(_FEEDS, "series_id"),
    "profile_completeness": _completeness(_FEEDS, "series_id"),
    "coverage_by_series": """
SELECT 'time_series' AS source, series_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows
FROM f_orders GROUP BY series_id
UNION ALL SELECT 'weather', series_id, min(ts), max(ts), count(*) FROM f_items GROUP BY series_id""",
    "completeness_by_series_year": """
SELECT series_id, CAST(year(ts) AS INTEGER) AS year,
  round_even(100.0::DOUBLE * count(generation) / count(*), 2) AS present_pct
FROM f_orders GROUP BY 1, 2""",
    "missing_heatmap_by_series": f"SELECT series_id, CAST(year(ts) AS INTEGER) AS year, {_HEAT} FROM f_orders GROUP BY 1, 2",
    "anomaly_counts_by_series": f"""
SELECT * FROM (SELECT series_id, count(*) FILTER (generation < 0) AS negative_generation,
  round(100.0::DOUBLE * count(*) FILTER (generation < 0) / count(*), 6) AS negative_generation_pct,
  count(*) FILTER (hour(ts) IN {NIGHT} AND generation > 1) AS night_generation FROM f_readings GROUP BY 1)
FULL JOIN (SELECT series_id, count(*) FILTER (temperature < -30 OR temperature > 45) AS temperature_out_of_range,
  count(*) FILTER (hour(ts) IN (22, 23, 0, 1, 2, 3) AND coalesce(direct, 0) + coalesce(diffuse, 0) > 1)
    AS night_irradiance FROM f_weather GROUP BY 1) USING (series_id)""",
    "completeness_by_year": """
SELECT CAST(year(ts) AS INTEGER) AS year,
  round_even(100.0::DOUBLE * count(generation) / count(*), 2) AS present_pct
FROM f_orders GROUP BY 1""",
    "missing_heatmap": f"SELECT CAST(year(ts) AS INTEGER) AS year, {_HEAT} FROM f_orders GROUP BY 1",
    "anomaly_counts": f"""
SELECT * FROM (SELECT count(*) FILTER (generation < 0) AS negative_generation,
  round(100.0::DOUBLE * count(*) FILTER (generation < 0) / count(*), 6) AS negative_generation_pct,
  count(*) FILTER (hour(ts) IN {NIGHT} AND generation > 1) AS night_generation FROM f_readings),
 (SELECT count(*) FILTER (temperature < -30 OR temperature > 45) AS temperature_out_of_range,
  count(*) FILTER (hour(ts) IN (22, 23, 0, 1, 2, 3) AND coalesce(direct, 0) + coalesce(diffuse, 0) > 1)
    AS night_irradiance FROM f_weather)""",
    "corr_overall": f"SELECT round({_CORR}, 6) AS corr, count(*) AS n FROM d_pairs",
    "corr_by_month": f"""
SELECT CAST(month(ts) AS INTEGER) AS month, round_even({_CORR}, 3) AS corr
FROM d_pairs GROUP BY 1""",
    "capacity_by_year": _YEARLY,
    "capacity_growth": f"""
SELECT count(*) AS n_years, round(CASE WHEN count(*) > 1 THEN
  (arg_max(max_capacity, year) / arg_min(min_capacity, year) - 1) * 100 ELSE 0.0::DOUBLE END, 6)
  AS growth_pct FROM ({_YEARLY})""",
    "capacity_by_series_year": _YEARLY_SERIES,
    "capacity_growth_by_series": f"""
SELECT series_id, count(*) AS n_years, round(CASE WHEN count(*) > 1 THEN
  (arg_max(max_capacity, year) / arg_min(min_capacity, year) - 1) * 100 ELSE 0.0::DOUBLE END, 6)
  AS growth_pct FROM ({_YEARLY_SERIES}) GROUP BY 1""",
    "capacity_timeline": """
SELECT series_id, ts, capacity / 1000.0::DOUBLE AS capacity_thousands
FROM f_orders WHERE capacity IS NOT NULL""",
    "one_year": """
SELECT ts, generation, ghi FROM (SELECT * FROM d_orders WHERE year(ts) = 1998)
FULL JOIN (SELECT ts, direct + diffuse AS ghi FROM d_items WHERE year(ts) = 1998) USING (ts)""",
    "target_completeness": """
SELECT count(*) AS n_rows, round(100.0::DOUBLE * count(cf) / count(*), 6) AS present_pct
FROM g_dataset""",
    "night_clip_generation": "SELECT * FROM c_night",
    "night_clip_irradiance": "SELECT * FROM c_weather",
    "capacity_factor": _cf("f_readings"),
    "ghi": "SELECT *, direct + diffuse AS ghi FROM f_weather",
    "cleaning_audit": f"""
SELECT 'night_clips' AS rule, count(*) FILTER (hour(ts) IN {NIGHT} AND generation > 1) AS rows_changed
FROM f_readings
UNION ALL SELECT 'over_capacity', count(*) FILTER (generation > capacity) FROM f_readings
UNION ALL SELECT 'irradiance_clips', count(*) FILTER (hour(ts) IN {NIGHT} AND direct + diffuse > 1)
FROM f_weather""",
    "hourly_grid": "SELECT series_id, ts FROM f_sites, g_hours",
    "hourly_align": _ALIGNED,
    "hourly_align_join": _ALIGNED,
    "duplicate_hours": """
SELECT series_id, ts, count(*) AS n FROM f_orders GROUP BY series_id, ts HAVING count(*) > 1""",
    "align_mean": """
SELECT series_id, ts, avg(capacity) AS capacity FROM
  (SELECT * FROM (SELECT DISTINCT series_id FROM f_orders), generate_series(
    TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-31 23:00:00', INTERVAL 1 HOUR) AS g(ts))
LEFT JOIN f_orders USING (series_id, ts) GROUP BY series_id, ts""",
    "feed_join": """
SELECT series_id, ts, generation, capacity, load, temperature, direct, diffuse
FROM g_grid LEFT JOIN f_readings USING (series_id, ts) LEFT JOIN f_weather USING (series_id, ts)
WHERE series_id IN (SELECT series_id FROM f_weather)""",
    "gap_fill": _FILLED,
    "gap_fill_halo": _FILLED,
    "gap_runs": """
SELECT series_id, gap_start, gap_end, gap_hours,
  gap_hours <= 3 AND gap_start > first_ts AND gap_end < last_ts AS filled FROM gap_islands""",
    "fill_audit": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM g_filled) "
        f"- (SELECT count({c}) FROM g_aligned) AS filled_hours"
        for c in ("generation", "cf", "load")
    ),
    "dataset_build": f"""
SELECT series_id, ts, {_round(9, "generation", "cf", "load")}, capacity, temperature, direct,
  diffuse, ghi FROM g_dataset""",
    "lag_window": _LAGGED,
    "lag_join": _LAGGED,
    "calendar_features": """
SELECT l_orderkey, l_linenumber, ts, round(sin(2 * pi() * hour(ts) / 24), 9) AS hour_sin,
  round(cos(2 * pi() * hour(ts) / 24), 9) + 0.0::DOUBLE AS hour_cos,
  round(sin(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 9) AS doy_sin,
  round(cos(2 * pi() * dayofyear(ts) / 365.25::DOUBLE), 9) AS doy_cos,
  CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM f_observed""",
    "sun_angles": """
SELECT l_orderkey, l_linenumber, round(utc_hour, 6) AS utc_hour,
  CAST(dayofyear(ts) AS INTEGER) AS day_of_year, round(eot, 6) AS equation_of_time,
  round(decl, 6) AS declination_deg, round(ha, 6) AS hour_angle_deg FROM o_angle""",
    "solar_position_as_coded": _POSITION.format(turn=180),
    "solar_position_documented": _POSITION.format(turn=0),
    "clear_sky": "SELECT l_orderkey, l_linenumber, round(clear, 6) AS clear_sky_ghi FROM o_sun",
    "clearness": """
SELECT l_orderkey, l_linenumber, round(clearness, 6) AS clearness_index FROM o_facing""",
    "aoi_poa": """
SELECT l_orderkey, l_linenumber, round(degrees(acos(cos_aoi)), 4) AS aoi_deg,
  round(poa, 6) AS g_poa FROM o_poa""",
    "cell_temp_cf": f"""
SELECT l_orderkey, l_linenumber, round(cell, 6) AS t_cell_c, round({_THEORY}, 6) AS cf_theory
FROM o_cell""",
    "physics_features": f"""
SELECT series_id, ts, round(elev, 6) AS solar_elevation_deg,
  round(90.0::DOUBLE - elev, 6) AS solar_zenith_deg, round(clearness, 6) AS clearness_index,
  round(poa, 6) AS g_poa, round(cell, 6) AS t_cell_c, round({_THEORY}, 6) AS cf_theory
FROM w_cell""",
    "feature_table": f"""
SELECT series_id, ts, temperature, direct, diffuse, ghi, split,
  {_round(9, "cf", "cf_lag_1h", "cf_lag_24h", "cf_lag_168h")},
  {_round(6, "solar_elevation_deg", "solar_zenith_deg", "clearness_index", "g_poa", "t_cell_c",
          "cf_theory", "hour_sin", "hour_cos", "doy_sin", "doy_cos")} FROM t_features""",
    "split_label": f"""
SELECT o_orderkey, o_orderdate AS ts, {_split("o_orderdate", YEARS)} AS split FROM orders""",
    "split_counts": f"""
SELECT series_id, {_split("ts", YEARS)} AS split, count(*) AS n FROM f_orders
WHERE {_split("ts", YEARS)} IS NOT NULL GROUP BY 1, 2""",
    "holdout_tail": """
SELECT series_id, ts, generation, ts >= cut AS holdout FROM f_readings,
  (SELECT min(ts) AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts DESC) AS k, count(*) OVER () AS n
   FROM f_readings WHERE generation IS NOT NULL) WHERE k <= greatest(1, floor(n * 0.1::DOUBLE)))
WHERE generation IS NOT NULL""",
    "holdout_tail_by_series": """
SELECT series_id, ts, generation, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC)
  <= greatest(1, floor(count(*) OVER (PARTITION BY series_id) * 0.1::DOUBLE)) AS holdout
FROM f_readings WHERE generation IS NOT NULL""",
    "persistence": "SELECT series_id, ts, split, cf, pred_1 AS pred FROM p_naive",
    "seasonal_naive": "SELECT series_id, ts, split, cf, pred_24 AS pred FROM p_naive",
    "climatology": f"""
SELECT i.series_id, i.ts, round(i.cf, 9) AS cf, {_split("i.ts", YEARS)} AS split,
  round(mean, 9) AS pred
FROM item_hours i LEFT JOIN (SELECT series_id, month(ts) AS m, day(ts) AS d, hour(ts) AS h,
  avg(cf) AS mean FROM item_hours WHERE {_split("ts", YEARS)} = 'train' GROUP BY ALL) c
ON c.series_id = i.series_id AND m = month(i.ts) AND d = day(i.ts) AND h = hour(i.ts)""",
    "linear_weather": f"""
SELECT series_id, ts, split, round({_LINEAR}, 6) AS pred FROM y_features, m_weather""",
    "linear_physics": "SELECT series_id, ts, split, round(pred, 6) AS pred FROM m_physics",
    "pure_physics": "SELECT series_id, ts, split, round(cf_theory, 6) AS pred FROM y_features",
    "forecast_metrics": f"SELECT model, split, {_round(6, 'rmse', 'mae')}, n FROM p_scores",
    "skill_scores": """
SELECT s.model, split, round(s.rmse, 6) AS rmse, round(s.mae, 6) AS mae, s.n,
  round(1 - s.rmse / nullif(b.rmse, 0), 6) AS skill
FROM p_scores s JOIN (SELECT * FROM p_scores WHERE model = 'persistence') b USING (split)""",
    "aligned_predictions": """
SELECT series_id, ts, cf AS y_true, pred_1 AS pred FROM p_naive
WHERE cf IS NOT NULL AND pred_1 IS NOT NULL""",
    "model_comparison": """
SELECT s.model, split, round(s.rmse, 6) AS rmse, round(s.mae, 6) AS mae, s.n,
  round(1 - s.rmse / nullif(b.rmse, 0), 6) AS skill
FROM m_scores s JOIN (SELECT * FROM m_scores WHERE model = 'persistence') b USING (split)""",
    "run_results": """
SELECT s.model, round(s.rmse, 6) AS val_rmse, round(s.mae, 6) AS val_mae,
  round(1 - s.rmse / nullif(b.rmse, 0), 6) AS skill, s.n
FROM m_scores s JOIN (SELECT * FROM m_scores WHERE model = 'persistence') b USING (split)
WHERE split = 'val'""",
    # What a check of the given table files has to find.
    "file_integrity": """
SELECT file || '.parquet' AS file, algo, status FROM (VALUES
  ('orders', 'md5', 'verified'), ('lineitem', 'sha1', 'verified'), ('supplier', 'md5', 'mismatch'),
  ('nation', NULL, 'skipped'), ('events', 'sha256', 'verified'), ('region', 'sha256', 'verified'),
  ('customer', 'sha256', 'verified'), ('part', 'sha256', 'verified'), ('documents', 'sha256', 'verified'),
  ('embeddings', 'sha256', 'verified'), ('pages', 'sha256', 'verified'), ('benchmark', 'sha256', 'verified'),
  ('labels', 'sha256', 'verified'), ('conversations', 'sha256', 'verified')) v(file, algo, status)""",
}

SQL: dict[str, str] = {name: _sql(text) for name, text in _STATEMENTS.items()}
