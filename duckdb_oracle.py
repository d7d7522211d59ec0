"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code: the quantile is taken by
``row_number`` over the sorted group (not a value histogram), the element
combination uses distinct keys + three LEFT JOINs (not a pivot), and
previous-row logic uses self-joins rather than ``lag``.  Only the fixture
rules in ``stationclim/sources/testviews.py`` are shared.
"""

from __future__ import annotations

import re

# --------------------------------------------------------------------------- fixture views

T_OBS = """
t_obs AS (
  SELECT
    (['CHM000','JA0000','KSM000','FRE000','GMM000','UKE000','IDM000','MXM000','JAW000','USW000'])[s_nationkey % 10 + 1]
      || lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS ID,
    CASE l_returnflag WHEN 'A' THEN 'TMIN' WHEN 'N' THEN 'TMAX' WHEN 'R' THEN 'PRCP' END AS ELEMENT,
    CAST(CAST(l_shipdate AS DATE) - INTERVAL 28 YEAR AS DATE) AS DATE,
    CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS BIGINT) * 7 - 100 END AS DATA_VALUE
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""

T_OBS_AND_SEASONAL = T_OBS.replace("t_obs AS (", "all_year AS (") + """,
seasonal AS (
  SELECT 'CHM000' || CAST(70000 + o_custkey % 11 AS VARCHAR) AS ID, o_custkey % 11 AS k, o_orderkey % 300 AS v,
    CAST(CAST(o_orderdate AS DATE) - INTERVAL 28 YEAR AS DATE) AS DATE
  FROM orders
),
t_obs AS (
  SELECT * FROM all_year
  UNION ALL SELECT ID, 'TMIN', DATE, v FROM seasonal WHERE (month(DATE) * (k + 2)) % 5 < 2
  UNION ALL SELECT ID, 'TMAX', DATE, v + 10 FROM seasonal WHERE (month(DATE) * (k + 2)) % 5 < 2
  UNION ALL SELECT ID, 'PRCP', DATE, v + 20 FROM seasonal WHERE (month(DATE) * (k + 2)) % 5 < 2
)"""

# Per (ID, ELEMENT, YEAR, MONTH, DAY): nearest-rank P10/P90 by row_number.
def year_day(name: str = "yd", where: str = "WHERE DATE >= DATE '1970-01-01'") -> str:
    return f"""
{name}_obs AS (
  SELECT ID, ELEMENT, DATA_VALUE,
         CAST(year(DATE) AS INTEGER) AS YEAR, CAST(month(DATE) AS INTEGER) AS MONTH,
         CAST(day(DATE) AS INTEGER) AS DAY_OF_MONTH
  FROM t_obs {where}
),
{name}_rank AS (
  SELECT *,
    row_number() OVER (PARTITION BY ID, ELEMENT, YEAR, MONTH, DAY_OF_MONTH ORDER BY DATA_VALUE NULLS LAST) - 1 AS rn0,
    count(DATA_VALUE) OVER (PARTITION BY ID, ELEMENT, YEAR, MONTH, DAY_OF_MONTH) AS n
  FROM {name}_obs
),
{name} AS (
  SELECT ID, ELEMENT, YEAR, MONTH, DAY_OF_MONTH,
    max(CASE WHEN DATA_VALUE IS NOT NULL AND rn0 = round((n - 1) * 0.1::DOUBLE) THEN DATA_VALUE END) AS P10,
    max(CASE WHEN DATA_VALUE IS NOT NULL AND rn0 = round((n - 1) * 0.9::DOUBLE) THEN DATA_VALUE END) AS P90,
    min(DATA_VALUE) AS MIN, max(DATA_VALUE) AS MAX,
    CAST(coalesce(sum(DATA_VALUE), 0) AS BIGINT) AS SUM,
    count(DATA_VALUE) AS COUNT
  FROM {name}_rank GROUP BY ID, ELEMENT, YEAR, MONTH, DAY_OF_MONTH
)"""


YEAR_DAY = year_day()

# Per (ID, ELEMENT, YEAR, MONTH) of non-null values.
YEAR_MONTH = """
obs70m AS (
  SELECT ID, ELEMENT, DATA_VALUE,
         CAST(year(DATE) AS INTEGER) AS YEAR, CAST(month(DATE) AS INTEGER) AS MONTH
  FROM t_obs WHERE DATE >= DATE '1970-01-01' AND DATA_VALUE IS NOT NULL
),
ym_rank AS (
  SELECT *,
    row_number() OVER (PARTITION BY ID, ELEMENT, YEAR, MONTH ORDER BY DATA_VALUE) - 1 AS rn0,
    count(*) OVER (PARTITION BY ID, ELEMENT, YEAR, MONTH) AS n
  FROM obs70m
),
ym AS (
  SELECT ID, ELEMENT, YEAR, MONTH,
    max(CASE WHEN rn0 = round((n - 1) * 0.1::DOUBLE) THEN DATA_VALUE END) AS P10,
    max(CASE WHEN rn0 = round((n - 1) * 0.9::DOUBLE) THEN DATA_VALUE END) AS P90,
    min(DATA_VALUE) AS MIN, max(DATA_VALUE) AS MAX,
    CAST(sum(DATA_VALUE) AS BIGINT) AS SUM,
    count(*) AS COUNT,
    make_date(YEAR, MONTH, 1) AS PERIOD_START
  FROM ym_rank GROUP BY ID, ELEMENT, YEAR, MONTH
)"""

# Scale factor per element, rounding to 2 decimals (half-even on the binary value).
def sc(expr: str, element_col: str = "ELEMENT") -> str:
    return f"({expr}) / (CASE WHEN {element_col} IN ('TMIN','TMAX') THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END)"


def r2(expr: str) -> str:
    return f"round_even(({expr}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE"


DAILY_CLIM_LONG = """
dc AS (
  SELECT ID, ELEMENT, MONTH, DAY_OF_MONTH,
    avg(P10) AS P10, avg(P90) AS P90, min(MIN) AS MIN, max(MAX) AS MAX, avg(SUM) AS SUM
  FROM yd GROUP BY ID, ELEMENT, MONTH, DAY_OF_MONTH
)"""

MONTHLY_CLIM_LONG = """
mc AS (
  SELECT ID, ELEMENT, MONTH,
    avg(P10) AS P10, avg(P90) AS P90, min(MIN) AS MIN, max(MAX) AS MAX, avg(SUM) AS SUM
  FROM ym GROUP BY ID, ELEMENT, MONTH
)"""

DAILY = """
dkeys AS (SELECT DISTINCT ID, MONTH, DAY_OF_MONTH FROM dc),
daily AS (
  SELECT k.ID,
    CAST(row_number() OVER (PARTITION BY k.ID ORDER BY k.MONTH, k.DAY_OF_MONTH) AS INTEGER) AS DAY,
    {tmin_p10} AS TMIN_P10, {tmax_p90} AS TMAX_P90, {tmin_min} AS TMIN_MIN, {tmax_max} AS TMAX_MAX,
    {prcp_sum} AS PRCP_SUM, k.MONTH AS MONTH, k.DAY_OF_MONTH AS DAY_OF_MONTH
  FROM dkeys k
  LEFT JOIN dc a ON a.ID = k.ID AND a.MONTH = k.MONTH AND a.DAY_OF_MONTH = k.DAY_OF_MONTH AND a.ELEMENT = 'TMIN'
  LEFT JOIN dc b ON b.ID = k.ID AND b.MONTH = k.MONTH AND b.DAY_OF_MONTH = k.DAY_OF_MONTH AND b.ELEMENT = 'TMAX'
  LEFT JOIN dc c ON c.ID = k.ID AND c.MONTH = k.MONTH AND c.DAY_OF_MONTH = k.DAY_OF_MONTH AND c.ELEMENT = 'PRCP'
)""".format(
    tmin_p10=r2("a.P10 / 10.0::DOUBLE"),
    tmax_p90=r2("b.P90 / 10.0::DOUBLE"),
    tmin_min=r2("a.MIN / 10.0::DOUBLE"),
    tmax_max=r2("b.MAX / 10.0::DOUBLE"),
    prcp_sum=r2("c.SUM / 1.0::DOUBLE"),
)

MONTHLY = """
mkeys AS (SELECT DISTINCT ID, MONTH FROM mc),
monthly AS (
  SELECT k.ID, k.MONTH AS MONTH,
    {tmin_p10} AS TMIN_P10, {tmax_p90} AS TMAX_P90, {tmin_min} AS TMIN_MIN, {tmax_max} AS TMAX_MAX,
    {prcp_sum} AS PRCP_SUM
  FROM mkeys k
  LEFT JOIN mc a ON a.ID = k.ID AND a.MONTH = k.MONTH AND a.ELEMENT = 'TMIN'
  LEFT JOIN mc b ON b.ID = k.ID AND b.MONTH = k.MONTH AND b.ELEMENT = 'TMAX'
  LEFT JOIN mc c ON c.ID = k.ID AND c.MONTH = k.MONTH AND c.ELEMENT = 'PRCP'
)""".format(
    tmin_p10=r2("a.P10 / 10.0::DOUBLE"),
    tmax_p90=r2("b.P90 / 10.0::DOUBLE"),
    tmin_min=r2("a.MIN / 10.0::DOUBLE"),
    tmax_max=r2("b.MAX / 10.0::DOUBLE"),
    prcp_sum=r2("c.SUM / 1.0::DOUBLE"),
)


def _hist_cols() -> str:
    out = []
    for alias, e in (("a", "TMIN"), ("b", "TMAX"), ("c", "PRCP")):
        for s in ("P10", "P90", "MIN", "MAX", "SUM"):
            if e in ("TMIN", "TMAX"):
                out.append(f"{r2(f'{alias}.{s} / 10.0::DOUBLE')} AS {e}_{s}")
            elif s in ("P10", "P90"):
                out.append(f"{r2(f'CAST({alias}.{s} AS DOUBLE)')} AS {e}_{s}")
            else:
                out.append(f"{alias}.{s} AS {e}_{s}")
    for alias, e in (("a", "TMIN"), ("b", "TMAX"), ("c", "PRCP")):
        out.append(f"{alias}.COUNT AS {e}_ENTRY_COUNT")
    return ",\n    ".join(out)


HISTORY = f"""
hkeys AS (SELECT ID, YEAR, MONTH, min(PERIOD_START) AS PERIOD_START FROM ym GROUP BY ID, YEAR, MONTH),
history AS (
  SELECT k.ID, k.PERIOD_START, k.YEAR, k.MONTH,
    {_hist_cols()}
  FROM hkeys k
  LEFT JOIN ym a ON a.ID = k.ID AND a.YEAR = k.YEAR AND a.MONTH = k.MONTH AND a.ELEMENT = 'TMIN'
  LEFT JOIN ym b ON b.ID = k.ID AND b.YEAR = k.YEAR AND b.MONTH = k.MONTH AND b.ELEMENT = 'TMAX'
  LEFT JOIN ym c ON c.ID = k.ID AND c.YEAR = k.YEAR AND c.MONTH = k.MONTH AND c.ELEMENT = 'PRCP'
)"""


# --------------------------------------------------------------------------- stations

_PREFIX_LIST = "(['CHM000','JA0000','KSM000','FRE000','GMM000','UKE000','IDM000','MXM000','JAW000','USW000'])"
_MATCH = " OR ".join(f"starts_with(ID, '{p}')" for p in ("CHM", "JA", "KSM", "FRE", "GMM", "UKE", "IDM", "MXM"))

STATIONS = f"""
stations AS (
  SELECT {_PREFIX_LIST}[n_nationkey % 10 + 1] || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS ID,
    CAST(-60 + 5 * n_nationkey AS DOUBLE) AS LATITUDE,
    CAST(-170 + 14 * n_nationkey AS DOUBLE) AS LONGITUDE,
    CAST(n_nationkey * 12.5 - 100 AS DOUBLE) AS ELEVATION,
    CASE WHEN n_nationkey % 2 = 1 THEN 'S' || CAST(n_nationkey % 7 AS VARCHAR) ELSE '' END AS STATE,
    trim(n_name) AS NAME,
    CASE WHEN n_nationkey % 2 = 0 THEN 'GSN' ELSE '' END AS GSN_FLAG,
    CASE WHEN n_nationkey % 3 = 0 THEN 'HCN' ELSE '' END AS HCN_CRN_FLAG,
    CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE lpad(CAST(n_nationkey AS VARCHAR), 5, '0') END AS WMO_ID
  FROM nation
),
matched AS (SELECT * FROM stations WHERE {_MATCH})"""

# Stations without a value: one per region, those with an even key with one null observation.
FLAGGED = """
silent AS (
  SELECT 'CHM000' || CAST(90000 + r_regionkey AS VARCHAR) AS ID,
    CAST(r_regionkey * 10 - 20 AS DOUBLE) AS LATITUDE, CAST(r_regionkey * 20 - 40 AS DOUBLE) AS LONGITUDE,
    10.0::DOUBLE AS ELEVATION, '' AS STATE, trim(r_name) AS NAME, '' AS GSN_FLAG, '' AS HCN_CRN_FLAG, '' AS WMO_ID
  FROM region
),
some_obs AS (
  SELECT ID, DATE, DATA_VALUE FROM t_obs
  UNION ALL
  SELECT 'CHM000' || CAST(90000 + r_regionkey AS VARCHAR), DATE '1971-03-05', NULL FROM region WHERE r_regionkey IN (0, 2, 4)
),
flagged AS (
  SELECT s.*,
    NOT (EXISTS (SELECT 1 FROM some_obs o WHERE o.ID = s.ID AND o.DATE >= DATE '1970-01-01')
         AND EXISTS (SELECT 1 FROM some_obs o WHERE o.ID = s.ID AND o.DATE >= DATE '1970-01-01'
                     AND o.DATA_VALUE IS NOT NULL)) AS MISSING
  FROM (SELECT * FROM matched UNION ALL SELECT * FROM silent) s
)"""

WIDE = YEAR_MONTH + "," + year_day("ydw", "") + """,
wide AS (
  SELECT ID AS STATION, make_date(YEAR, MONTH, DAY_OF_MONTH) AS DATE,
    max(CASE WHEN ELEMENT = 'TMIN' THEN P10 / 10.0::DOUBLE END) AS TMIN_P10,
    max(CASE WHEN ELEMENT = 'TMAX' THEN P90 / 10.0::DOUBLE END) AS TMAX_P90,
    max(CASE WHEN ELEMENT = 'TMIN' THEN MIN / 10.0::DOUBLE END) AS TMIN_MIN,
    max(CASE WHEN ELEMENT = 'TMAX' THEN MAX / 10.0::DOUBLE END) AS TMAX_MAX,
    max(CASE WHEN ELEMENT = 'PRCP' THEN CAST(SUM AS DOUBLE) END) AS PRCP_SUM
  FROM ydw GROUP BY ID, YEAR, MONTH, DAY_OF_MONTH
),
wide_day AS (
  SELECT STATION AS ID, CAST(dayofyear(DATE) AS INTEGER) AS DAY,
    {a1} AS TMIN_P10, {a2} AS TMAX_P90, {a3} AS TMIN_MIN, {a4} AS TMAX_MAX, {a5} AS PRCP_SUM,
    CAST(arg_min(month(DATE), DATE) AS INTEGER) AS MONTH,
    CAST(arg_min(day(DATE), DATE) AS INTEGER) AS DAY_OF_MONTH
  FROM wide WHERE DATE >= DATE '1970-01-01' GROUP BY STATION, dayofyear(DATE)
),
wide_monthly AS (
  SELECT ID, YEAR, MONTH,
    max(CASE WHEN ELEMENT = 'TMIN' THEN P10 / 10.0::DOUBLE END) AS TMIN_P10,
    max(CASE WHEN ELEMENT = 'TMAX' THEN P90 / 10.0::DOUBLE END) AS TMAX_P90,
    max(CASE WHEN ELEMENT = 'TMIN' THEN MIN / 10.0::DOUBLE END) AS TMIN_MIN,
    max(CASE WHEN ELEMENT = 'TMAX' THEN MAX / 10.0::DOUBLE END) AS TMAX_MAX,
    max(CASE WHEN ELEMENT = 'PRCP' THEN CAST(SUM AS DOUBLE) END) AS PRCP_SUM
  FROM ym GROUP BY ID, YEAR, MONTH
),
wide_month AS (
  SELECT ID, MONTH,
    {a1} AS TMIN_P10, {a2} AS TMAX_P90, {a3} AS TMIN_MIN, {a4} AS TMAX_MAX, {a5} AS PRCP_SUM
  FROM wide_monthly GROUP BY ID, MONTH
)"""


def shown(x: str) -> str:
    """The double that printing ``x`` with two decimals shows."""
    return f"CAST(CASE WHEN ({x}) IS NULL THEN NULL ELSE printf('%.2f', {x}) END AS DOUBLE)"


def exact_avg2(c: str) -> str:
    """Mean from an exact integer sum in units of 2^-60 (the fixture's values are larger than 2^-8 or zero), rounded once."""
    units = f"sum(CAST({c} * 1152921504606846976.0::DOUBLE AS HUGEINT))"
    cut = "1099511627776"  # 2^40: the sum in two parts that a double holds exactly
    total = f"(CAST({units} // {cut} AS DOUBLE) * {cut}.0::DOUBLE + CAST({units} % {cut} AS DOUBLE)) / 1152921504606846976.0::DOUBLE"
    return shown(f"{total} / count({c})")


def exact_ext2(fn: str, c: str) -> str:
    return shown(f"{fn}({c})")


WIDE = WIDE.format(
    a1=exact_avg2("TMIN_P10"), a2=exact_avg2("TMAX_P90"), a3=exact_ext2("min", "TMIN_MIN"),
    a4=exact_ext2("max", "TMAX_MAX"), a5=exact_avg2("PRCP_SUM"),
)

# --------------------------------------------------------------------------- chart helpers

VALID = "TMAX_MAX IS NOT NULL AND TMIN_MIN IS NOT NULL AND TMAX_P90 IS NOT NULL AND TMIN_P10 IS NOT NULL"
PRCP0 = "CASE WHEN PRCP_SUM IS NULL OR isnan(PRCP_SUM) OR PRCP_SUM = 0 THEN 0.0::DOUBLE ELSE PRCP_SUM END"

CHARTS = f"""
v_daily AS (SELECT ID, DAY, TMIN_P10, TMAX_P90, TMIN_MIN, TMAX_MAX, {PRCP0} AS PRCP_SUM, MONTH, DAY_OF_MONTH
            FROM daily WHERE {VALID}),
v_monthly AS (SELECT ID, MONTH, TMIN_P10, TMAX_P90, TMIN_MIN, TMAX_MAX, {PRCP0} AS PRCP_SUM FROM monthly WHERE {VALID}),
v_history AS (SELECT *, YEAR * 12 + MONTH AS MN FROM history WHERE PERIOD_START IS NOT NULL AND {VALID}),
c_daily AS (
  SELECT ID, make_date(2020, MONTH, DAY_OF_MONTH) AS X, TMAX_MAX AS MAX_TEMP, TMIN_MIN AS MIN_TEMP, PRCP_SUM AS PRCP,
         CAST(MONTH AS VARCHAR) || '-' || CAST(DAY_OF_MONTH AS VARCHAR) AS LABEL
  FROM v_daily
),
c_monthly AS (
  SELECT v.ID, make_date(2020, v.MONTH, 1) AS X, v.TMAX_MAX AS MAX_TEMP, v.TMIN_MIN AS MIN_TEMP, v.PRCP_SUM AS PRCP,
         CAST(v.MONTH AS VARCHAR) AS LABEL,
         coalesce(v.MONTH - (SELECT max(p.MONTH) FROM v_monthly p WHERE p.ID = v.ID AND p.MONTH < v.MONTH) > 1, false) AS GAP
  FROM v_monthly v
),
c_history AS (
  SELECT v.ID, v.PERIOD_START AS X, v.YEAR, v.MONTH, v.TMAX_MAX AS MAX_TEMP, v.TMIN_MIN AS MIN_TEMP,
         CASE WHEN v.PRCP_SUM IS NULL OR v.PRCP_SUM = 0 THEN 0.0::DOUBLE ELSE CAST(v.PRCP_SUM AS DOUBLE) END AS PRCP,
         coalesce(v.TMIN_ENTRY_COUNT, 0) AS TMIN_ENTRY_COUNT, coalesce(v.TMAX_ENTRY_COUNT, 0) AS TMAX_ENTRY_COUNT,
         coalesce(v.PRCP_ENTRY_COUNT, 0) AS PRCP_ENTRY_COUNT,
         CAST(v.YEAR AS VARCHAR) || '-' || lpad(CAST(v.MONTH AS VARCHAR), 2, '0') AS LABEL,
         coalesce(abs(v.MN - (SELECT p.MN FROM v_history p WHERE p.ID = v.ID AND p.PERIOD_START < v.PERIOD_START
                              ORDER BY p.PERIOD_START DESC LIMIT 1)) > 1, false) AS GAP
  FROM v_history v
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


OBS_COLS = "ID, ELEMENT, DATE, DATA_VALUE"
ALL_OUT = (T_OBS, YEAR_DAY, DAILY_CLIM_LONG, DAILY, YEAR_MONTH, MONTHLY_CLIM_LONG, MONTHLY, HISTORY)


def fmt(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE printf('%.2f', {expr}) END"


def _pfx(col: str = "ID") -> str:
    return f"CASE WHEN substr({col}, 3, 1) = '0' THEN substr({col}, 1, 2) ELSE substr({col}, 1, 3) END"


def _summary_sql(where_extra: str = "") -> str:
    return with_(T_OBS, STATIONS, YEAR_MONTH, HISTORY) + f"""
, cnt AS (
  SELECT ID,
    count(*) FILTER (WHERE ELEMENT = 'TMIN' AND DATA_VALUE IS NOT NULL) AS TMIN_raw_count,
    count(*) FILTER (WHERE ELEMENT = 'TMAX' AND DATA_VALUE IS NOT NULL) AS TMAX_raw_count,
    count(*) FILTER (WHERE ELEMENT = 'PRCP' AND DATA_VALUE IS NOT NULL) AS PRCP_raw_count
  FROM t_obs WHERE DATE >= DATE '1970-01-01' AND ID IN (SELECT ID FROM matched) GROUP BY ID
),
hr AS (SELECT ID, count(*) AS monthly_history_rows FROM history GROUP BY ID)
SELECT c.ID, TMIN_raw_count, TMAX_raw_count, PRCP_raw_count, CAST(NULL AS BIGINT) AS monthly_history_rows,
       'daily' AS PERIOD{where_extra}
FROM cnt c
UNION ALL
SELECT c.ID, TMIN_raw_count, TMAX_raw_count, PRCP_raw_count, h.monthly_history_rows, 'monthly' AS PERIOD{where_extra}
FROM cnt c JOIN hr h ON h.ID = c.ID
"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    obs = with_(T_OBS)
    since = "DATE >= DATE '1970-01-01'"
    q["scan_obs_partitioned"] = obs + " SELECT ID, strftime(DATE, '%Y%m%d') AS DATE, DATA_VALUE, ELEMENT FROM t_obs"
    q["sort_obs"] = obs + (
        f" SELECT {OBS_COLS}, row_number() OVER (ORDER BY ID, DATE, ELEMENT NULLS FIRST, DATA_VALUE NULLS FIRST) - 1 AS POSITION FROM t_obs")
    for k in ("scan_obs_merged", "sink_merged_parquet", "parse_date"):
        q[k] = obs + f" SELECT {OBS_COLS} FROM t_obs"
    q["scan_stations_fixed_width"] = with_(STATIONS) + " SELECT * FROM stations"
    q["scan_wide_station_file"] = with_(T_OBS, WIDE) + " SELECT * FROM wide"
    q["scan_output_csv"] = with_(*ALL_OUT) + " SELECT * FROM monthly"
    q["sink_mode"] = with_(*ALL_OUT) + (
        " SELECT * REPLACE ("
        + ", ".join(f"CASE WHEN {_MATCH} OR {c} IS NULL THEN {c} ELSE CAST(MONTH AS DOUBLE) END AS {c}" for c in ("TMAX_MAX", "TMAX_P90"))
        + ") FROM monthly"
    )

    daily_txt = ", ".join(
        [f"CAST(DAY AS VARCHAR) AS DAY"]
        + [f"{fmt(c)} AS {c}" for c in ("TMIN_P10", "TMAX_P90", "TMIN_MIN", "TMAX_MAX", "PRCP_SUM")]
        + ["CAST(MONTH AS VARCHAR) AS MONTH", "CAST(DAY_OF_MONTH AS VARCHAR) AS DAY_OF_MONTH"]
    )
    q["sink_daily_csv"] = with_(*ALL_OUT) + f" SELECT {_pfx()} AS PFX, ID, {daily_txt} FROM daily"
    q["sink_bundle_csv"] = q["sink_daily_csv"]
    monthly_txt = ", ".join(
        ["CAST(MONTH AS VARCHAR) AS MONTH"]
        + [f"{fmt(c)} AS {c}" for c in ("TMIN_P10", "TMAX_P90", "TMIN_MIN", "TMAX_MAX", "PRCP_SUM")]
    )
    q["sink_monthly_csv"] = with_(*ALL_OUT) + f" SELECT {_pfx()} AS PFX, ID, {monthly_txt} FROM monthly"
    hist_parts = ["strftime(PERIOD_START, '%Y-%m-%d') AS PERIOD_START", "CAST(YEAR AS VARCHAR) AS YEAR",
                  "CAST(MONTH AS VARCHAR) AS MONTH"]
    for e in ("TMIN", "TMAX", "PRCP"):
        for s_ in ("P10", "P90", "MIN", "MAX", "SUM"):
            c = f"{e}_{s_}"
            if e != "PRCP" or s_ in ("P10", "P90"):
                hist_parts.append(f"{fmt(c)} AS {c}")
            else:
                hist_parts.append(f"CAST({c} AS VARCHAR) AS {c}")
    for e in ("TMIN", "TMAX", "PRCP"):
        hist_parts.append(f"CAST({e}_ENTRY_COUNT AS VARCHAR) AS {e}_ENTRY_COUNT")
    q["sink_history_csv"] = with_(*ALL_OUT) + f" SELECT {_pfx()} AS PFX, ID, {', '.join(hist_parts)} FROM history"
    q["sink_summary_json"] = _summary_sql(f", {_pfx('c.ID')} AS PFX")
    summary = _summary_sql()
    at = summary.index("SELECT c.ID")

    def line(text: str) -> str:
        """A CSV line of the columns of ``text`` (``expr AS name, ...``)."""
        exprs = [e.rsplit(" AS ", 1)[0] for e in re.split(r", (?=CAST\(|CASE WHEN|strftime)", text)]
        return " || ',' || ".join(f"coalesce({e}, '')" for e in exprs)

    def stats(name: str) -> str:
        return f"'\"{name}\":' || CAST({name} AS VARCHAR)"

    counts = " || ',' || ".join(stats(f"{e}_raw_count") for e in ("TMIN", "TMAX", "PRCP"))
    rows = "', \"monthly_history_rows\":'".replace(" ", "")
    q["assemble_all_stations"] = summary[:at].replace(
        HISTORY, ",".join((HISTORY, YEAR_DAY, DAILY_CLIM_LONG, DAILY, MONTHLY_CLIM_LONG, MONTHLY))) + f"""
, lines AS (
SELECT 'daily' AS KIND, ID, {line(daily_txt)} AS LINE FROM daily
UNION ALL SELECT 'monthly', ID, {line(monthly_txt)} FROM monthly
UNION ALL SELECT 'monthly-history', ID, {line(', '.join(hist_parts))} FROM history
UNION ALL SELECT 'daily-stats', ID, '{{' || {counts} || '}}' FROM cnt
UNION ALL SELECT 'monthly-stats', c.ID, '{{' || {counts} || {rows} || CAST(h.monthly_history_rows AS VARCHAR) || '}}'
  FROM cnt c JOIN hr h ON h.ID = c.ID
)
SELECT KIND, {_pfx()} AS PFX, ID, LINE FROM lines WHERE ID IN (SELECT ID FROM matched)
"""
    geo = "SELECT 'Feature' AS FEATURE_TYPE, 'Point' AS GEOMETRY_TYPE, * FROM flagged"
    q["sink_geojson"] = with_(T_OBS, STATIONS, FLAGGED) + " " + geo
    q["geojson_features"] = q["sink_geojson"]
    q["sink_skip_empty"] = obs + (
        f" SELECT DISTINCT ID FROM t_obs WHERE {since} AND DATA_VALUE IS NOT NULL"
    )

    q["filter_from_1970"] = obs + f" SELECT {OBS_COLS} FROM t_obs WHERE {since}"
    q["filter_not_null"] = obs + f" SELECT {OBS_COLS} FROM t_obs WHERE DATA_VALUE IS NOT NULL"
    q["filter_station"] = with_(T_OBS, STATIONS) + f" SELECT {OBS_COLS} FROM t_obs WHERE ID IN (SELECT ID FROM matched)"
    q["filter_station_prefix"] = with_(STATIONS) + " SELECT * FROM matched"
    q["filter_blank_lines"] = (
        f"SELECT {_PREFIX_LIST}[n_nationkey % 10 + 1] || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS ID, "
        "CASE WHEN n_nationkey % 4 = 1 THEN 79 ELSE 85 END AS LINE_LENGTH FROM nation"
    )
    q["scale_tenths"] = obs + f" SELECT ID, ELEMENT, DATE, {sc('DATA_VALUE')} AS VALUE FROM t_obs"
    q["date_parts"] = obs + (
        f" SELECT {OBS_COLS}, CAST(year(DATE) AS INTEGER) AS YEAR, CAST(month(DATE) AS INTEGER) AS MONTH,"
        " CAST(day(DATE) AS INTEGER) AS DAY_OF_MONTH, CAST(dayofyear(DATE) AS INTEGER) AS DAY_OF_YEAR FROM t_obs"
    )
    q["period_start"] = obs + " SELECT ID, ELEMENT, DATE, make_date(year(DATE), month(DATE), 1) AS PERIOD_START FROM t_obs"
    q["round_2"] = obs + f" SELECT ID, ELEMENT, DATE, {r2('DATA_VALUE / 8.0::DOUBLE')} AS VALUE FROM t_obs"
    q["station_path_prefix"] = with_(STATIONS) + f" SELECT ID, {_pfx()} AS PFX FROM stations"
    q["lookup_station"] = with_(T_OBS, STATIONS) + " SELECT * FROM stations WHERE ID IN (SELECT ID FROM t_obs)"
    q["flag_missing"] = with_(T_OBS, STATIONS, FLAGGED) + " SELECT * FROM flagged"
    q["filter_bounds"] = q["flag_missing"] + (
        " WHERE LATITUDE BETWEEN -40 AND 40 AND LONGITUDE BETWEEN -150 AND 150 AND NOT MISSING"
    )
    q["heat_points"] = with_(T_OBS, STATIONS, FLAGGED) + (
        " SELECT ID, LATITUDE, LONGITUDE, 1 AS WEIGHT FROM flagged WHERE NOT MISSING"
    )

    ydq = with_(T_OBS, YEAR_DAY)
    ymq = with_(T_OBS, YEAR_MONTH)
    q["agg_nearest_quantile"] = ymq + " SELECT ID, ELEMENT, YEAR, MONTH, P10, P90 FROM ym"
    q["agg_year_day"] = ydq + " SELECT * FROM yd"
    q["agg_daily_climatology"] = with_(T_OBS, YEAR_DAY, DAILY_CLIM_LONG) + (
        " SELECT ID, ELEMENT, MONTH, DAY_OF_MONTH, "
        + ", ".join(f"{r2(sc(s_))} AS {s_}" for s_ in ("P10", "P90", "MIN", "MAX", "SUM"))
        + " FROM dc"
    )
    q["agg_year_month"] = ymq + " SELECT * FROM ym"
    q["agg_monthly_history"] = ymq + (
        " SELECT ID, ELEMENT, YEAR, MONTH, PERIOD_START, "
        + ", ".join(f"{r2(sc(s_))} AS {s_}" for s_ in ("P10", "P90", "MIN", "MAX", "SUM"))
        + ", COUNT AS ENTRY_COUNT FROM ym"
    )
    q["agg_monthly_climatology"] = with_(T_OBS, YEAR_MONTH, MONTHLY_CLIM_LONG) + (
        " SELECT ID, ELEMENT, MONTH, "
        + ", ".join(f"{r2(sc(s_))} AS {s_}" for s_ in ("P10", "P90", "MIN", "MAX", "SUM"))
        + " FROM mc"
    )
    q["agg_raw_count"] = obs + (
        " SELECT ID,"
        " count(*) FILTER (WHERE ELEMENT = 'TMIN') AS TMIN_raw_count,"
        " count(*) FILTER (WHERE ELEMENT = 'TMAX') AS TMAX_raw_count,"
        " count(*) FILTER (WHERE ELEMENT = 'PRCP') AS PRCP_raw_count"
        f" FROM t_obs WHERE {since} AND DATA_VALUE IS NOT NULL GROUP BY ID"
    )
    q["agg_history_rows"] = ymq + (
        " SELECT ID, count(*) AS monthly_history_rows FROM (SELECT DISTINCT ID, YEAR, MONTH FROM ym) GROUP BY ID"
    )
    q["agg_min_period_start"] = ymq + " SELECT ID, YEAR, MONTH, min(PERIOD_START) AS PERIOD_START FROM ym GROUP BY ID, YEAR, MONTH"
    q["agg_wide_by_ordinal_day"] = with_(T_OBS, WIDE) + " SELECT * FROM wide_day"
    q["agg_wide_by_month"] = with_(T_OBS, WIDE) + " SELECT * FROM wide_month"
    q["month_ticks"] = with_(T_OBS, WIDE) + (
        " SELECT ID, DAY AS TICK, CAST(MONTH AS VARCHAR) || '/1' AS TICK_LABEL FROM wide_day WHERE DAY_OF_MONTH = 1"
    )

    charts = with_(*ALL_OUT, CHARTS)

    def bounds(view: str, name: str) -> str:
        return (
            f"SELECT ID, CAST(floor(least(min(MAX_TEMP), min(MIN_TEMP))) - 2 AS BIGINT) AS Y_MIN,"
            f" CAST(ceil(greatest(max(MAX_TEMP), max(MIN_TEMP))) + 2 AS BIGINT) AS Y_MAX, '{name}' AS CHART"
            f" FROM {view} GROUP BY ID"
        )

    q["agg_axis_bounds"] = charts + " " + " UNION ALL ".join(
        bounds(v, n) for v, n in (("c_daily", "daily"), ("c_monthly", "monthly"), ("c_history", "history"))
    )
    q["union_distinct_keys"] = with_(T_OBS, YEAR_DAY, DAILY_CLIM_LONG, YEAR_MONTH, MONTHLY_CLIM_LONG) + (
        " SELECT DISTINCT ID, 'day' AS LEVEL, CAST(NULL AS INTEGER) AS YEAR, MONTH, DAY_OF_MONTH FROM dc"
        " UNION ALL SELECT DISTINCT ID, 'month', NULL, MONTH, NULL FROM mc"
        " UNION ALL SELECT DISTINCT ID, 'year_month', YEAR, MONTH, NULL FROM ym"
    )
    stat_names = ("P10", "P90", "MIN", "MAX", "SUM", "COUNT")
    renamed = lambda e: {s_: f"{e}_{'ENTRY_COUNT' if s_ == 'COUNT' else s_}" for s_ in stat_names}
    q["rename_element_columns"] = ymq + " SELECT ID, PERIOD_START, YEAR, MONTH, " + ", ".join(
        f"CASE WHEN ELEMENT = '{e}' THEN {s_} END AS {c}" for e in ("TMIN", "TMAX", "PRCP") for s_, c in renamed(e).items()
    ) + " FROM ym"
    q["existing_columns_only"] = ymq + " SELECT ID, PERIOD_START, YEAR, MONTH, " + ", ".join(
        f"{s_} AS {c}" for s_, c in renamed("TMAX").items()) + " FROM ym WHERE ELEMENT = 'TMAX'"
    q["join_elements_daily"] = with_(*ALL_OUT) + (
        " SELECT ID, MONTH, DAY_OF_MONTH, TMIN_P10, TMAX_P90, TMIN_MIN, TMAX_MAX, PRCP_SUM FROM daily"
    )
    q["join_elements_monthly"] = with_(*ALL_OUT) + " SELECT * FROM monthly"
    q["join_elements_history"] = with_(*ALL_OUT) + " SELECT * EXCLUDE (PERIOD_START) FROM history"
    q["assemble_daily"] = with_(*ALL_OUT) + " SELECT * FROM daily"
    q["assemble_monthly"] = with_(*ALL_OUT) + " SELECT * FROM monthly"
    q["assemble_history"] = with_(*ALL_OUT) + " SELECT * FROM history"
    q["sort_outputs"] = with_(*ALL_OUT) + " SELECT *, row_number() OVER (ORDER BY ID, YEAR, MONTH) - 1 AS POSITION FROM history"

    cmp_cols = []
    ids = ("CHM00000000", "JA000000001", "KSM00000002")
    for i in ids:
        cmp_cols.append(f"max(CASE WHEN ID = '{i}' THEN TMAX_MAX END) AS \"{i}_MAX_TEMP\"")
        cmp_cols.append(f"max(CASE WHEN ID = '{i}' THEN TMIN_MIN END) AS \"{i}_MIN_TEMP\"")
    q["compare_stations"] = charts + (
        f" SELECT MONTH, {', '.join(cmp_cols)} FROM v_monthly WHERE ID IN {ids} GROUP BY MONTH"
    )
    q["day_index"] = with_(*ALL_OUT) + " SELECT ID, MONTH, DAY_OF_MONTH, DAY FROM daily"
    seasonal = charts.replace(T_OBS, T_OBS_AND_SEASONAL)
    q["gap_flag_monthly"] = seasonal + " SELECT ID, X, GAP FROM c_monthly"
    q["gap_flag_history"] = charts + " SELECT ID, X, GAP FROM c_history"
    q["chart_valid_rows"] = charts + " SELECT * FROM v_daily"
    q["chart_daily_series"] = charts + " SELECT * FROM c_daily"
    q["chart_monthly_series"] = charts + " SELECT * FROM c_monthly"
    q["chart_history_series"] = charts + " SELECT * FROM c_history"
    q["chart_variant"] = charts + (
        " SELECT ID, make_date(2020, MONTH, DAY_OF_MONTH) AS X, TMAX_P90 AS MAX_TEMP, TMIN_P10 AS MIN_TEMP,"
        " PRCP_SUM AS PRCP, CAST(MONTH AS VARCHAR) || '-' || CAST(DAY_OF_MONTH AS VARCHAR) AS LABEL FROM v_daily"
    )
    q["chart_date_label"] = charts + (
        " SELECT ID, make_date(2020, MONTH, DAY_OF_MONTH) AS X,"
        " CAST(MONTH AS VARCHAR) || '月' || CAST(DAY_OF_MONTH AS VARCHAR) || '日' AS LABEL, 'daily' AS CHART FROM v_daily"
        " UNION ALL SELECT ID, PERIOD_START AS X,"
        " CAST(YEAR AS VARCHAR) || '年' || CAST(MONTH AS VARCHAR) || '月' AS LABEL, 'history' AS CHART FROM v_history"
    )
    return q
