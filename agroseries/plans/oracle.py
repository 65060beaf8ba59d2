"""DuckDB oracle SQL for every registered query.

The binding CTEs repeat, in plain SQL, the expressions of ``bindings.py`` and
the operator semantics; each query composes them with ``WITH``.  Doubles are
rounded to 6 decimals in the final projection (the Spark side does the same
in ``registry.finalize``).
"""

from __future__ import annotations

from ..bindings import CROSSTAB_VARIABLES, DAILY_PARAMS, DROPPED_NATION, SENTINEL_LINE

YEARS = list(range(1995, 2002))


def code_sql(expr: str) -> str:
    t = f"trim(CAST({expr} AS VARCHAR))"
    return f"(CASE WHEN length({t}) < 7 THEN lpad({t}, 7, '0') ELSE {t} END)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body.strip())


def with_(*names: str, extra: str = "") -> str:
    """WITH clause holding ``names`` and everything they depend on, once each."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][1]}\n)" for n in order]
    if extra:
        parts.append(extra.strip().lstrip(","))
    return "WITH " + ",\n".join(parts)


cte("nsite", (), f"""
  SELECT {code_sql('n_nationkey')} AS site_id, n_name AS name, n_nationkey,
         n_regionkey AS region_id,
         round(CAST(-22.5 AS DOUBLE) - CAST(n_nationkey AS DOUBLE) * CAST(0.17 AS DOUBLE), 2) AS lat,
         CAST(-48.0 AS DOUBLE) - CAST(((n_nationkey * 7) % 25) AS DOUBLE) * CAST(0.25 AS DOUBLE) AS lon
  FROM nation""")

cte("site", ("nsite",), f"""
  SELECT s.site_id, s.name, s.region_id, r.r_name AS region, s.lat, s.lon
  FROM nsite s LEFT JOIN region r ON s.region_id = r.r_regionkey
  """)

cte("ssite", ("nsite",), """
  SELECT s_suppkey, site_id, name, lat, lon FROM supplier JOIN nsite ON s_nationkey = n_nationkey""")

cte("lines", ("ssite",), """
  SELECT l.*, s.site_id, s.name, s.lat, s.lon FROM lineitem l JOIN ssite s ON l.l_suppkey = s.s_suppkey""")

cte("daily_raw", ("lines",), " UNION ALL ".join(
    f"SELECT site_id, name, lat, lon, CAST(l_shipdate AS DATE) AS date, '{p}' AS param, "
    f"CASE WHEN l_linenumber = {SENTINEL_LINE} THEN CAST(-999.0 AS DOUBLE) ELSE CAST({e} AS DOUBLE) END AS value "
    f"FROM lines"
    for p, e in DAILY_PARAMS))

cte("daily", ("daily_raw",), """
  SELECT site_id, name, lat, lon, date, param,
         CASE WHEN value IS NULL OR isnan(value) OR value = -999 THEN NULL ELSE value END AS value
  FROM daily_raw""")


def rule_sql(p: str = "param") -> str:
    lp = f"lower({p})"
    return (f"(CASE WHEN ({lp} LIKE '%prec%' AND {lp} NOT LIKE '%prob%') OR {lp} LIKE '%count%' THEN 'sum' "
            f"WHEN {lp} LIKE '%prec%' AND {lp} LIKE '%prob%' THEN 'mean' "
            f"WHEN {lp} LIKE '%max%' THEN 'max' WHEN {lp} LIKE '%min%' THEN 'min' "
            f"WHEN {lp} LIKE '%range%' THEN 'range' ELSE 'mean' END)")


cte("dk", ("daily",), """
  SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
         CASE WHEN day(date) <= 10 THEN 1 WHEN day(date) <= 20 THEN 2 ELSE 3 END AS dekad
  FROM daily""")

cte("dagg", ("dk",), """
  SELECT site_id, name, lat, lon, year, month, dekad, param,
         sum(value) AS s, avg(value) AS a, max(value) AS mx, min(value) AS mn
  FROM dk
  WHERE site_id IS NOT NULL AND name IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL
    AND year IS NOT NULL AND month IS NOT NULL AND dekad IS NOT NULL AND param IS NOT NULL
  GROUP BY site_id, name, lat, lon, year, month, dekad, param""")

cte("dekads", ("dagg",), f"""
  SELECT * FROM (
    SELECT site_id, name, lat, lon, year, month, dekad, param,
           CASE {rule_sql()} WHEN 'sum' THEN coalesce(s, 0.0) WHEN 'max' THEN mx WHEN 'min' THEN mn
                WHEN 'range' THEN mx - mn ELSE a END AS value
    FROM dagg) WHERE value IS NOT NULL""")

cte("collapsed", ("dekads",), """
  SELECT site_id, name, year, param, (month - 1) * 3 + dekad AS dekad36, avg(value) AS value
  FROM dekads GROUP BY site_id, name, year, param, (month - 1) * 3 + dekad""")

cte("sy", ("collapsed",), "SELECT DISTINCT site_id, year FROM collapsed")
cte("valid", ("sy",), """
  SELECT b.site_id, b.year AS season_year FROM sy a JOIN sy b ON a.site_id = b.site_id AND a.year = b.year - 1""")
cte("season", ("collapsed", "valid"), """
  SELECT c.site_id, c.name, v.season_year, 1 AS rel_year, c.dekad36, c.param, c.value
  FROM collapsed c JOIN valid v ON c.site_id = v.site_id AND c.year + 1 = v.season_year
  UNION ALL
  SELECT c.site_id, c.name, v.season_year, 2 AS rel_year, c.dekad36, c.param, c.value
  FROM collapsed c JOIN valid v ON c.site_id = v.site_id AND c.year = v.season_year""")

WINDOW_EXACT = "((rel_year = 1 AND dekad36 BETWEEN 26 AND 36) OR (rel_year = 2 AND dekad36 BETWEEN 1 AND 15))"
cte("win", ("season",), f"SELECT * FROM season WHERE {WINDOW_EXACT}")


def window_substring_sql() -> str:
    nm = "(param || '_dec' || CAST(dekad36 AS VARCHAR) || '_ano' || CAST(rel_year AS VARCHAR))"
    y1 = " OR ".join(f"contains({nm}, 'dec{i}')" for i in range(26, 37))
    y2 = " OR ".join(f"contains({nm}, 'dec{i}')" for i in range(1, 16))
    return (f"(contains({nm}, 'dec') AND ((contains({nm}, 'ano1') AND ({y1})) "
            f"OR (contains({nm}, 'ano2') AND ({y2}))))")


cte("pagg", ("lines",), """
  SELECT site_id, name, CAST(year(l_shipdate) AS INTEGER) AS year,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS planted,
         sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END) AS harvested,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS val
  FROM lines GROUP BY site_id, name, CAST(year(l_shipdate) AS INTEGER)""")

cte("production", ("pagg",), """
  SELECT site_id, name, year,
         CAST(CAST(planted AS DECIMAL(18,2)) AS DOUBLE) AS planted_ha,
         CAST(CAST(harvested AS DECIMAL(18,2)) AS DOUBLE) AS harvested_ha,
         CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) / 1000.0 AS produced_t,
         CASE WHEN CAST(CAST(harvested AS DECIMAL(18,2)) AS DOUBLE) = 0 THEN NULL
              ELSE CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) / 1000.0 * 1000.0
                   / CAST(CAST(harvested AS DECIMAL(18,2)) AS DOUBLE) END AS yield_kg_ha,
         CAST(CAST(val AS DECIMAL(18,4)) AS DOUBLE) / 1000.0 AS value_kbrl,
         CAST(CAST(val AS DECIMAL(18,4)) AS DOUBLE) * 100.0
           / CAST(CAST(sum(val) OVER (PARTITION BY year) AS DECIMAL(18,4)) AS DOUBLE) AS value_share
  FROM pagg""")


# ---------------------------------------------------------------------------
# per-query oracle SQL
# ---------------------------------------------------------------------------
PARAMS = [p for p, _ in DAILY_PARAMS]


def _season_names(exact=True):
    out = []
    for p in PARAMS:
        for rel in (1, 2):
            for d in range(1, 37):
                if exact and not ((rel == 1 and 26 <= d <= 36) or (rel == 2 and 1 <= d <= 15)):
                    continue
                out.append((p, rel, d))
    return out


ORACLE: dict[str, str] = {}


def rnd(cols, d=6, prefix=""):
    return ", ".join(f"round({prefix}{c}, {d}) AS {c}" for c in cols)


ORACLE["daily_clean"] = with_("daily") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, date, param, round(value, 6) AS value FROM daily"""

ORACLE["dekad_keys"] = with_("daily") + """
SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       CASE WHEN day(date) <= 10 THEN 1 WHEN day(date) <= 20 THEN 2 ELSE 3 END AS dekad,
       count(*) AS n_rows,
       (CAST(month(date) AS INTEGER) - 1) * 3 + CASE WHEN day(date) <= 10 THEN 1 WHEN day(date) <= 20 THEN 2 ELSE 3 END AS dekad36
FROM daily GROUP BY ALL"""

ORACLE["dekad_aggregate"] = with_("dekads") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, param, round(value, 6) AS value
FROM dekads"""

ORACLE["dekad36_mean"] = with_("collapsed") + """
SELECT site_id, name, year, param, dekad36, round(value, 6) AS value FROM collapsed"""

ORACLE["season_pairs"] = with_("season") + """
SELECT site_id, name, season_year, rel_year, dekad36, param, round(value, 6) AS value FROM season"""

ORACLE["season_window_exact"] = with_("win") + """
SELECT site_id, name, season_year, rel_year, dekad36, param, round(value, 6) AS value FROM win"""

ORACLE["season_window_substring"] = with_("season") + f"""
SELECT rel_year, dekad36, count(*) AS n_rows, round(max(value), 6) AS max_value, round(min(value), 6) AS min_value
FROM season WHERE {window_substring_sql()} GROUP BY rel_year, dekad36"""

ORACLE["season_wide"] = with_("win") + """
SELECT site_id, name, season_year, """ + ", ".join(
    f"round(max(CASE WHEN param = '{p}' AND rel_year = {r} AND dekad36 = {d} THEN value END), 6) AS \"{p}_dec{d}_ano{r}\""
    for p, r, d in _season_names(True)) + """
FROM win GROUP BY site_id, name, season_year"""


# --- production / panel ------------------------------------------------------
for _i, (_name, _col, _dash, _dots) in enumerate(CROSSTAB_VARIABLES):
    cte(f"ct{_i}", (), f"""
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS code, 'L' || CAST(l_linenumber AS VARCHAR) AS name,
         CAST(year(l_shipdate) AS INTEGER) AS y,
         CASE WHEN l_linenumber = {_dash} THEN '-' WHEN l_linenumber = {_dots} THEN '..'
              ELSE CAST({_col} AS VARCHAR) END AS text
  FROM lineitem""")
    cte(f"long{_i}", (f"ct{_i}",), f"""
  SELECT code, name, CAST(yr AS INTEGER) AS year, CASE WHEN y = yr THEN text END AS raw
  FROM ct{_i} CROSS JOIN range({YEARS[0]}, {YEARS[-1] + 1}) t(yr)""")


def clean_sql(c: str) -> str:
    return (f"(CASE WHEN regexp_matches({c}, '^\\s*-\\s*$') THEN 0.0 WHEN isnan(TRY_CAST(trim({c}) AS DOUBLE)) THEN 0.0 "
            f"ELSE coalesce(TRY_CAST(trim({c}) AS DOUBLE), 0.0) END)")


cte("dpanel", ("production",), """
  SELECT site_id, name, year, planted_ha, harvested_ha, yield_kg_ha, value_share,
         planted_ha - harvested_ha AS lost_ha,
         CASE WHEN planted_ha > 0 THEN (planted_ha - harvested_ha) / planted_ha * 100 ELSE 0.0 END AS loss_pct,
         produced_t * 1000.0 AS produced_kg, value_kbrl * 1000.0 AS value_brl
  FROM production""")

cte("pgeo", ("dpanel", "site"), """
  SELECT p.*, s.region_id, s.region, s.lat, s.lon FROM dpanel p LEFT JOIN site s ON p.site_id = s.site_id""")

DPANEL_COLS = ["planted_ha", "harvested_ha", "yield_kg_ha", "value_share", "lost_ha", "loss_pct",
               "produced_kg", "value_brl"]
MEASURES = ["planted_ha", "harvested_ha", "lost_ha", "produced_kg", "value_brl"]

ORACLE["unpivot_years"] = with_("long0") + "\nSELECT code, name, year, raw FROM long0"

ORACLE["clean_dash"] = with_("long0") + f"\nSELECT code, name, year, raw, round({clean_sql('raw')}, 6) AS value FROM long0"

_v = [v[0] for v in CROSSTAB_VARIABLES]
ORACLE["combine_variables"] = with_("long0", "long1", extra=f"""
u AS (SELECT code, name, year, '{_v[0]}' AS variable, raw FROM long0
      UNION ALL SELECT code, name, year, '{_v[1]}' AS variable, raw FROM long1),
w AS (SELECT code, name, year, {", ".join(f"sum({clean_sql('raw')}) FILTER (WHERE variable = '{v}') AS {v}" for v in _v)}
      FROM u GROUP BY code, name, year)""") + f"""
SELECT code, name, year, {", ".join(f"round(coalesce({v}, 0.0), 6) AS {v}" for v in _v)} FROM w"""

ORACLE["production"] = with_("production") + f"""
SELECT site_id, name, year, {rnd(["planted_ha", "harvested_ha", "produced_t", "yield_kg_ha", "value_kbrl", "value_share"], 8)}
FROM production"""

ORACLE["loss_pct"] = with_("dpanel") + f"\nSELECT site_id, name, year, {rnd(DPANEL_COLS)} FROM dpanel"

ORACLE["join_geo"] = with_("pgeo") + f"""
SELECT site_id, name, year, region_id, region, round(lat, 6) AS lat, round(lon, 6) AS lon, {rnd(DPANEL_COLS)} FROM pgeo"""

ORACLE["join_climate"] = with_("pgeo", "win") + f"""
SELECT p.site_id, p.name, p.year, p.region_id, p.region, round(p.lat, 6) AS lat, round(p.lon, 6) AS lon,
       {rnd(DPANEL_COLS, prefix="p.")}, w.param, w.rel_year, w.dekad36, round(w.value, 6) AS value
FROM pgeo p LEFT JOIN win w ON p.site_id = w.site_id AND p.year = w.season_year"""

ORACLE["unmatched"] = with_("dpanel", "site", "win", extra=f"site1 AS (SELECT * FROM site WHERE site_id <> {code_sql(str(DROPPED_NATION))})") + """
SELECT 'no_geography' AS "check", count(*) AS n FROM dpanel p WHERE NOT EXISTS (SELECT 1 FROM site1 s WHERE s.site_id = p.site_id)
UNION ALL
SELECT 'no_climate', count(*) FROM dpanel p WHERE NOT EXISTS (SELECT 1 FROM win w WHERE w.site_id = p.site_id AND w.season_year = p.year)
UNION ALL
SELECT 'no_coordinates', count(*) FROM site1 WHERE lat IS NULL OR lon IS NULL"""

ORACLE["expect_unique"] = with_("daily") + """
SELECT site_id, date, param, count(*) AS n FROM daily GROUP BY site_id, date, param HAVING count(*) > 1"""

_geo_cols = ["site_id", "name", "year"] + DPANEL_COLS + ["region_id", "region", "lat", "lon"]
_str_cols = {"site_id", "name", "region"}
ORACLE["completeness"] = with_("pgeo") + "\nSELECT count(*) AS n_rows, " + ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL{' OR trim(' + c + ') = ' + chr(39) * 2 if c in _str_cols else ''} THEN 1 ELSE 0 END) AS BIGINT) AS missing_{c}"
    for c in _geo_cols) + " FROM pgeo"

cte("yearly", ("dpanel",), """
  SELECT year, """ + ", ".join(f"coalesce(sum({m}), 0.0) AS {m}" for m in MEASURES) + """
  FROM dpanel GROUP BY year""")
cte("weighted", ("yearly",), """
  SELECT *, CASE WHEN harvested_ha = 0 THEN NULL ELSE produced_kg / harvested_ha END AS yield_kg_ha,
         CASE WHEN planted_ha > 0 THEN lost_ha / planted_ha * 100 ELSE 0.0 END AS loss_pct
  FROM yearly""")

ORACLE["yearly_totals"] = with_("yearly") + f"\nSELECT year, {rnd(MEASURES, 4)} FROM yearly"
ORACLE["weighted_yield"] = with_("weighted") + f"\nSELECT year, {rnd(MEASURES + ['yield_kg_ha', 'loss_pct'], 4)} FROM weighted"


def _kpi(where: str = "") -> str:
    return with_("dpanel", extra=f"""
k AS (
  SELECT year, {", ".join(f"coalesce(sum({m}), 0.0) AS {m}" for m in MEASURES)}
  FROM dpanel {where} GROUP BY ROLLUP (year))""") + f"""
SELECT year, {rnd(MEASURES, 4)},
       round(CASE WHEN harvested_ha > 0 THEN produced_kg / harvested_ha END, 4) AS yield_kg_ha,
       round(CASE WHEN planted_ha > 0 THEN lost_ha / planted_ha * 100 END, 4) AS loss_pct,
       year IS NULL AS is_total
FROM k"""


ORACLE["kpi_summary"] = _kpi()
ORACLE["slice_year"] = _kpi("WHERE year = 1998") + " WHERE year IS NOT NULL"


def fmt_br_sql(x: str, d: int, prefix: str = "''", suffix: str = "''") -> str:
    digits = f"translate(format('{{:,.{d}f}}', {x}), ',.', '.,')"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN '-' ELSE trim({prefix} || {digits} || {suffix}) END)"


def fmt_scaled_sql(x: str, prefix: str = "''", suffix: str = "''") -> str:
    sign = f"(CASE WHEN {x} < 0 THEN '- ' ELSE '' END)"
    a = f"abs({x})"

    def sc(div, unit):
        return f"trim({sign} || {prefix} || translate(format('{{:,.2f}}', {a} / {div}), ',.', '.,') || '{unit}' || {suffix})"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN '-' WHEN {a} >= 1e9 THEN {sc('1e9', ' bi')} "
            f"WHEN {a} >= 1e6 THEN {sc('1e6', ' mi')} WHEN {a} >= 1e4 THEN {sc('1e3', ' mil')} "
            f"ELSE {fmt_br_sql(x, 0, f'({sign} || {prefix})', suffix)} END)")


ORACLE["kpi_delta"] = with_("weighted", extra="""
m AS (
  SELECT year, 'planted_ha' AS measure, planted_ha AS v, ' ha' AS unit, false AS always_pct, false AS pp FROM weighted
  UNION ALL SELECT year, 'lost_ha', lost_ha, ' ha', true, false FROM weighted
  UNION ALL SELECT year, 'produced_kg', produced_kg, ' kg', false, false FROM weighted
  UNION ALL SELECT year, 'yield_kg_ha', yield_kg_ha, ' kg/ha', false, false FROM weighted
  UNION ALL SELECT year, 'loss_pct', loss_pct, '', false, true FROM weighted),
g AS (
  SELECT measure, unit, always_pct, pp, min(year) AS first_year, max(year) AS last_year,
         arg_min(v, year) AS first_value, arg_max(v, year) AS last_value, count(DISTINCT year) AS n_years
  FROM m GROUP BY measure, unit, always_pct, pp HAVING count(DISTINCT year) > 1),
k AS (
  SELECT *, last_value - first_value AS diff,
         CASE WHEN first_value = 0 THEN NULL ELSE (last_value - first_value) / abs(first_value) * 100 END AS pct,
         CASE WHEN pp THEN 'pp' WHEN first_value IS NULL OR last_value IS NULL THEN 'none'
              WHEN first_value = 0 AND last_value = 0 THEN 'zero'
              WHEN first_value = 0 AND always_pct THEN 'inf'
              WHEN first_value = 0 THEN 'abs' ELSE 'pct' END AS kind
  FROM g)""") + """
SELECT measure, first_year, last_year, round(first_value, 4) AS first_value, round(last_value, 4) AS last_value,
       kind AS delta_kind,
       round(CASE WHEN kind IN ('pp', 'abs') THEN diff WHEN kind = 'pct' THEN pct END, 4) AS delta_value,
       CASE WHEN kind = 'pp' THEN (CASE WHEN first_value IS NULL THEN NULL ELSE """ + fmt_br_sql(
    "diff", 2, "(CASE WHEN diff > 0 THEN '+ ' ELSE '' END)", "' pp'") + """ END)
            WHEN kind = 'zero' THEN '= 0' WHEN kind = 'inf' THEN '∞ %'
            WHEN kind = 'abs' THEN """ + fmt_scaled_sql("diff", "(CASE WHEN diff > 0 THEN '+ ' ELSE '' END)", "unit") + """
            WHEN kind = 'pct' THEN """ + fmt_br_sql("pct", 2, "(CASE WHEN pct > 0 THEN '+ ' ELSE '' END)", "' %'") + """
       END AS delta_text
FROM k"""


def _period(where: str, label: str) -> str:
    return f"""
SELECT min(year) AS first_year, max(year) AS last_year, count(year) AS n_years,
       max(year) - min(year) + 1 = count(year) AS contiguous,
       CASE WHEN count(year) = 1 THEN CAST(min(year) AS VARCHAR)
            WHEN max(year) - min(year) + 1 = count(year) THEN CAST(min(year) AS VARCHAR) || '–' || CAST(max(year) AS VARCHAR)
            ELSE array_to_string(list_sort(list(CAST(year AS VARCHAR))), ', ') END AS period_label,
       '{label}' AS selection
FROM (SELECT DISTINCT year FROM dpanel {where})"""


ORACLE["period_label"] = with_("dpanel") + _period("", "all") + " UNION ALL " + _period(
    "WHERE year IN (1996, 1998, 1999)", "pick")

ORACLE["panel_profile"] = with_("pgeo", "win", extra="""
lp AS (SELECT p.*, w.param, w.rel_year, w.dekad36, w.value
       FROM pgeo p LEFT JOIN win w ON p.site_id = w.site_id AND p.year = w.season_year)""") + """
SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_sites, count(DISTINCT year) AS n_years,
       count(DISTINCT region) AS n_regions, count(DISTINCT param) AS n_params,
       CAST(sum(""" + " + ".join(
    f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
    for c in _geo_cols + ["param", "rel_year", "dekad36", "value"]) + """) AS BIGINT) AS n_nulls
FROM lp"""

ORACLE["sites_in_regions"] = with_("site") + """
SELECT DISTINCT region, site_id, name FROM site WHERE region IN ('AMERICA', 'EUROPE')"""

ORACLE["filter_panel"] = with_("dpanel", "site") + f"""
SELECT site_id, name, year, {rnd(DPANEL_COLS)} FROM dpanel
WHERE year IN (1997, 1998, 1999)
  AND site_id IN (SELECT site_id FROM site WHERE region IN ('AMERICA', 'EUROPE'))"""

ORACLE["format_br"] = with_("weighted") + f"""
SELECT year,
       {fmt_br_sql('planted_ha', 0, "''", "' ha'")} AS planted_text,
       {fmt_br_sql('yield_kg_ha', 2)} AS yield_text,
       {fmt_scaled_sql('produced_kg', "''", "' kg'")} AS produced_text,
       {fmt_scaled_sql('(-value_brl)', "'R$ '")} AS value_text,
       {fmt_scaled_sql('(lost_ha / 1000)', "''", "' ha'")} AS lost_text
FROM weighted"""


# --- analysis --------------------------------------------------------------------
def pearson_sql(x: str, y: str) -> str:
    return (f"(CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL "
            f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END)")


def _pairs_cte(name: str, season_cte: str, metric: str) -> None:
    cte(name, (season_cte, "dpanel"), f"""
  SELECT s.param, s.rel_year, s.dekad36, s.site_id, s.season_year AS year, s.value AS x,
         p.{metric} AS y, p.name AS pname, p.produced_kg AS size
  FROM {season_cte} s JOIN dpanel p ON s.site_id = p.site_id AND s.season_year = p.year""")


def _corr_cte(name: str, pairs: str) -> None:
    cte(name, (pairs,), f"""
  SELECT * FROM (
    SELECT param, rel_year, dekad36,
           param || '_dec' || CAST(dekad36 AS VARCHAR) || '_ano' || CAST(rel_year AS VARCHAR) AS feature,
           count(*) AS n_pairs, {pearson_sql('x', 'y')} AS r
    FROM {pairs} WHERE x IS NOT NULL AND y IS NOT NULL
    GROUP BY param, rel_year, dekad36)
  WHERE n_pairs > 5 AND r IS NOT NULL""")


_pairs_cte("pairs_w", "win", "yield_kg_ha")
_corr_cte("corr_w", "pairs_w")
_pairs_cte("pairs_all", "season", "produced_kg")
_corr_cte("corr_all", "pairs_all")

CORR_OUT = "param, rel_year, dekad36, feature, n_pairs, round(r, 6) AS r, round(abs(r), 6) AS abs_r"
ORACLE["climate_corr"] = with_("corr_w") + f"\nSELECT {CORR_OUT} FROM corr_w"
ORACLE["climate_corr_production"] = with_("corr_all") + f"\nSELECT {CORR_OUT} FROM corr_all"

cte("top_w", ("corr_w",), "SELECT * FROM corr_w ORDER BY abs(r) DESC, param, rel_year, dekad36 LIMIT 10")
ORACLE["top_corr"] = with_("top_w") + f"\nSELECT {CORR_OUT} FROM top_w"

# attribute dictionary: same fixed values as the registry
from .registry import ATTRIBUTES  # noqa: E402

cte("attrs", (), "SELECT * FROM (VALUES " + ", ".join(
    "('" + c + "', '" + d.replace("'", "''") + "')" for c, d in ATTRIBUTES) + ") t(code, description)")


ORACLE["corr_strength"] = with_("top_w", "attrs", extra="""
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(r) DESC, param, rel_year, dekad36) AS INTEGER) AS rank FROM top_w),
lab AS (SELECT r1.*, CASE WHEN a.description IS NOT NULL AND a.description <> ''
                          THEN r1.param || ' = ' || a.description ELSE r1.param END AS label
        FROM ranked r1 LEFT JOIN attrs a ON a.code = regexp_replace(trim(r1.param), '_dec.*$', ''))""") + """
SELECT rank, param, rel_year, dekad36, feature, round(r, 6) AS r, round(abs(r), 6) AS abs_r, label,
       CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
       'An increase of ' || label || ' is associated with '
         || CASE WHEN r > 0 THEN 'an increase' ELSE 'a decrease' END || ' of Yield.' AS sentence
FROM lab WHERE rank <= 3"""

_PC = ["planted_ha", "harvested_ha", "lost_ha", "produced_kg", "yield_kg_ha", "value_brl", "value_share", "loss_pct"]
_cm = []
for _i, _a in enumerate(_PC):
    for _j, _b in enumerate(_PC):
        _f = f"FILTER (WHERE {_a} IS NOT NULL AND {_b} IS NOT NULL)"
        _r = (f"CASE WHEN stddev_pop({_a}) {_f} * stddev_pop({_b}) {_f} = 0 THEN NULL "
              f"ELSE covar_pop({_a}, {_b}) {_f} / (stddev_pop({_a}) {_f} * stddev_pop({_b}) {_f}) END")
        _cm.append(f"SELECT '{_a}' AS row, '{_b}' AS col, round({_r}, 6) AS r FROM dpanel")
ORACLE["corr_matrix"] = with_("dpanel") + "\n" + "\nUNION ALL ".join(_cm)

cte("pts_w", ("pairs_w",), """
  SELECT * FROM pairs_w WHERE x IS NOT NULL AND y IS NOT NULL AND year IS NOT NULL AND pname IS NOT NULL AND size IS NOT NULL""")

ORACLE["scatter"] = with_("pts_w") + """
SELECT param, rel_year, dekad36, site_id, pname AS name, year, round(x, 6) AS x, round(y, 6) AS y, round(size, 6) AS size
FROM pts_w"""

ORACLE["trend"] = with_("pts_w", extra="""
t AS (
  SELECT param, rel_year, dekad36, count(*) AS n,
         CASE WHEN var_pop(x) = 0 THEN NULL ELSE covar_pop(y, x) / var_pop(x) END AS slope,
         avg(x) AS mx, avg(y) AS my, min(x) AS x_min, max(x) AS x_max
  FROM pts_w GROUP BY param, rel_year, dekad36 HAVING count(*) > 1),
t2 AS (SELECT *, my - slope * mx AS intercept FROM t)""") + """
SELECT param, rel_year, dekad36, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(x_min, 6) AS x_min, round(x_max, 6) AS x_max,
       round(slope * x_min + intercept, 6) AS y_at_min, round(slope * x_max + intercept, 6) AS y_at_max
FROM t2"""

cte("hparams", ("top_w",), "SELECT DISTINCT param FROM top_w ORDER BY param LIMIT 5")
cte("win_h", ("win", "hparams"), "SELECT * FROM win WHERE param IN (SELECT param FROM hparams)")
_pairs_cte("pairs_h", "win_h", "yield_kg_ha")
_corr_cte("corr_h", "pairs_h")
cte("heat", ("corr_h",), """
  SELECT param, rel_year, dekad36, 'Ano' || CAST(rel_year AS VARCHAR) || '_Dec' || CAST(dekad36 AS VARCHAR) AS period,
         CASE WHEN rel_year = 1 THEN dekad36 - 26 ELSE 11 + dekad36 - 1 END AS period_order, r
  FROM corr_h""")

ORACLE["heatmap"] = with_("heat") + "\nSELECT param, rel_year, dekad36, period, period_order, round(r, 6) AS r FROM heat"

_periods = [f"Ano1_Dec{d}" for d in range(26, 37)] + [f"Ano2_Dec{d}" for d in range(1, 16)]
ORACLE["heatmap_wide"] = with_("heat") + "\nSELECT param, " + ", ".join(
    f"round(max(CASE WHEN period = '{c}' THEN r END), 6) AS {c}" for c in _periods) + " FROM heat GROUP BY param"

ORACLE["phase_mean"] = with_("heat") + """
SELECT rel_year, round(avg(pm), 6) AS phase_mean, count(*) AS n_periods
FROM (SELECT rel_year, period, avg(r) AS pm FROM heat GROUP BY rel_year, period) GROUP BY rel_year"""

_RM = ["produced_kg", "yield_kg_ha", "planted_ha", "value_brl"]
ORACLE["site_means"] = with_("dpanel") + "\nSELECT site_id, name, " + ", ".join(
    f"round(avg({m}), 4) AS {m}" for m in _RM) + " FROM dpanel GROUP BY site_id, name"

cte("ranked_sites", ("dpanel",), """
  SELECT * FROM (
    SELECT name, metric, mean_value,
           CAST(row_number() OVER (PARTITION BY metric ORDER BY mean_value DESC, name ASC) AS INTEGER) AS rank
    FROM (""" + " UNION ALL ".join(
    f"SELECT name, '{m}' AS metric, avg({m}) AS mean_value FROM dpanel GROUP BY name" for m in _RM) + """)
    WHERE mean_value IS NOT NULL)
  WHERE rank <= 5""")

ORACLE["rank_sites"] = with_("ranked_sites") + "\nSELECT name, metric, round(mean_value, 4) AS mean_value, rank FROM ranked_sites"

ORACLE["trajectories"] = with_("ranked_sites") + "\n" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, name, year, round({m}, 4) AS value FROM dpanel "
    f"WHERE name IN (SELECT name FROM ranked_sites WHERE metric = '{m}')" for m in _RM)

ORACLE["labels_lookup"] = with_("corr_w", "attrs") + """
SELECT c.feature, c.param, c.rel_year, c.dekad36,
       CASE WHEN a.description IS NOT NULL AND a.description <> ''
            THEN regexp_replace(trim(c.feature), '_dec.*$', '') || ' = ' || a.description
            ELSE regexp_replace(trim(c.feature), '_dec.*$', '') END AS label,
       coalesce(a.description, regexp_replace(trim(c.feature), '_dec.*$', '')) AS description
FROM corr_w c LEFT JOIN attrs a ON a.code = regexp_replace(trim(c.feature), '_dec.*$', '')"""

ORACLE["legend"] = with_("heat", "attrs") + """
SELECT array_to_string(list_sort(list(DISTINCT entry)), '; ') AS legend, count(*) AS n_entries
FROM (SELECT h.code || ' = ' || coalesce(a.description, h.code) AS entry
      FROM (SELECT DISTINCT regexp_replace(trim(param), '_dec.*$', '') AS code FROM heat) h
      LEFT JOIN attrs a ON a.code = h.code)"""


# --- mining ---------------------------------------------------------------------
cte("pgeo_sy", ("pgeo",), "SELECT DISTINCT site_id, year AS season_year FROM pgeo")
cte("fidx", ("win",), """
  SELECT param, rel_year, dekad36, CAST(row_number() OVER (ORDER BY param, rel_year, dekad36) - 1 AS INTEGER) AS idx
  FROM (SELECT DISTINCT param, rel_year, dekad36 FROM win)""")
cte("fmeans", ("win", "pgeo_sy"), """
  SELECT * FROM (
    SELECT w.site_id, w.param, w.rel_year, w.dekad36, avg(w.value) AS value
    FROM win w WHERE (w.site_id, w.season_year) IN (SELECT site_id, season_year FROM pgeo_sy)
    GROUP BY w.site_id, w.param, w.rel_year, w.dekad36) WHERE value IS NOT NULL""")
cte("targets", ("pgeo",), "SELECT site_id, avg(yield_kg_ha) AS target, max(lat) AS lat, max(lon) AS lon FROM pgeo GROUP BY site_id")
cte("kept", ("targets", "fmeans", "fidx"), """
  SELECT * FROM (
    SELECT t.*, coalesce(c.n, 0) / CAST((SELECT count(*) FROM fidx) AS DOUBLE) AS coverage
    FROM targets t LEFT JOIN (SELECT site_id, count(*) AS n FROM fmeans GROUP BY site_id) c ON t.site_id = c.site_id)
  WHERE coverage >= 0.7""")
cte("imputed", ("kept", "fmeans", "fidx"), """
  SELECT k.site_id, f.idx, f.param, f.rel_year, f.dekad36, coalesce(m.value, md.med) AS value, m.value IS NULL AS imputed
  FROM kept k CROSS JOIN fidx f
  LEFT JOIN fmeans m ON m.site_id = k.site_id AND m.param = f.param AND m.rel_year = f.rel_year AND m.dekad36 = f.dekad36
  LEFT JOIN (SELECT param, rel_year, dekad36, median(value) AS med FROM fmeans
             WHERE site_id IN (SELECT site_id FROM kept) GROUP BY ALL) md
         ON md.param = f.param AND md.rel_year = f.rel_year AND md.dekad36 = f.dekad36""")
cte("zed", ("imputed",), """
  SELECT i.*, CASE WHEN s.sd = 0 THEN 0.0 ELSE (i.value - s.mu) / s.sd END AS z
  FROM imputed i JOIN (SELECT idx, avg(value) AS mu, stddev_pop(value) AS sd FROM imputed GROUP BY idx) s ON s.idx = i.idx""")


def qclass_sql(col: str, edges: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL WHEN {col} <= {edges}[2] THEN 0 WHEN {col} <= {edges}[3] THEN 1 "
            f"WHEN {col} <= {edges}[4] THEN 2 ELSE 3 END")


cte("classes", ("kept",), f"""
  SELECT k.*, {qclass_sql('target', 'e.q')} AS y_true
  FROM kept k, (SELECT quantile_cont(target, [0, 0.25, 0.5, 0.75, 1]) AS q FROM kept) e""")
cte("classes2", ("classes", "dpanel"), f"""
  SELECT c.*, {qclass_sql('loss', 'e.q')} AS y_pred
  FROM (SELECT c.*, d.loss FROM classes c JOIN (SELECT site_id, avg(loss_pct) AS loss FROM dpanel GROUP BY site_id) d
        ON c.site_id = d.site_id) c,
       (SELECT quantile_cont(d.loss, [0, 0.25, 0.5, 0.75, 1]) AS q
        FROM classes c JOIN (SELECT site_id, avg(loss_pct) AS loss FROM dpanel GROUP BY site_id) d ON c.site_id = d.site_id) e""")

_perms = list(__import__("itertools").permutations(range(4)))
cte("perms", (), "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {p[0]}, {p[1]}, {p[2]}, {p[3]})" for i, p in enumerate(_perms)) + ") t(pid, m0, m1, m2, m3)")
cte("best_perm", ("classes2", "perms"), """
  SELECT * FROM perms p ORDER BY (
    SELECT count(*) FROM classes2 c
    WHERE c.y_true = CASE c.y_pred WHEN 0 THEN p.m0 WHEN 1 THEN p.m1 WHEN 2 THEN p.m2 ELSE p.m3 END) DESC, pid
  LIMIT 1""")
cte("aligned", ("classes2", "best_perm"), """
  SELECT c.*, CAST(CASE c.y_pred WHEN 0 THEN b.m0 WHEN 1 THEN b.m1 WHEN 2 THEN b.m2 WHEN 3 THEN b.m3 END AS INTEGER) AS y_aligned
  FROM classes2 c, best_perm b""")

ORACLE["coverage"] = with_("kept") + "\nSELECT site_id, round(coverage, 6) AS coverage FROM kept"
ORACLE["impute_median"] = with_("imputed") + """
SELECT site_id, idx, param, rel_year, dekad36, round(value, 6) AS value, imputed FROM imputed"""
ORACLE["standardise"] = with_("zed") + "\nSELECT site_id, idx, param, rel_year, dekad36, round(z, 6) AS z FROM zed"
ORACLE["quantile_classes"] = with_("classes") + "\nSELECT site_id, round(target, 6) AS target, y_true FROM classes"
ORACLE["class_distribution"] = with_("classes") + """
SELECT y_true, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM classes GROUP BY y_true"""
ORACLE["box_stats"] = with_("classes", extra="""
q AS (SELECT y_true, quantile_cont(target, [0.25, 0.5, 0.75]) AS qq, count(target) AS n, min(target) AS mn, max(target) AS mx
      FROM classes GROUP BY y_true),
q2 AS (SELECT y_true, n, mn, mx, qq[1] AS q1, qq[2] AS med, qq[3] AS q3, qq[3] - qq[1] AS iqr,
              qq[1] - 1.5 * (qq[3] - qq[1]) AS lo, qq[3] + 1.5 * (qq[3] - qq[1]) AS hi FROM q),
w AS (SELECT c.y_true, min(c.target) FILTER (WHERE c.target >= q2.lo AND c.target <= q2.hi) AS wl,
             max(c.target) FILTER (WHERE c.target >= q2.lo AND c.target <= q2.hi) AS wh,
             count(*) FILTER (WHERE NOT (c.target >= q2.lo AND c.target <= q2.hi) AND c.target IS NOT NULL) AS n_out
      FROM classes c JOIN q2 ON c.y_true = q2.y_true GROUP BY c.y_true)""") + """
SELECT q2.y_true, n, round(mn, 6) AS min, round(mx, 6) AS max, round(q1, 6) AS q1, round(med, 6) AS median,
       round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lo_fence, round(hi, 6) AS hi_fence,
       round(wl, 6) AS whisker_lo, round(wh, 6) AS whisker_hi, n_out AS n_outliers
FROM q2 JOIN w ON q2.y_true = w.y_true"""
ORACLE["align_labels"] = with_("aligned") + "\nSELECT site_id, y_true, y_pred, y_aligned FROM aligned"


def confusion_sql(src: str, t: str, p: str) -> str:
    return f""",
lab AS (SELECT {t} AS l FROM {src} WHERE {t} IS NOT NULL AND {p} IS NOT NULL UNION SELECT {p} FROM {src} WHERE {t} IS NOT NULL AND {p} IS NOT NULL),
cnt AS (SELECT a.l AS {t}, b.l AS {p}, (SELECT count(*) FROM {src} s WHERE s.{t} = a.l AND s.{p} = b.l) AS n FROM lab a, lab b)
SELECT {t}, {p}, n, round(CASE WHEN sum(n) OVER (PARTITION BY {t}) > 0 THEN n / sum(n) OVER (PARTITION BY {t}) END, 6) AS row_share FROM cnt"""


def per_class_sql(src: str, t: str, p: str) -> str:
    return f"""
pc AS (
  SELECT c, sum(is_true) AS support, sum(tp) AS tp, sum(is_pred) AS n_pred
  FROM (SELECT {t} AS c, 1 AS is_true, CAST({t} = {p} AS INTEGER) AS tp, 0 AS is_pred FROM {src}
        UNION ALL SELECT {p} AS c, 0, 0, 1 FROM {src}) GROUP BY c),
pc2 AS (SELECT *, sum(support) OVER () AS n FROM pc),
cm AS (
  SELECT c AS cls, support, n_pred, tp,
         CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN (n - tp - (support - tp) - (n_pred - tp)) + (n_pred - tp) > 0
              THEN (n - tp - (support - tp) - (n_pred - tp)) / ((n - tp - (support - tp) - (n_pred - tp)) + (n_pred - tp))
              ELSE 0.0 END AS specificity
  FROM pc2),
cm2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM cm)"""


CM_OUT = ("cls, CAST(support AS BIGINT) AS support, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp, "
          "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
          "round(specificity, 6) AS specificity")
SUMMARY = """
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
       round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro, round(avg(specificity), 6) AS specificity_macro,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM cm2"""

ORACLE["confusion"] = with_("aligned") + confusion_sql("aligned", "y_true", "y_aligned")
ORACLE["class_metrics"] = with_("aligned", extra=per_class_sql("aligned", "y_true", "y_aligned")) + f"\nSELECT {CM_OUT} FROM cm2"
ORACLE["metric_summary"] = with_("aligned", extra=per_class_sql("aligned", "y_true", "y_aligned")) + SUMMARY

cte("doclab", (), "SELECT doc_id, quality AS y_true, toxic AS y_pred FROM labels")
ORACLE["confusion_labels"] = with_("doclab") + confusion_sql("doclab", "y_true", "y_pred")
ORACLE["class_metrics_labels"] = with_("doclab", extra=per_class_sql("doclab", "y_true", "y_pred")) + f"\nSELECT {CM_OUT} FROM cm2"
ORACLE["metric_report"] = with_("doclab", extra=per_class_sql("doclab", "y_true", "y_pred") + """,
summ AS (""" + SUMMARY.replace("round(", "(").replace(", 6)", ")") + ")") + """
SELECT scope, metric, round(value, 6) AS value, round(round(value * 100, 6), 2) AS percent FROM (
  SELECT CAST(cls AS VARCHAR) AS scope, 'precision' AS metric, precision AS value FROM cm2
  UNION ALL SELECT CAST(cls AS VARCHAR), 'recall', recall FROM cm2
  UNION ALL SELECT CAST(cls AS VARCHAR), 'f1', f1 FROM cm2
  UNION ALL SELECT CAST(cls AS VARCHAR), 'specificity', specificity FROM cm2
  UNION ALL SELECT 'all', 'accuracy', accuracy FROM summ
  UNION ALL SELECT 'all', 'precision_macro', precision_macro FROM summ
  UNION ALL SELECT 'all', 'recall_macro', recall_macro FROM summ
  UNION ALL SELECT 'all', 'f1_macro', f1_macro FROM summ
  UNION ALL SELECT 'all', 'specificity_macro', specificity_macro FROM summ
  UNION ALL SELECT 'all', 'precision_weighted', precision_weighted FROM summ
  UNION ALL SELECT 'all', 'recall_weighted', recall_weighted FROM summ
  UNION ALL SELECT 'all', 'f1_weighted', f1_weighted FROM summ)"""

cte("emb_long", (), """
  SELECT vec_id, label, CAST(pos - 1 AS INTEGER) AS pos, CAST(v AS DOUBLE) AS v
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)""")
cte("emb_cent", ("emb_long",), "SELECT label AS cls, pos, avg(v) AS c FROM emb_long GROUP BY label, pos")
cte("emb_dist", ("emb_long", "emb_cent"), """
  SELECT e.vec_id, c.cls, sqrt(sum((e.v - c.c) * (e.v - c.c))) AS dist
  FROM emb_long e JOIN emb_cent c ON e.pos = c.pos GROUP BY e.vec_id, c.cls""")
cte("emb_scores", ("emb_dist",), """
  SELECT d.vec_id, d.cls, d.dist, (1.0 / (d.dist + 1e-9)) / sum(1.0 / (d.dist + 1e-9)) OVER (PARTITION BY d.vec_id) AS score,
         e.label AS y_true
  FROM emb_dist d JOIN embeddings e ON d.vec_id = e.vec_id""")
cte("emb_sc", ("emb_scores",), """
  SELECT cls, score, sum(CASE WHEN y_true = cls THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y_true = cls THEN 0 ELSE 1 END) AS neg
  FROM emb_scores GROUP BY cls, score""")
cte("emb_pre", ("emb_sc",), """
  SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_lt, coalesce(sum(neg) OVER w, 0) AS neg_lt,
         sum(pos) OVER (PARTITION BY cls) AS P, sum(neg) OVER (PARTITION BY cls) AS N
  FROM emb_sc WINDOW w AS (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
cte("emb_roc", ("emb_pre",), """
  SELECT cls, score AS threshold, CASE WHEN P > 0 THEN (P - pos_lt) / P END AS tpr,
         CASE WHEN N > 0 THEN (N - neg_lt) / N END AS fpr FROM emb_pre
  UNION ALL SELECT DISTINCT cls, 'inf'::DOUBLE, CASE WHEN P > 0 THEN 0.0 END, CASE WHEN N > 0 THEN 0.0 END FROM emb_pre""")

ORACLE["inverse_distance_scores"] = with_("emb_scores") + """
SELECT vec_id, y_true, cls, round(dist, 6) AS dist, round(score, 6) AS score FROM emb_scores"""
ORACLE["auc_ovr"] = with_("emb_pre", extra="""
a AS (SELECT cls, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (neg_lt + 0.5 * neg)) / (max(P) * max(N)) END AS auc,
             CAST(max(P) AS BIGINT) AS P, CAST(max(N) AS BIGINT) AS N FROM emb_pre GROUP BY cls)""") + """
SELECT cls, round(auc, 6) AS auc, P, N FROM a
UNION ALL SELECT NULL, round(avg(auc), 6), CAST(sum(P) AS BIGINT), CAST(sum(N) AS BIGINT) FROM a"""
ORACLE["roc_points"] = with_("emb_roc") + """
SELECT cls, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM emb_roc"""
ORACLE["youden"] = with_("emb_roc", extra="""
b AS (SELECT cls, arg_max(threshold, (tpr - fpr, threshold)) AS th, arg_max(tpr, (tpr - fpr, threshold)) AS tp,
             arg_max(fpr, (tpr - fpr, threshold)) AS fp, max(tpr - fpr) AS j FROM emb_roc GROUP BY cls)""") + """
SELECT cls, round(CASE WHEN j > 0 THEN th ELSE 'inf'::DOUBLE END, 6) AS threshold,
       round(CASE WHEN j > 0 THEN tp ELSE 0.0 END, 6) AS tpr, round(CASE WHEN j > 0 THEN fp ELSE 0.0 END, 6) AS fpr,
       round(greatest(j, 0.0), 6) AS youden_j
FROM b"""


# --- geo ----------------------------------------------------------------------------------
ORACLE["centroid"] = with_("site") + """
SELECT 'P' || site_id AS code, 'Point' AS type, round(lat, 6) AS lat, round(lon, 6) AS lon FROM site
UNION ALL
SELECT 'S' || site_id, 'Polygon',
       round(((((lat - 0.1) + (lat - 0.1)) + (lat + 0.1)) + (lat + 0.1) + (lat - 0.1)) / 5, 6),
       round(((((lon - 0.1) + (lon + 0.1)) + (lon + 0.1)) + (lon - 0.1) + (lon - 0.1)) / 5, 6)
FROM site
UNION ALL
SELECT 'R' || region, 'MultiPolygon',
       round(list_reduce(list(v ORDER BY site_id, k) FILTER (WHERE axis = 'lat'), lambda a, b: a + b) / (5 * count(DISTINCT site_id)), 6),
       round(list_reduce(list(v ORDER BY site_id, k) FILTER (WHERE axis = 'lon'), lambda a, b: a + b) / (5 * count(DISTINCT site_id)), 6)
FROM (
  SELECT region, site_id, k, 'lat' AS axis, CASE WHEN k IN (0, 1, 4) THEN lat - 0.1 ELSE lat + 0.1 END AS v
  FROM site, range(5) t(k)
  UNION ALL
  SELECT region, site_id, k, 'lon', CASE WHEN k IN (0, 3, 4) THEN lon - 0.1 ELSE lon + 0.1 END
  FROM site, range(5) t(k))
GROUP BY region"""

cte("bpts", ("site",), "SELECT * FROM site WHERE region IN ('AMERICA', 'ASIA')")
cte("bverts", ("bpts",), """
  SELECT x, y, CAST(row_number() OVER (ORDER BY a, x, y) - 1 AS BIGINT) AS seq FROM (
    SELECT lon AS x, lat AS y,
           atan2(lat - (SELECT avg(lat) FROM bpts), lon - (SELECT avg(lon) FROM bpts)) AS a FROM bpts)""")
cte("bring", ("bverts",), """
  SELECT seq, x, y FROM bverts UNION ALL SELECT (SELECT count(*) FROM bverts), x, y FROM bverts WHERE seq = 0""")
cte("bedges", ("bring",), """
  SELECT * FROM (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY seq) AS x2, lead(y) OVER (ORDER BY seq) AS y2 FROM bring)
  WHERE x2 IS NOT NULL""")


def pip_sql(points: str, px: str, py: str) -> str:
    """Per distinct point: crossing parity and on-segment flag against bedges."""
    return f"""
SELECT {px} AS _px, {py} AS _py,
       sum(CASE WHEN (e.y1 > {py}) <> (e.y2 > {py}) AND {px} < e.x1 + ({py} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
                THEN 1 ELSE 0 END) % 2 = 1 AS inside,
       max(CASE WHEN (e.x2 - e.x1) * ({py} - e.y1) - (e.y2 - e.y1) * ({px} - e.x1) = 0
                 AND {px} >= least(e.x1, e.x2) AND {px} <= greatest(e.x1, e.x2)
                 AND {py} >= least(e.y1, e.y2) AND {py} <= greatest(e.y1, e.y2) THEN 1 ELSE 0 END) = 1 AS on_border
FROM (SELECT DISTINCT {px}, {py} FROM {points}) p CROSS JOIN bedges e
GROUP BY {px}, {py}"""


ORACLE["clip_points"] = with_("site", "bedges", extra=f"pip AS ({pip_sql('site', 'lon', 'lat')})") + """
SELECT s.site_id, s.name, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon
FROM site s JOIN pip ON s.lon = pip._px AND s.lat = pip._py WHERE pip.inside OR pip.on_border"""

cte("gbox", ("bedges",), """
  SELECT min(least(x1, x2)) AS minx, min(least(y1, y2)) AS miny, max(greatest(x1, x2)) AS maxx, max(greatest(y1, y2)) AS maxy,
         CAST(ceil((max(greatest(x1, x2)) - min(least(x1, x2))) / 0.02) AS BIGINT) AS nx,
         CAST(ceil((max(greatest(y1, y2)) - min(least(y1, y2))) / 0.02) AS BIGINT) AS ny
  FROM bedges""")
cte("gcells", ("gbox",), """
  SELECT i, j, minx + CAST(i AS DOUBLE) * 0.02 AS x, miny + CAST(j AS DOUBLE) * 0.02 AS y
  FROM gbox, range(0, (SELECT nx FROM gbox)) a(i), range(0, (SELECT ny FROM gbox)) b(j)""")
cte("gpip", ("gcells", "bedges"), pip_sql("gcells", "x", "y"))
cte("gmask", ("gcells", "gpip"), """
  SELECT c.i, c.j, c.x, c.y, coalesce(p.inside AND NOT p.on_border, false) AS inside
  FROM gcells c LEFT JOIN gpip p ON c.x = p._px AND c.y = p._py""")

ORACLE["grid"] = with_("gmask") + "\nSELECT i, j, round(x, 6) AS x, round(y, 6) AS y, inside FROM gmask"

cte("st_clip", ("site", "bedges"), f"""
  SELECT s.* FROM site s JOIN ({pip_sql('site', 'lon', 'lat')}) p ON s.lon = p._px AND s.lat = p._py
  WHERE p.inside OR p.on_border""")
cte("st_cls", ("st_clip", "dpanel"), f"""
  SELECT c.lon AS sx, c.lat AS sy, CAST({qclass_sql('c.target', 'e.q')} + 1 AS DOUBLE) AS sz
  FROM (SELECT s.*, t.target FROM st_clip s JOIN (SELECT site_id, avg(yield_kg_ha) AS target FROM dpanel GROUP BY site_id) t
        ON s.site_id = t.site_id) c,
       (SELECT quantile_cont(t.target, [0, 0.25, 0.5, 0.75, 1]) AS q FROM st_clip s
        JOIN (SELECT site_id, avg(yield_kg_ha) AS target FROM dpanel GROUP BY site_id) t ON s.site_id = t.site_id) e""")

ORACLE["clip_geojson"] = with_("site") + """,
ext AS (SELECT region_id AS code, min(lon) AS a, max(lon) AS b, min(lat) AS c, max(lat) AS d FROM site WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY region_id),
v AS (
  SELECT code, 0 AS ring, [[a - 0.1, c - 0.1], [b + 0.1, c - 0.1], [b + 0.1, d + 0.1], [a - 0.1, d + 0.1], [a - 0.1, c - 0.1]] AS p FROM ext
  UNION ALL SELECT code, 1, [[(a + b) / 2 - 0.5, (c + d) / 2], [(a + b) / 2, (c + d) / 2 + 0.5], [(a + b) / 2 + 0.5, (c + d) / 2], [(a + b) / 2, (c + d) / 2 - 0.5], [(a + b) / 2 - 0.5, (c + d) / 2]] FROM ext
  UNION ALL SELECT code, 2, [[b + 0.2, c], [b + 1.2, c + 0.3], [b + 0.4, d], [b + 0.2, c]] FROM ext),
i AS (SELECT code, p, unnest(range(1, len(p))) AS k FROM v),
e AS (SELECT code, p[k][1] AS x1, p[k][2] AS y1, p[k + 1][1] AS x2, p[k + 1][2] AS y2 FROM i),
pts AS (SELECT c_custkey, -47.9::DOUBLE - (c_custkey * 31 % 997)::DOUBLE * 0.0083::DOUBLE AS x, -22.3::DOUBLE - (c_custkey * 17 % 613)::DOUBLE * 0.0079::DOUBLE AS y FROM customer)
SELECT c_custkey, code AS boundary FROM pts CROSS JOIN e GROUP BY ALL
HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1
  OR bool_or((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2))"""
ORACLE["idw_surface"] = with_("gmask", "st_cls") + """
SELECT i, j, round(CASE WHEN bool_or(d2 = 0) THEN max(CASE WHEN d2 = 0 THEN sz END)
                        ELSE sum(sz / pow(sqrt(d2), 2.0)) / sum(1.0 / pow(sqrt(d2), 2.0)) END, 6) AS z
FROM (SELECT g.i, g.j, s.sz, (g.x - s.sx) * (g.x - s.sx) + (g.y - s.sy) * (g.y - s.sy) AS d2
      FROM gmask g CROSS JOIN st_cls s WHERE g.inside)
GROUP BY i, j"""


# --- sources / sinks / streaming (round trips) --------------------------------------------
ORACLE["io_daily_csv"] = ORACLE["daily_clean"]
ORACLE["io_dekads_parquet"] = ORACLE["dekad_aggregate"]
ORACLE["io_panel_parquet"] = ORACLE["join_geo"]
ORACLE["io_sites_json"] = with_("site") + "\nSELECT site_id, name, region_id, region FROM site"
ORACLE["io_sites_csv"] = with_("site") + """
SELECT site_id, name, region_id, region, round(lat, 6) AS lat, round(lon, 6) AS lon FROM site"""
ORACLE["io_boundaries"] = with_("site") + """
SELECT site_id, name,
       round(((((lat - 0.1) + (lat - 0.1)) + (lat + 0.1)) + (lat + 0.1) + (lat - 0.1)) / 5, 6) AS lat,
       round(((((lon - 0.1) + (lon + 0.1)) + (lon + 0.1)) + (lon - 0.1) + (lon - 0.1)) / 5, 6) AS lon
FROM site"""
ORACLE["io_payloads"] = with_("daily_raw") + f"""
SELECT site_id, date, param, round(CASE WHEN v = -999 OR isnan(v) THEN NULL ELSE v END, 6) AS value
FROM (SELECT site_id, date, param, max(value) AS v FROM daily_raw GROUP BY site_id, date, param)"""
ORACLE["io_payload_quarantine"] = with_("daily_raw") + f"""
SELECT DISTINCT site_id, 'missing header marker' AS reason FROM daily_raw WHERE site_id = {code_sql(str(DROPPED_NATION))}"""
ORACLE["io_production"] = with_("production") + """
SELECT site_id AS code, name, year, variable, round(value, 6) AS value FROM (
  SELECT site_id, name, year, 'Área plantada (Hectares)' AS variable, planted_ha AS value FROM production
  UNION ALL
  SELECT site_id, name, year, 'Quantidade produzida (Toneladas)', produced_t FROM production)"""
ORACLE["io_params"] = with_("daily_raw") + "\nSELECT DISTINCT param FROM daily_raw"
ORACLE["io_wide_csv"] = with_("win") + """
SELECT site_id, name, CAST(season_year AS VARCHAR) AS season_year, """ + ", ".join(
    f"printf('%.4f', round(max(CASE WHEN param = '{p}' AND rel_year = {r} AND dekad36 = {d} THEN value END), 8)) AS \"{p}_dec{d}_ano{r}\""
    for p, r, d in _season_names(True)) + """
FROM win GROUP BY site_id, name, season_year"""
ORACLE["incremental_ingest"] = """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
       CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS dekad, event_type,
       count(*) AS n, round(round(sum(CASE WHEN value = -999 OR isnan(value) THEN NULL ELSE value END), 4), 4) AS sum_value
FROM events GROUP BY ALL"""


# --- remaining scalar / reshape ---------------------------------------------------------------
ORACLE["parse_feature_name"] = with_("season") + """
SELECT feature, regexp_extract(feature, '^(.*)_dec', 1) AS param,
       CAST(regexp_extract(feature, 'dec([0-9]+)', 1) AS INTEGER) AS dekad,
       CAST(regexp_extract(feature, 'ano([0-9]+)', 1) AS INTEGER) AS rel_year,
       regexp_replace(trim(feature), '_dec.*$', '') AS base
FROM (SELECT DISTINCT param || '_dec' || CAST(dekad36 AS VARCHAR) || '_ano' || CAST(rel_year AS VARCHAR) AS feature FROM season)"""

ORACLE["ascii_names"] = """
SELECT doc_id, regexp_replace(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\-]', '_', 'g') AS safe
FROM documents"""

cte("dwide", ("daily_raw",), "SELECT site_id, date, " + ", ".join(
    f"max(value) FILTER (WHERE param = '{p}') AS {p}" for p in PARAMS) + " FROM daily_raw GROUP BY site_id, date")
ORACLE["melt_params"] = with_("dwide") + "\n" + " UNION ALL ".join(
    f"SELECT site_id, date, '{p}' AS param, round({p}, 6) AS value FROM dwide" for p in PARAMS)
ORACLE["pivot_params"] = with_("dekads") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, """ + ", ".join(
    f"round(max(value) FILTER (WHERE param = '{p}'), 6) AS {p}" for p in PARAMS) + """
FROM dekads GROUP BY site_id, name, lat, lon, year, month, dekad"""
ORACLE["pivot_dekads"] = with_("collapsed") + "\nSELECT site_id, name, year, " + ", ".join(
    f"round(max(value) FILTER (WHERE param = '{p}' AND dekad36 = {d}), 6) AS {p}_dec{d}"
    for p in PARAMS for d in range(1, 37)) + " FROM collapsed GROUP BY site_id, name, year"


def _n_rules_sql(p="param"):
    lp = f"lower({p})"
    fams = [f"(({lp} LIKE '%prec%' AND {lp} NOT LIKE '%prob%') OR {lp} LIKE '%count%')",
            f"({lp} LIKE '%prec%' AND {lp} LIKE '%prob%')", f"({lp} LIKE '%max%')",
            f"({lp} LIKE '%min%')", f"({lp} LIKE '%range%')"]
    return " + ".join(f"CAST({f} AS INTEGER)" for f in fams)


ORACLE["param_rules"] = with_("daily_raw") + f"""
SELECT param, {rule_sql()} AS rule, {_n_rules_sql()} AS n_rules FROM (SELECT DISTINCT param FROM daily_raw)"""
ORACLE["dekad_aggregate_long"] = ORACLE["dekad_aggregate"]
ORACLE["incremental_dekads"] = ORACLE["dekad_aggregate"]
ORACLE["roc_points_thin"] = with_("emb_pre") + """,
n AS (SELECT *, lag(pos) OVER w AS pos_next, lag(neg) OVER w AS neg_next FROM emb_pre WINDOW w AS (PARTITION BY cls ORDER BY score))
SELECT cls, round(score, 6) AS threshold, round(CASE WHEN P > 0 THEN (P - pos_lt) / P END, 6) AS tpr, round(CASE WHEN N > 0 THEN (N - neg_lt) / N END, 6) AS fpr
FROM n WHERE pos_next IS NULL OR pos * neg_next <> neg * pos_next
UNION ALL SELECT DISTINCT cls, 'inf'::DOUBLE, CASE WHEN P > 0 THEN 0.0 END, CASE WHEN N > 0 THEN 0.0 END FROM emb_pre"""
ORACLE["io_bad_rows"] = """
WITH k AS (SELECT l_orderkey % 40 AS kind, lpad(l_linenumber::VARCHAR, 7, '0') AS site_id, 'Site, ' || l_linenumber AS name, l_quantity::DOUBLE AS v FROM lineitem)
SELECT site_id, name, NULL::VARCHAR AS reason, count(*) AS n, round(sum(CASE WHEN kind <> 11 THEN v END), 4) AS total, sum((kind = 11)::INTEGER)::BIGINT AS n_null
FROM k WHERE kind NOT IN (1, 3, 5, 7, 9) GROUP BY ALL
UNION ALL SELECT NULL, NULL, CASE kind WHEN 1 THEN 'fields 4 instead of 7' WHEN 3 THEN 'fields 8 instead of 7' WHEN 5 THEN 'missing site_id' WHEN 7 THEN 'type of date' ELSE 'type of value' END, count(*), NULL, NULL
FROM k WHERE kind IN (1, 3, 5, 7, 9) GROUP BY ALL"""
ORACLE["io_rewrite_year"] = with_("dekads") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, param, round(CASE WHEN year = 1998 THEN value * 2 + 1 ELSE value END, 6) AS value FROM dekads"""
ORACLE["io_ordered_csv"] = with_("production") + """
SELECT 0 AS line_no, 'site_id,name,year,planted_ha,harvested_ha' AS line
UNION ALL SELECT row_number() OVER (ORDER BY site_id, year), concat_ws(',', site_id, name, year, planted_ha, harvested_ha) FROM production"""
ORACLE["sql_dekads"] = ORACLE["dekad_aggregate"]
ORACLE["sql_report"] = with_("site", "production") + """,
t AS (SELECT coalesce(s.region, '?') AS region, p.year, sum(p.planted_ha) AS pl, sum(p.harvested_ha) AS ha, sum(p.produced_t) * 1000 / nullif(sum(p.harvested_ha), 0) AS y
  FROM production p LEFT JOIN site s ON p.site_id = s.site_id GROUP BY ALL)
SELECT region, year, round(pl, 4) AS planted_ha, round(CASE WHEN pl > 0 THEN (pl - ha) / pl * 100 ELSE 0 END, 4) AS loss_pct,
  translate(format('{:,.1f}', round(pl, 4)), ',.', '.,') AS planted_text, coalesce(translate(format('{:,.2f}', y), ',.', '.,'), '-') AS yield_text FROM t"""
ORACLE["sql_screen"] = with_("daily", "production") + """,
yearly AS (SELECT site_id, param, year(date) AS year, avg(value) AS x FROM daily GROUP BY ALL),
m AS (SELECT y.param, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(yield_kg_ha) > 0 AND y.param <> 'ITEM_COUNT' THEN corr(x, yield_kg_ha) END AS r
  FROM yearly y JOIN production p ON p.site_id = y.site_id AND p.year = y.year WHERE x IS NOT NULL AND yield_kg_ha IS NOT NULL GROUP BY y.param HAVING count(*) > 5)
SELECT param, n, round(r, 5) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END AS strength FROM m"""
ORACLE["pca_kmeans_invariants"] = with_("classes", "win") + """,
f AS (SELECT count(*) AS n FROM (SELECT DISTINCT param, rel_year, dekad36 FROM win))
SELECT 'components' AS "check", least((SELECT count(*) FROM classes), (SELECT n FROM f))::DOUBLE AS value
UNION ALL SELECT 'sites projected', count(*) FROM classes UNION ALL SELECT 'sites in clusters', count(*) FROM classes
UNION ALL SELECT c, 1 FROM (VALUES ('shares fall'), ('shares sum to one'), ('cumulative ends at one'), ('kept reach the target'), ('one fewer would not'), ('clusters within k'), ('cost not above one restart')) t(c)"""
ORACLE["dekad_rules"] = with_("dagg") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, param, round(value, 6) AS value
FROM (SELECT *, CASE WHEN param IN ('PRICE_MAX', 'PRICE_MIN') THEN mx - mn WHEN param IN ('TAX', 'DISC_RANGE') THEN mx ELSE a END AS value FROM dagg)
WHERE value IS NOT NULL"""
ORACLE["rule_conflicts"] = with_("daily_raw") + """
SELECT param, coalesce(split_part(candidates, '/', 1), 'mean') AS rule, CASE WHEN candidates = '' THEN 0 ELSE len(string_split(candidates, '/')) END::INTEGER AS n_rules, candidates
FROM (SELECT param, concat_ws('/', CASE WHEN param LIKE '%MIN' THEN 'min' END,
        CASE WHEN param LIKE 'PRICE%' OR param LIKE '%MAX' THEN 'range' END,
        CASE WHEN param LIKE 'TAX%' OR param LIKE 'DISC%' THEN 'max' END,
        CASE WHEN param LIKE '%COUNT' OR param LIKE '%QTY' THEN 'mean' END,
        CASE WHEN param LIKE '%PROB%' THEN 'min' END) AS candidates
      FROM (SELECT DISTINCT param FROM daily_raw))"""
ORACLE["canonical_panel"] = with_("dpanel") + """
SELECT site_id, name, year, round(planted_ha, 6) AS area_planted_ha, round(harvested_ha, 6) AS harvested_ha,
       round(yield_kg_ha, 6) AS yield_kg_ha, round(value_share, 6) AS value_share, round(lost_ha, 6) AS lost_ha,
       round(loss_pct, 6) AS loss_pct, round(produced_kg, 6) AS produced_kg, round(value_brl, 6) AS production_value,
       'Unknown region' AS region
FROM dpanel"""

ORACLE["union_batches"] = with_("dekads", "season") + """
SELECT site_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon, year, month, dekad, param, round(value, 6) AS value,
       season_year, rel_year, dekad36
FROM (SELECT * FROM dekads UNION ALL BY NAME SELECT * FROM season)"""

ORACLE["combine_variables_long"] = ORACLE["combine_variables"]
ORACLE["io_panel_csv"] = ORACLE["join_geo"]

ORACLE["io_attributes"] = with_("daily_raw") + """
SELECT param AS code, count(*) AS n_rows, any_value(CASE param WHEN 'PREC_QTY' THEN 'Shipped quantity, summed per dekad'
  WHEN 'PRICE_MAX' THEN 'Highest extended price' WHEN 'PRICE_MIN' THEN 'Lowest extended price' WHEN 'DISC_RANGE' THEN 'Range of discounts'
  WHEN 'TAX' THEN 'Mean tax rate' WHEN 'PREC_PROB' THEN 'Mean discount' END) AS description
FROM daily_raw GROUP BY param"""
ORACLE["mining_report"] = with_("classes") + """
SELECT 'sites' AS "check", count(*)::DOUBLE AS value FROM classes
UNION ALL SELECT 'confusion cells sum to sites', count(*) FROM classes
UNION ALL SELECT 'sites in boxes', count(*) FROM classes
UNION ALL SELECT 'sites whose scores sum to one', count(*) FROM classes
UNION ALL SELECT 'aucs within 0 and 1', 1 UNION ALL SELECT 'metrics within 0 and 1', 1 UNION ALL SELECT 'aligned not below unaligned', 1
UNION ALL SELECT 'true sites of class ' || c, (SELECT count(*) FROM classes WHERE y_true = c) FROM range(4) t(c)"""
