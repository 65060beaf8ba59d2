"""SQL surface: working tables as temporary views, scalar rules as SQL functions.

``install`` registers, for one session, views over the working tables and functions whose
bodies are SQL expressions, so a query in plain text is one plan: the optimizer sees
through views and functions alike, and nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.columns import CODE_WIDTH, MISSING_SENTINEL, MODERATE_R, NUMBER, STRONG_R
from .operators.climate import RULE_SQL, WINDOW_Y1, WINDOW_Y2

_GROUPED = "translate(format_number(abs(x), digits), ',.', '.,')"

#: name → (arguments, result, body)
FUNCTIONS = {
    "dekad": ("d DATE", "INT", "CASE WHEN dayofmonth(d) <= 10 THEN 1 WHEN dayofmonth(d) <= 20 THEN 2 WHEN d IS NOT NULL THEN 3 END"),
    "dekad36": ("d DATE", "INT", "(month(d) - 1) * 3 + CASE WHEN dayofmonth(d) <= 10 THEN 1 WHEN dayofmonth(d) <= 20 THEN 2 ELSE 3 END"),
    "doy_date": ("y INT, doy INT", "DATE", "date_add(make_date(y, 1, 1), doy - 1)"),
    "site_code": ("code STRING", "STRING", f"CASE WHEN length(trim(code)) < {CODE_WIDTH} THEN lpad(trim(code), {CODE_WIDTH}, '0') ELSE trim(code) END"),
    "observed": ("v DOUBLE", "DOUBLE", f"CASE WHEN NOT isnan(v) AND v <> {MISSING_SENTINEL}D THEN v END"),
    "clean_number": ("t STRING", "DOUBLE", f"CASE WHEN t RLIKE r'^\\s*-\\s*$' THEN 0.0D WHEN t RLIKE r'{NUMBER}' THEN coalesce(try_cast(trim(t) AS DOUBLE), 0.0D) ELSE 0.0D END"),
    "loss_pct": ("planted DOUBLE, harvested DOUBLE", "DOUBLE", "CASE WHEN planted > 0 THEN (planted - harvested) / planted * 100 ELSE 0.0D END"),
    "dekad_rule": ("param STRING", "STRING", RULE_SQL.format(p="param")),
    "in_season": ("rel_year INT, d36 INT", "BOOLEAN", f"(rel_year = 1 AND d36 BETWEEN {WINDOW_Y1[0]} AND {WINDOW_Y1[1]}) OR (rel_year = 2 AND d36 BETWEEN {WINDOW_Y2[0]} AND {WINDOW_Y2[1]})"),
    "pearson": ("n BIGINT, sx DOUBLE, sy DOUBLE, sxx DOUBLE, syy DOUBLE, sxy DOUBLE", "DOUBLE",
                "CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) END"),
    "strength": ("r DOUBLE", "STRING", f"CASE WHEN abs(r) > {STRONG_R} THEN 'strong' WHEN abs(r) > {MODERATE_R} THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END"),
    "br_number": ("x DOUBLE, digits INT", "STRING", f"CASE WHEN x IS NULL OR isnan(x) THEN '-' ELSE concat(CASE WHEN x < 0 THEN '-' ELSE '' END, {_GROUPED}) END"),
}


def install_functions(spark: SparkSession, prefix: str = "agro_") -> list[str]:
    """Register ``FUNCTIONS`` as temporary SQL functions; returns their names."""
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]


def install_views(tables: dict[str, DataFrame], prefix: str = "agro_") -> list[str]:
    """Register tables as temporary views; returns their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in tables]


def working_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The working tables over the bound sources."""
    from . import bindings as B
    return {"site": B.sites(spark, sf_dir), "daily": B.daily_raw(spark, sf_dir), "production": B.production(spark, sf_dir)}


def install(spark: SparkSession, sf_dir: str, prefix: str = "agro_") -> None:
    install_functions(spark, prefix)
    install_views(working_tables(spark, sf_dir), prefix)
