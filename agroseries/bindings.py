"""Bindings from the driver's star-schema tables to our working tables.

The reference's own inputs (municipality registry, daily climate payloads,
production crosstabs) are not available, so the driver tables stand in (the
same expressions are written in DuckDB SQL in ``plans/oracle.py``):

* ``SITE``      nation ⋈ region; nation 24 is left out on purpose so that the
                "no geography" diagnostics have something to count.
* ``DAILY_OBS`` lineitem ⋈ supplier ⋈ nation: site = supplier's nation,
                date = ship date, seven parameters unpivoted from line columns,
                line number 7 carries the −999 missing sentinel.
* ``PRODUCTION`` per (site, year) sums over lineitem (planted = quantity,
                harvested = quantity of non-returned lines, …).
* crosstab      one dirty text cell per line and ship year ("-", "..").

All joins are against dimension tables.  ``nation``/``region`` have a fixed
size (25 / 5 rows by the TPC-H spec) and are broadcast explicitly; supplier
grows with the data, so that join is left to AQE, which broadcasts at run time
only when the measured size is under the threshold and otherwise splits skewed
partitions of a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import sentinel_null

# --------------------------------------------------------------------------
# fixed values of the binding (shared with the DuckDB oracle)
# --------------------------------------------------------------------------
DROPPED_NATION = 24
SENTINEL_LINE = 7
# parameter name → lineitem expression; names chosen so each aggregation rule
# is exercised once (sum, max, min, range, mean, prec+prob mean, count sum)
DAILY_PARAMS = [
    ("PREC_QTY", "l_quantity"),
    ("PRICE_MAX", "l_extendedprice"),
    ("PRICE_MIN", "l_extendedprice"),
    ("DISC_RANGE", "l_discount"),
    ("TAX", "l_tax"),
    ("PREC_PROB", "l_discount"),
    ("ITEM_COUNT", "1.0"),
]
# crosstab variables: name → (value column, line numbers turned into "-" / "..")
CROSSTAB_VARIABLES = [
    ("quantity_units", "l_quantity", 1, 2),
    ("tax_rate", "l_tax", 3, 4),
]


# driver table schemas (TESTDATA): an explicit schema skips the footer-reading
# job Spark otherwise runs to infer it on every read
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = TABLE_SCHEMAS.get(name)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


SITE_LAT_SQL = "round(-22.5D - CAST({k} AS DOUBLE) * 0.17D, 2)"
SITE_LON_SQL = "-48.0D - CAST((({k} * 7) % 25) AS DOUBLE) * 0.25D"


def _nation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    t = "trim(CAST(n_nationkey AS STRING))"
    return n.selectExpr(
        f"CASE WHEN length({t}) < 7 THEN lpad({t}, 7, '0') ELSE {t} END AS site_id",
        "n_name AS name", "n_nationkey", "n_regionkey AS region_id",
        SITE_LAT_SQL.format(k="n_nationkey") + " AS lat",
        SITE_LON_SQL.format(k="n_nationkey") + " AS lon",
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SITE: site_id, name, region_id, region, lat, lon."""
    r = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))
    s = _nation_sites(spark, sf_dir)
    return (s.join(F.broadcast(r), "region_id", "left")
             .select("site_id", "name", "region_id", "region", "lat", "lon"))


def _lines_with_site(spark: SparkSession, sf_dir: str, cols) -> DataFrame:
    """Line rows with their site.

    The supplier's key pair is read straight from its files, so Spark knows its
    size in bytes and broadcasts it below its own threshold only; beyond it the
    join is a sort-merge join that AQE splits at hot suppliers.  Nations are 25
    rows by specification.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *cols)
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ns = _nation_sites(spark, sf_dir).select("n_nationkey", "site_id", "name", "lat", "lon")
    return (lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
                 .join(F.broadcast(ns), F.col("s_nationkey") == F.col("n_nationkey"))
                 .drop("l_suppkey", "s_suppkey", "s_nationkey", "n_nationkey"))


def daily_wide_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with one column per parameter; −999 where a value is missing."""
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = _lines_with_site(spark, sf_dir, cols)
    return lines.selectExpr(
        "site_id", "name", "lat", "lon", "CAST(l_shipdate AS DATE) AS date",
        *[f"CASE WHEN l_linenumber = {SENTINEL_LINE} THEN -999.0D ELSE CAST({expr} AS DOUBLE) END AS {p}"
          for p, expr in DAILY_PARAMS],
    )


def daily_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily_wide_raw`` with the sentinel (and NaN) mapped to NULL."""
    return daily_wide_raw(spark, sf_dir).selectExpr(
        "site_id", "name", "lat", "lon", "date",
        *[f"CASE WHEN {p} <> -999.0D AND NOT isnan({p}) THEN {p} END AS {p}" for p, _ in DAILY_PARAMS])


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAILY_OBS as it would arrive from the files: value still holds −999."""
    return daily_wide_raw(spark, sf_dir).unpivot(["site_id", "name", "lat", "lon", "date"],
                                                 [p for p, _ in DAILY_PARAMS], "param", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAILY_OBS with the sentinel (and NaN) mapped to NULL."""
    return daily_raw(spark, sf_dir).select("site_id", "name", "lat", "lon", "date", "param",
                                           sentinel_null("value").alias("value"))


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRODUCTION per (site, year).

    Sums are exact and independent of the summation order: line values are
    turned into integer cents (quantity, price) and 1e-4 units (price ×
    (1 − discount)) and summed as LONG — a fixed-width hash aggregate, where
    DECIMAL(18,2) sums would widen to BigDecimal arithmetic.  One correctly
    rounded division then gives the DOUBLE, equal to converting the exact
    decimal (as the oracle does).
    """
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]
    lines = _lines_with_site(spark, sf_dir, cols)
    units = lines.selectExpr(
        "site_id", "name", "year(l_shipdate) AS year",
        "CAST(round(l_quantity * 100) AS BIGINT) AS qty",
        "CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_quantity * 100) AS BIGINT) ELSE 0L END AS hqty",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS price",
        "CAST(round(l_extendedprice * 100) AS BIGINT) * (100L - CAST(round(l_discount * 100) AS BIGINT)) AS val")
    agg = units.groupBy("site_id", "name", "year").agg(
        F.expr("sum(qty) AS planted"), F.expr("sum(hqty) AS harvested"),
        F.expr("sum(price) AS price"), F.expr("sum(val) AS value"))
    produced_t = "CAST(price AS DOUBLE) / 100.0D / 1000.0D"
    harvested = "CAST(harvested AS DOUBLE) / 100.0D"
    value = "CAST(value AS DOUBLE) / 10000.0D"
    # share of the year's total value; the window runs over the (site, year)
    # aggregate (municipalities × years), not over lines
    total = "CAST(sum(value) OVER (PARTITION BY year) AS DOUBLE) / 10000.0D"
    return agg.selectExpr(
        "site_id", "name", "CAST(year AS INT) AS year",
        "CAST(planted AS DOUBLE) / 100.0D AS planted_ha", f"{harvested} AS harvested_ha",
        f"{produced_t} AS produced_t",
        f"try_divide({produced_t} * 1000.0D, {harvested}) AS yield_kg_ha",
        f"{value} / 1000.0D AS value_kbrl",
        f"try_divide({value} * 100.0D, {total}) AS value_share")


def crosstab(spark: SparkSession, sf_dir: str, variable: int, years) -> DataFrame:
    """Raw crosstab text for one variable: code, name, one column per year.

    One row per line item (code = order-part-supplier key, name =
    ``L<line number>``; where two lines share both, their cells add up); the
    cell of its ship year holds the value as text or a dirty marker, the other
    year cells are blank.  Built with projections only (no shuffle).
    """
    name, col, dash_line, dots_line = CROSSTAB_VARIABLES[variable]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                  "l_linenumber", col, "l_shipdate")
    ln = F.col("l_linenumber")
    text = (F.when(ln == dash_line, F.lit("-"))
             .when(ln == dots_line, F.lit(".."))
             .otherwise(F.col(col).cast("string")))
    yr = F.year("l_shipdate")
    code = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    known = yr.isNull() | yr.isin([int(y) for y in years])
    return li.select(
        F.when(known, code).otherwise(F.raise_error(F.lit("a line was shipped in a year that has no column"))).alias("code"),
        F.concat(F.lit("L"), ln.cast("string")).alias("name"),
        *[F.when(yr == y, text).alias(str(y)) for y in years],
    )
