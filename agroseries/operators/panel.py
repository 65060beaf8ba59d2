"""Panel assembly and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .quality import expect_unique

GEO_COLS = ["region_id", "region", "lat", "lon"]
DEFAULT_REGION = "Unknown region"


def join_geo(prod: DataFrame, sites: DataFrame, validate: bool = True) -> DataFrame:
    """Production ⟕ site geography on the code, many-to-one.

    The site table is one row per municipality, validated unique first
    (T12); AQE broadcasts it from its measured size.
    """
    geo = sites.select("site_id", *GEO_COLS)
    if validate:
        expect_unique(geo, ["site_id"])
    return prod.join(geo, "site_id", "left")


def join_climate(panel: DataFrame, season: DataFrame, validate: bool = True,
                 validate_season: bool = True) -> DataFrame:
    """J2 in long form: (production + geo) ⟕ season rows on (site_id, year).

    The left side is unique on (site_id, year) and the season side on
    (site_id, season_year, param, rel_year, dekad36); with those the long
    result is the wide 1:1 merge, one row per climate cell.  The join runs
    on the season side's key, so AQE can split a hot site's partition.

    ``validate_season`` re-checks the season side, a full aggregate over the
    largest table; ``season_table`` output is grouped on that key (unique by
    construction), so callers passing it may skip the check.
    """
    clim = season.withColumnRenamed("season_year", "year").drop("name")
    if validate:
        # the site-year panel is bounded (municipalities × years) and read by
        # the check and by the join: materialise it once in the shared folder
        panel = cut_lineage(panel)
        expect_unique(panel, ["site_id", "year"])
    if validate and validate_season:
        expect_unique(clim, ["site_id", "year", "param", "rel_year", "dekad36"])
    return panel.join(clim, ["site_id", "year"], "left")


def canonicalise(df: DataFrame, renames: dict | None = None) -> DataFrame:
    """Rename columns; add a default region label when absent."""
    out = df.withColumnsRenamed(renames or {})
    if "region" not in out.columns:
        out = out.withColumn("region", F.lit(DEFAULT_REGION))
    return out


ID_COLS = ["site_id", "name", "year"]


def order_columns(df: DataFrame, targets=None, climate=("param", "rel_year", "dekad36", "value")) -> DataFrame:
    """Ids, geography, targets, climate (only columns that exist)."""
    cols = df.columns
    targets = targets or [c for c in cols if c not in ID_COLS + GEO_COLS + list(climate)]
    order = [c for c in ID_COLS + GEO_COLS + list(targets) + list(climate) if c in cols]
    return df.select(*order)


def filter_panel(df: DataFrame, years=None, sites=None) -> DataFrame:
    """year IN … and site IN … (a list literal, or a DataFrame of ids → semi-join)."""
    out = df
    if years is not None:
        out = out.filter(F.col("year").isin(list(years)))
    if sites is not None:
        if isinstance(sites, DataFrame):
            out = out.join(sites.select("site_id").distinct(), "site_id", "left_semi")
        else:
            out = out.filter(F.col("site_id").isin(list(sites)))
    return out


def sites_in_regions(df: DataFrame, regions=None) -> DataFrame:
    """distinct (region, site, name) options for the chosen regions, sorted."""
    out = df if regions is None else df.filter(F.col("region").isin(list(regions)))
    return out.select("region", "site_id", "name").distinct().orderBy("region", "name", "site_id")


def slice_year(df: DataFrame, year=None) -> DataFrame:
    """one year, or everything when ``year`` is None."""
    return df if year is None else df.filter(F.col("year") == year)


def panel_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct sites/years/regions/parameters and total nulls.

    One grouped pass combines the rows map-side; the distinct counts then run over
    the small table of groups.
    """
    cols = df.columns
    dims = [c for c in ("site_id", "year", "region", "param") if c in cols]
    nulls = sum(F.col(f"`{c}`").isNull().cast("long") for c in cols)
    g = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"), F.sum(nulls).alias("_nulls"))
    names = {"site_id": "n_sites", "year": "n_years", "region": "n_regions", "param": "n_params"}
    return g.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), *[F.count_distinct(d).alias(names[d]) for d in dims], F.sum("_nulls").alias("n_nulls"))
