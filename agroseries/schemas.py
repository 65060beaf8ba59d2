"""Fixed long-form schemas (wide tables exist only at export)."""

from pyspark.sql import types as T

SITE = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("region_id", T.IntegerType()),
    T.StructField("region", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

DAILY_OBS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("param", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

DEKAD_KEY = ["site_id", "name", "lat", "lon", "year", "month", "dekad"]

DEKAD_OBS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("dekad", T.IntegerType()),
    T.StructField("param", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

SEASON_OBS = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("season_year", T.IntegerType()),
    T.StructField("rel_year", T.IntegerType()),
    T.StructField("dekad36", T.IntegerType()),
    T.StructField("param", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

PRODUCTION_MEASURES = ["planted_ha", "harvested_ha", "produced_t", "yield_kg_ha",
                       "value_kbrl", "value_share"]

PRODUCTION = T.StructType(
    [T.StructField("site_id", T.StringType()),
     T.StructField("name", T.StringType()),
     T.StructField("year", T.IntegerType())]
    + [T.StructField(m, T.DoubleType()) for m in PRODUCTION_MEASURES]
)
