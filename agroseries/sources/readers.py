"""Readers for the raw inputs.

All readers use explicit schemas (no inference) and return long DataFrames.
Climate payloads carry their own header text; their lines are read with their place in
the file, so a long file is split over tasks.  Production sheets are parsed as CSV
of any width; header rows are found by their place, columns by their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (clean_number, date_from_doy, iso_date, norm_code, sentinel_null,
                                 variable_from_title)

# fixed values: payload header marker and production sheet layout
END_HEADER = "-END HEADER-"
PRODUCTION_HEADER_ROWS = 4  # title, "Variável - …", two header rows

SITES_JSON = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("nome", T.StringType()),
    T.StructField("microrregiao", T.StructType([
        T.StructField("mesorregiao", T.StructType([
            T.StructField("id", T.LongType()),
            T.StructField("nome", T.StringType())]))])),
])


def read_sites(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Registry JSON → (site_id, name, region_id, region), sorted by code.

    Records without the nested region are skipped.
    """
    raw = spark.read.schema(SITES_JSON).option("multiLine", multiline).json(path)
    meso = F.col("microrregiao.mesorregiao")
    return (raw.filter(meso.isNotNull() & F.col("id").isNotNull())
               .select(norm_code("id").alias("site_id"), F.col("nome").alias("name"),
                       meso["id"].cast("int").alias("region_id"), meso["nome"].alias("region"))
               .orderBy("site_id"))


FEATURE_JSON = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.StructType([T.StructField("codarea", T.StringType())])),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType())])),  # raw JSON text, parsed per type later
])


def read_boundaries(spark: SparkSession, path: str, collection: bool = True) -> DataFrame:
    """GeoJSON features → (code INT, geom_type, coords JSON text); keyless skipped.

    ``collection=True`` reads FeatureCollection documents; otherwise one
    Feature per line (GeoJSON text sequences).
    """
    if collection:
        schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE_JSON))])
        feats = (spark.read.schema(schema).option("multiLine", True).json(path)
                      .select(F.explode("features").alias("f")).select("f.*"))
    else:
        feats = spark.read.schema(FEATURE_JSON).json(path)
    return (feats.filter(F.col("properties.codarea").isNotNull())
                 .select(F.col("properties.codarea").try_cast("int").alias("code"),
                         F.col("geometry.type").alias("geom_type"),
                         F.col("geometry.coordinates").alias("coords")))


def payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, block (offset of the file split) and
    id, ascending within a split.  A file is read by as many tasks as it has splits."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"))


def read_point_payloads(spark: SparkSession, path: str, site_pattern: str = r"/payload_([^/]+?)\.[^/.]+$"):
    """S3: climate payload files → (long rows, quarantine).

    Prose up to the last ``-END HEADER-`` is dropped; files without the marker or
    without YEAR/DOY columns go to the quarantine table with a reason.  The first line
    after the marker that is not blank names the columns; YEAR + DOY become a date (day
    366 of a common year rolls over, T5).  Returns (site_id, date, param, value) with
    value still raw (sentinel kept).

    A file is split like any text: markers and headers are found by least and greatest
    place per file (a row each, joined back to the lines), no file is gathered.
    """
    lines = payload_lines(spark, path)
    at = F.struct("block", "id")
    # every file once, from its lines (Spark's readers pass over files of no bytes)
    marks = lines.groupBy("file").agg(F.max(F.when(F.contains("line", F.lit(END_HEADER)), at)).alias("mark"))
    # what follows the marker on its own line is part of the body
    after = lines.join(marks.where("mark IS NOT NULL"), "file").where(at >= F.col("mark")).withColumn(
        "line", F.when(at == F.col("mark"), F.element_at(F.split("line", END_HEADER), -1)).otherwise(F.col("line"))).where(F.trim("line") != "")
    heads = after.groupBy("file").agg(F.min(F.struct(at.alias("at"), "line")).alias("head")).select("file", F.col("head.at").alias("head"), F.split(F.trim("head.line"), ",").alias("names"))
    ok_cols = F.coalesce(F.array_contains("names", "YEAR") & F.array_contains("names", "DOY"), F.lit(False))
    quarantine = marks.join(heads, "file", "left").where(F.col("mark").isNull() | ~ok_cols).select(
        "file", F.when(F.col("mark").isNull(), F.lit("missing header marker")).otherwise(F.lit("missing YEAR/DOY")).alias("reason"))
    cells = lines.join(heads.where(ok_cols), "file").where((at > F.col("head")) & (F.trim("line") != "")).select("file", "names", F.split(F.trim("line"), ",").alias("cells"))
    named = lambda n: F.get("cells", F.array_position("names", n).cast("int") - 1)
    pairs = F.filter(F.arrays_zip("names", "cells"), lambda e: e["names"].isNotNull() & ~e["names"].isin("YEAR", "DOY"))
    long = cells.select("file", named("YEAR").alias("Y"), named("DOY").alias("D"), F.explode(pairs).alias("e"))
    out = long.select(
        F.regexp_extract("file", site_pattern, 1).alias("site_id"),
        date_from_doy(F.col("Y").cast("int"), F.col("D").cast("int")).alias("date"),
        F.col("e.names").alias("param"), F.col("e.cells").try_cast("double").alias("value"))
    return out, quarantine


def read_params(spark: SparkSession, path: str, col: str = "Atributo") -> DataFrame:
    """Parameter list: non-null, distinct."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return df.select(F.trim(F.col(col)).alias("param")).dropna().filter(F.col("param") != "").distinct()


DAILY_CSV = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("date", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def by_name(spark: SparkSession, schema: T.StructType):
    """A CSV reader that checks the header against the schema's names and fails
    on a value that does not fit its type."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")


def read_daily(spark: SparkSession, path: str, partitioned_by_param: bool = True) -> DataFrame:
    """Long daily CSVs (typed, −999/NaN → NULL, ISO date).

    When written by ``write_daily`` the parameter is the partition column.
    """
    schema = DAILY_CSV if partitioned_by_param else T.StructType(DAILY_CSV.fields + [T.StructField("param", T.StringType())])
    df = by_name(spark, schema).csv(path)
    if partitioned_by_param and "param" not in df.columns:
        raise ValueError("expected a param=… partitioned layout")
    return df.select("site_id", "name", "lat", "lon", iso_date("date").alias("date"), "param",
                     sentinel_null("value").alias("value"))


CORRUPT, FILE = "_corrupt", "_file"


def checked_rows(spark: SparkSession, path: str, schema: T.StructType, required=None) -> DataFrame:
    """Lines of CSV files with their file, the schema's columns and ``reason`` (null: a good row).

    A line is parsed once: the parsed cells leave a generator, below which no filter on
    them is pushed (it would parse the line again for each cell that it looks at).
    """
    required = list(required or [])
    names = [f.name for f in schema]
    value = F.col("value")
    odd = F.startswith(value, F.lit("\ufeff")) | F.contains(value, F.lit("\r"))
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias(FILE), F.when(odd, F.regexp_replace("value", "^\ufeff|\r$", "")).otherwise(value).alias("line")).where(F.trim("line") != "")
    # every file's (and part's) header line is the schema's names
    header = ",".join(names)
    rows = raw.where(F.replace("line", F.lit('"'), F.lit("")) != header)
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("more", T.StringType())])
    # one column more than the schema shows a field too many; the count comes from the parsed line
    parsed = F.from_csv("line", texts.simpleString()[len("struct<"):-1].replace(":", " "), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    # separators outside quotes
    bare = F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", '"(?:[^"]|"")*"', "")).otherwise(F.col("line"))
    cells = rows.select(FILE, "line", bare.alias("_bare"), F.explode(F.array(parsed)).alias("cells"))
    fields = F.length("_bare") - F.length(F.replace("_bare", F.lit(","), F.lit(""))) + 1
    typed, reasons = [], [F.when(fields != len(names), F.concat(F.lit("fields "), fields.cast("string"), F.lit(f" instead of {len(names)}")))]
    for i, f in enumerate(schema):
        text = F.col("cells")[f"c{i}"]
        blank = text.isNull() | (F.trim(text) == "")
        value = text if isinstance(f.dataType, T.StringType) else F.when(~blank, F.trim(text).try_cast(f.dataType))
        typed.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            reasons.append(F.when(~blank & value.isNull(), F.lit(f"type of {f.name}")))
        if f.name in required:
            reasons.append(F.when(blank, F.lit(f"missing {f.name}")))
    return cells.select(F.col(FILE).alias("file"), F.coalesce(*reasons, F.lit(None).cast("string")).alias("reason"), "line", F.struct(*typed).alias("row"))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType, required=None) -> tuple[DataFrame, DataFrame]:
    """Q1 + S5/S8, row by row: CSV files by schema → (good rows, quarantine).

    The quarantine has (file, reason, line) of every row that
    * has another number of fields than the header (``fields``),
    * holds a value that does not fit its column's type (``type of <column>``), or
    * lacks a required value (``missing <column>``; ``required`` defaults to no column).
    Each of the two tables is one scan of the lines.  Quoted line breaks are not supported
    here (such files are not splittable); empty lines are skipped.
    """
    checked = checked_rows(spark, path, schema, required)
    return checked.where("reason IS NULL").select("row.*"), checked.where("reason IS NOT NULL").select("file", "reason", "line")


def read_daily_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S5 with a quarantine: daily CSVs that hold the parameter as a column; rows without
    a key, a date or of another shape are put aside, not guessed."""
    schema = T.StructType([*DAILY_CSV.fields, T.StructField("param", T.StringType())])
    checked = checked_rows(spark, path, schema, required=["site_id", "date", "param"])
    dated = checked.withColumn("_date", F.try_to_date("row.date", "yyyy-MM-dd"))
    rows = dated.where("reason IS NULL AND _date IS NOT NULL").select("row.site_id", "row.name", "row.lat", "row.lon", F.col("_date").alias("date"), "row.param", sentinel_null(F.col("row.value")).alias("value"))
    fits = F.col("reason").isNull()  # but for its date
    bad = dated.where("reason IS NOT NULL OR _date IS NULL").select(
        F.when(~fits, F.col("file")).alias("file"), F.when(fits, F.lit("type of date")).otherwise(F.col("reason")).alias("reason"),
        F.when(fits, F.concat_ws(",", *[F.coalesce(F.col(f"row.{f.name}").cast("string"), F.lit("")) for f in schema])).otherwise(F.col("line")).alias("line"))
    return rows, bad


def read_dekads(spark: SparkSession, path: str, years=None) -> DataFrame:
    """The year-partitioned dekad dataset; a year list prunes partitions."""
    df = spark.read.parquet(path)
    return df if years is None else df.filter(F.col("year").isin(list(years)))


def sheet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV sheets of any width: file, id (ascending within a file), cells.

    The greatest number of separators in a line bounds the number of columns;
    quoted cells may hold separators and line breaks, so rows are parsed, not
    split, and a sheet is streamed, not held in one row.
    """
    widest = spark.read.text(path).agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","), F.lit(""))))).first()[0]
    cells = [f"c{i}" for i in range((widest or 0) + 2)]
    rows = (spark.read.schema(", ".join(f"{c} string" for c in cells)).option("multiLine", True)
                 .option("quote", '"').option("escape", '"').csv(path))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.array(*cells).alias("cells"))


def read_production(spark: SparkSession, path: str, years, sheet_prefix: str | None = "tabela") -> DataFrame:
    """Production sheet exports (one CSV per sheet) → long (code, name, year, variable, value).

    Sheets whose name (``sheet=…`` folder, else the file) does not start with
    ``sheet_prefix`` are notes and skipped.  Per sheet: the variable name is the
    second row's first cell ("Variável - …", X6), rows 3–4 are a two-row header
    (the lower cell wins unless empty), data rows follow; nameless rows (footers) are
    dropped; the wanted years are found by name, wherever their columns stand; a
    sheet without any is skipped.  Cells are cleaned (X5).
    """
    rows = sheet_rows(spark, path)
    if sheet_prefix:
        sheet = F.coalesce(F.nullif(F.regexp_extract("file", r"sheet=([^/]*)/", 1), F.lit("")), F.regexp_extract("file", r"([^/]*)$", 1))
        rows = rows.where(F.startswith(F.lower(F.trim(sheet)), F.lit(sheet_prefix)))
    place = F.row_number().over(Window.partitionBy("file").orderBy("id"))
    row = lambda i: F.max(F.when(F.col("place") == i, F.col("cells")))
    top = (rows.withColumn("place", place).where(F.col("place") <= PRODUCTION_HEADER_ROWS).groupBy("file")
               .agg(F.max("id").alias("last"), row(2).alias("title"), row(3).alias("upper"), row(4).alias("lower")))
    names = F.zip_with("upper", "lower", lambda a, b: F.coalesce(F.nullif(F.trim(b), F.lit("")), F.trim(a)))
    top = top.select("file", "last", variable_from_title(F.col("title")[0]).alias("variable"), names.alias("names"))
    wanted = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("year"), i.alias("i"))), lambda x: x["year"].isin([str(y) for y in years]))
    top = top.select("file", "last", "variable", wanted.alias("wanted"))
    data = rows.join(top, "file").where(F.col("id") > F.col("last"))
    code, name = F.trim(F.col("cells")[0]), F.trim(F.col("cells")[1])
    long = data.where(name.isNotNull() & (name != "")).select("variable", "cells", code.alias("code"), name.alias("name"), F.explode("wanted").alias("y"))
    raw = F.get("cells", F.col("y.i"))
    return long.select("code", "name", F.col("y.year").cast("int").alias("year"), "variable", raw.alias("raw"), clean_number(raw).alias("value"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with an explicit schema (keys declared as strings stay strings)."""
    return by_name(spark, schema).csv(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """S9."""
    return spark.read.parquet(path)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attribute dictionary (BOM, quoted commas) → trimmed (code, description)."""
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
               .option("multiLine", True).csv(path))
    cols = df.columns
    return df.select(F.trim(F.col(f"`{cols[0]}`")).alias("code"),
                     F.trim(F.col(f"`{cols[1]}`")).alias("description")).filter(F.col("code").isNotNull())
