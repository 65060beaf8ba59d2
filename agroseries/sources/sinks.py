"""Writers (K1–K6).  All are plain DataFrameWriter calls; no driver-side files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SITE_ORDER = ["site_id", "name", "region_id", "region", "lat", "lon"]
BOM = "\ufeff"


def write_sites(df: DataFrame, path: str, bom: bool = True) -> None:
    """K1: fixed field order, header; the UTF-8 BOM leads the header line."""
    out = df.select(*SITE_ORDER)
    if bom:
        out = out.withColumnRenamed(SITE_ORDER[0], BOM + SITE_ORDER[0])
    out.write.mode("overwrite").option("header", True).csv(path)


OPEN_FOLDERS = 256        # parameters a task writes side by side; it sorts the rows of any others
ROWS_PER_FILE = 2_000_000  # compressed files are not split by readers


@contextmanager
def setting(spark: SparkSession, key: str, value) -> None:
    """A session setting for the time of a write."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def write_daily(df: DataFrame, path: str) -> None:
    """K2: long daily rows, one folder per parameter (not one file per pair).

    Site and place repeat in every line, so files are compressed; a task keeps a file
    per folder open and does not sort its rows by folder first.
    """
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FOLDERS):
        (df.select("site_id", "name", "lat", "lon", F.date_format("date", "yyyy-MM-dd").alias("date"),
                   "value", "param")
           .write.mode("overwrite").option("header", True).option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE)
           .partitionBy("param").csv(path))


def write_by_year(df: DataFrame, path: str, col: str = "year") -> None:
    """K3: Parquet partitioned by year (readers prune by the year filter)."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)


def rewrite_years(df: DataFrame, path: str, col: str = "year", by: tuple[str, ...] = ("site_id",)) -> None:
    """K3, one year at a time: the years that ``df`` has replace theirs in the dataset,
    files of other years are not touched.

    Rows are range partitioned by (year, site) and sorted, so a file holds a run of
    sites and readers skip files and row groups by their statistics; a large year is
    several files, however its rows arrive.
    """
    keys = [col, *by]
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(col).parquet(path))


def fixed_digits(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as text with ``digits`` decimals, other columns as they are.

    Built-in formatting rounds the exact binary value half to even.  It differs
    from C's ``%.<digits>f`` where half a unit of the last digit itself is printed
    (0.00005), which counts as a whole unit here, as it does there.
    """
    half = 0.5 * 10.0 ** -digits
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = c.cast("double")
            v = F.when(F.abs(v) == half, F.signum(v) * 2 * half).when(~F.isnan(v), v)
            c = F.translate(F.format_number(v, digits), ",", "").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def write_wide_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """K4: export with fixed decimals."""
    fixed_digits(df, digits).write.mode("overwrite").option("header", True).csv(path)


def write_panel_csv(df: DataFrame, path: str) -> None:
    """K5."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str) -> None:
    """K6: snappy Parquet."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_text_files(df: DataFrame, path: str, key: str, order: str, text: str = "text") -> None:
    """One text file per ``key`` value with lines in ``order``.

    Rows are hash-partitioned by the key so that a key's lines land in one
    task (one file), then sorted within the partition.
    """
    (df.repartition(key).sortWithinPartitions(key, order)
       .select(key, text).write.mode("overwrite").partitionBy(key).text(path))


def write_ordered_csv(df: DataFrame, path: str, keys: list[str], bom: bool = True, header: bool = True) -> DataFrame:
    """K1/K4/K5 as one ordered file in parts: the parts, joined in the order of their
    names, are one CSV in the order of ``keys`` with one header line (and BOM) at its top.

    Rows are range partitioned by the keys and sorted, so part numbers follow key order;
    the header leads the first row of the first part.  A manifest (one JSON line per
    part: part, n_rows, first, last) is written to ``<path>.manifest`` and returned.
    Nothing passes through the driver.
    """
    spark = df.sparkSession
    options = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}
    names = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"') else c for c in df.columns)
    top = (BOM if bom else "") + (names if header else "")
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), options)
    first = F.monotonically_increasing_id() == 0  # the first row of partition 0
    lead = F.lit(top + "\n" if header else top)
    ordered.select(F.when(first, F.concat(lead, line)).otherwise(line).alias("value")).write.mode("overwrite").text(path)
    written = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    if top and not written.limit(1).count():  # a table without rows is a header
        spark.range(1).select(F.lit(top).alias("value")).coalesce(1).write.mode("overwrite").text(path)
        written = spark.read.text(path).select(F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    rows = written.where(F.col("value") != F.lit(names)) if header else written  # readers strip the BOM
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("value", "id").alias("first"), F.max_by("value", "id").alias("last"))
    parts.repartitionByRange(1, "part").sortWithinPartitions("part").write.mode("overwrite").json(path + ".manifest")
    return spark.read.schema(parts.schema).json(path + ".manifest")
