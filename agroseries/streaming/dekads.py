"""Dekads kept up to date: A1 as a table of mergeable parts (S11 + A1).

Every micro-batch of daily rows is aggregated to the parts of ``dekad_partials``
(count, sum, maximum, minimum per dekad key) and written as

    year=<y>/kind=delta/batch=<id>/

in one write that replaces exactly the partitions of its own batch, so a batch that a
crash makes Spark repeat writes the same files again and nothing is counted twice.  Only
the years of the batch get files; late days are one more delta of their year.  Reading
adds parts up per key, which gives what one aggregate over all days gives.

``compact`` folds a year's deltas into ``kind=base``; a base says up to which batch it
holds, and readers leave out what it covers, so a fold that stops half-way (base there,
deltas still there) changes no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import sentinel_null
from ..operators import climate
from ..schemas import DEKAD_KEY

PARTITIONS = ["year", "kind", "batch"]
STORED = T.StructType([
    T.StructField("site_id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("month", T.IntegerType()), T.StructField("dekad", T.IntegerType()), T.StructField("param", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("year", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("batch", T.LongType()),
])


def _write(parts: DataFrame, out: str, kind: str, batch: int) -> None:
    rows = parts.withColumns({"kind": F.lit(kind), "batch": F.lit(int(batch)).cast("long")})
    # a year's rows in few files, whatever the number of tasks; one hot year is split by AQE
    rows = rows.select([F.col(f.name).cast(f.dataType) for f in STORED]).hint("rebalance", "year")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(out)


def apply_batch(daily: DataFrame, batch: int, out: str) -> None:
    """Add one batch of daily rows; the same batch again replaces itself.

    A year that an earlier run of the batch wrote and this one does not have is not
    touched: a batch's rows must be the same each time (as a checkpoint's are).
    """
    _write(climate.dekad_partials(daily), out, "delta", batch)


def stored_parts(spark: SparkSession, out: str, years=None) -> DataFrame:
    """The parts that count: per year its latest base and the deltas after it."""
    parts = spark.read.schema(STORED).parquet(out)
    if years is not None:
        parts = parts.where(F.col("year").isin([int(y) for y in years]))
    # partition values only: no column of the files is read
    base = parts.where("kind = 'base'").groupBy(F.col("year").alias("_year")).agg(F.max("batch").alias("_upto"))
    rows = parts.join(base, parts["year"] == F.col("_year"), "left")
    return rows.where("_upto IS NULL OR (kind = 'base' AND batch = _upto) OR (kind = 'delta' AND batch > _upto)").drop("_year", "_upto", "kind", "batch")


def read_dekads(spark: SparkSession, out: str, years=None, rules: DataFrame | None = None) -> DataFrame:
    """A1 of everything that was ingested; ``years`` prunes the files."""
    return climate.finish_partials(climate.merge_partials(stored_parts(spark, out, years)), rules)


def compact(spark: SparkSession, out: str, years, remove: bool = True) -> None:
    """Fold the deltas of ``years`` into one base each, then remove what it covers.

    Not to be run while a batch is written.
    """
    parts = spark.read.schema(STORED).parquet(out)
    for year in sorted({int(y) for y in years}):
        own = parts.where((F.col("year") == year) & (F.col("kind") == "delta"))
        last = own.agg(F.max("batch")).first()[0]
        if last is None:
            continue
        _write(climate.merge_partials(stored_parts(spark, out, [year])), out, "base", last)
        if remove:
            for kind, batch in spark.read.schema(STORED).parquet(out).where(F.col("year") == year).select("kind", "batch").distinct().collect():
                if batch < last or (kind == "delta" and batch == last):
                    _delete(spark, f"{out}/year={year}/kind={kind}/batch={batch}")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ingest_dekads(spark: SparkSession, source: str, out: str, checkpoint: str, schema: T.StructType,
                  fmt: str = "parquet", value_col: str = "value", max_files_per_trigger: int = 64):
    """Add every new file of daily rows under ``source`` once; returns the finished query."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger).load(source)
    cleaned = stream.withColumn(value_col, sentinel_null(value_col))
    query = (cleaned.writeStream.foreachBatch(lambda rows, batch: apply_batch(rows, batch, out))
                    .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query
