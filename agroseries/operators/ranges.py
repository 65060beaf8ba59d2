"""Order statistics without a buffer that holds a whole group.

Values are counted first, so equal values cost one row.  The counts are range
partitioned on (group, value), summed inside each range, and each range gets the
sums of the ranges before it from a table of one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def prefix_sums(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` (one row per group and value) with ``<s>_lt``, the sum over the
    group's lesser values, and ``<s>_all``, the sum over the group."""
    ranged = counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the number of a range must not change when a task is repeated
    inside = Window.partitionBy("_range", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumns({f"{s}_in": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"{s}_sum") for s in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_range").alias("_range_"), *[F.col(b).alias(f"{b}_") for b in by],
                           *[F.coalesce(F.sum(f"{s}_sum").over(before), F.lit(0)).alias(f"{s}_off") for s in sums],
                           *[F.sum(f"{s}_sum").over(Window.partitionBy(*by)).alias(f"{s}_all") for s in sums])
    same = F.col("_range") == F.col("_range_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_"))
    return ranged.join(totals, same).select(*counts.columns, *[(F.col(f"{s}_in") + F.col(f"{s}_off")).alias(f"{s}_lt") for s in sums], *[f"{s}_all" for s in sums])


def quantiles(df: DataFrame, by: list[str], col: str, probs: list[float]) -> DataFrame:
    """by, q (array): exact, linearly interpolated quantiles of each group's values;
    missing values do not count."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = prefix_sums(counts, by, "_v", ["_n"])
    aggs = []
    for i, p in enumerate(probs):
        rank = F.lit(p) * (F.col("_n_all") - 1)
        for name, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("_n_lt") <= at) & (at < F.col("_n_lt") + F.col("_n"))
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"_{name}{i}"))
    g = placed.groupBy(*by).agg(F.max("_n_all").alias("_all"), *aggs)
    part = lambda p: F.lit(p) * (F.col("_all") - 1) - F.floor(F.lit(p) * (F.col("_all") - 1))
    return g.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part(p) for i, p in enumerate(probs)]).alias("q"))


def with_next(df: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """``df`` (one row per group and value) with ``<c>_next``, the columns of the group's
    row of the next greater value (null at its end).

    Rows are put in ranges of (group, value); inside a range the next row is a window
    away, at its end it is the first row of the group's next range, taken from a table
    of one row per range and group.  No task holds a whole group.
    """
    ranged = cut_lineage(df.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *by).orderBy(value)
    here = F.struct(*columns)
    ranged = ranged.withColumns({"_next": F.lead(here).over(inside), "_last": F.lead(F.lit(True)).over(inside).isNull()})
    firsts = ranged.groupBy(*by, "_range").agg(F.min(F.struct(F.col(value).alias("_v"), here.alias("_row"))).alias("_first"))
    after = Window.partitionBy(*by).orderBy("_range")
    firsts = firsts.select(F.col("_range").alias("_range_"), *[F.col(b).alias(f"{b}_") for b in by], F.lead("_first._row").over(after).alias("_then"))
    same = F.col("_range") == F.col("_range_")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"{b}_"))
    found = F.when(F.col("_last"), F.col("_then")).otherwise(F.col("_next"))
    return ranged.join(firsts, same).select(*df.columns, *[found[c].alias(f"{c}_next") for c in columns])
