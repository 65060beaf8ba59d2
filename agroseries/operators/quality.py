"""Data-quality expectations (Q1–Q3).

Each check is one aggregate job whose result is a handful of rows (counts or
at most ``sample`` offending keys), so nothing unbounded reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ExpectationError(ValueError):
    pass


def completeness(df: DataFrame, cols=None) -> DataFrame:
    """Q1 counts: one row with rows, and per column null-or-empty counts."""
    cols = list(cols or df.columns)
    exprs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        v = F.col(f"`{c}`")
        empty = v.isNull()
        if dict(df.dtypes)[c] == "string":
            empty = empty | (F.trim(v) == "")
        exprs.append(F.sum(empty.cast("long")).alias(f"missing_{c}"))
    return df.agg(*exprs)


def incomplete_rows(df: DataFrame, cols=None) -> DataFrame:
    """Q1 rows: those with a null or empty value, and ``missing``, the columns at fault."""
    kinds = dict(df.dtypes)
    faults = []
    for c in list(cols or df.columns):
        v = F.col(f"`{c}`")
        empty = v.isNull() | (F.trim(v) == "") if kinds[c] == "string" else v.isNull()
        faults.append(F.when(empty, F.lit(c)))
    return df.withColumn("missing", F.array_compact(F.array(*faults))).where(F.size("missing") > 0)


def expect_complete(df: DataFrame, cols=None, n_fields: int | None = None, sample: int = 5) -> DataFrame:
    """Q1: raise when any listed column has a null/empty value, or when the table has not
    the expected number of fields; the error shows up to ``sample`` rows."""
    if n_fields is not None and len(df.columns) != n_fields:
        raise ExpectationError(f"{len(df.columns)} fields instead of {n_fields}")
    row = completeness(df, cols).first().asDict()
    bad = {k[len("missing_"):]: v for k, v in row.items() if k.startswith("missing_") and v}
    if bad:
        rows = [tuple(r) for r in incomplete_rows(df, cols).limit(sample).collect()]
        raise ExpectationError(f"incomplete columns: {bad}; for example {rows}")
    return df


def expect_no_bad_rows(quarantine: DataFrame, sample: int = 5) -> None:
    """Q1 on files: raise with the number of rows by reason and up to ``sample`` lines."""
    counts = {r["reason"]: r["n"] for r in quarantine.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(sample).collect()}
    if counts:
        rows = [(r["file"], r["reason"], r["line"]) for r in quarantine.limit(sample).collect()]
        raise ExpectationError(f"malformed rows: {counts}; for example {rows}")


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Q2: keys that occur more than once, with their count."""
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))


def expect_unique(df: DataFrame, keys, sample: int = 5) -> DataFrame:
    """Q2: raise when ``keys`` are not unique (a join side must be m:1 / 1:1)."""
    dups = duplicate_keys(df, keys).limit(sample).collect()
    if dups:
        raise ExpectationError(f"duplicate keys {list(keys)}: {[tuple(r) for r in dups]}")
    return df


def unmatched(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Q3: rows of ``left`` with no partner in ``right`` (a real anti-join)."""
    keys = list(keys)
    return left.join(right.select(*keys).distinct(), keys, "left_anti")
