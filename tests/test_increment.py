"""Dekads kept up to date: batches, late days, repeated batches, folds."""

import os

import pytest
from pyspark.sql import functions as F

from agroseries import bindings as B
from agroseries.operators import climate, rules as R
from agroseries.streaming import dekads as D

SF = "/root/testdata/sf0.001"


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows_of(df):
    return sorted((r.site_id, r.year, r.month, r.dekad, r.param, round(r.value, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def daily(spark):
    return B.daily_raw(spark, SF).cache()


def clean(df):
    return df.withColumn("value", F.when((F.col("value") != -999) & ~F.isnan("value"), F.col("value")))


def test_three_batches_with_late_days_and_a_crash(spark, daily, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    year = F.year("date")
    late = F.dayofmonth("date") == 5
    first, second, third = daily.where((year <= 1996) & ~late), daily.where(year == 1997), daily.where((year <= 1996) & late)

    first.coalesce(1).write.parquet(src)
    D.ingest_dekads(spark, src, out, ck, daily.schema)
    assert rows_of(D.read_dekads(spark, out)) == rows_of(climate.dekad_aggregate(clean(first)))

    second.coalesce(1).write.mode("append").parquet(src)
    before = files_of(out)
    D.ingest_dekads(spark, src, out, ck, daily.schema)
    after = files_of(out)
    assert {k: after[k] for k in before} == before and {k.split("/")[0] for k in after.keys() - before.keys()} == {"year=1997"}

    # the third batch's files are written, then the run dies before it is committed: it is repeated
    third.coalesce(1).write.mode("append").parquet(src)
    real, tries = D.apply_batch, []

    def crash(rows, batch, place):
        real(rows, batch, place)
        if not tries:
            tries.append(batch)
            raise RuntimeError("executor lost")

    D.apply_batch = crash
    try:
        with pytest.raises(Exception):
            D.ingest_dekads(spark, src, out, ck, daily.schema)
        D.ingest_dekads(spark, src, out, ck, daily.schema)
    finally:
        D.apply_batch = real
    assert tries
    whole = clean(daily.where(year <= 1997))
    assert rows_of(D.read_dekads(spark, out)) == rows_of(climate.dekad_aggregate(whole))
    assert {k.split("/")[0] for k in files_of(out) if "batch=2" in k} <= {"year=1995", "year=1996"}
    D.ingest_dekads(spark, src, out, ck, daily.schema)  # nothing new
    assert rows_of(D.read_dekads(spark, out, [1996])) == [r for r in rows_of(climate.dekad_aggregate(whole)) if r[1] == 1996]

    # a fold that stops half-way changes nothing, nor does one that ends
    expected = rows_of(D.read_dekads(spark, out))
    D.compact(spark, out, [1996], remove=False)
    assert rows_of(D.read_dekads(spark, out)) == expected
    D.compact(spark, out, [1995, 1996])
    assert rows_of(D.read_dekads(spark, out)) == expected
    kept = {k for k in files_of(out) if k.startswith("year=1996")}
    assert kept and all("kind=base" in k for k in kept)
    # a delta after the fold is added
    D.apply_batch(clean(daily.where((year == 1996) & late)).withColumn("param", F.concat("param", F.lit("_B"))), 9, out)
    assert len(D.read_dekads(spark, out, [1996]).where(F.endswith("param", F.lit("_B"))).collect()) == climate.dekad_aggregate(clean(daily.where((year == 1996) & late))).count()


def test_parts_of_missing_values(spark, tmp_path):
    day = lambda d, p, v: ("1", "a", 0.0, 0.0, d, p, v)
    schema = "site_id string, name string, lat double, lon double, date string, param string, value double"
    rows = [day("2020-01-01", "PREC", None), day("2020-01-02", "T_MAX", None), day("2020-01-03", "T", float("nan")), day("2020-01-04", "T_RANGE", 3.0)]
    late = [day("2020-01-09", "T_RANGE", 1.0), day("2020-01-10", "T", 4.0), (None, "a", 0.0, 0.0, "2020-01-01", "T", 1.0)]
    frame = lambda r: spark.createDataFrame(r, schema).withColumn("date", F.to_date("date"))
    out = str(tmp_path / "out")
    D.apply_batch(frame(rows), 0, out)
    D.apply_batch(frame(late), 1, out)
    D.apply_batch(frame(late), 1, out)
    got = {r.param: r.value for r in D.read_dekads(spark, out).collect()}
    assert got == {"PREC": 0.0, "T_RANGE": 2.0, "T": 4.0}


def test_wide_equals_long(spark):
    params = [p for p, _ in B.DAILY_PARAMS]
    wide = climate.dekad_aggregate_wide(B.daily_wide(spark, SF), params)
    assert rows_of(wide) == rows_of(climate.dekad_aggregate(B.daily(spark, SF)))
    assert {p: climate.default_rule(p) for p in params} == {r.param: r.rule for r in R.resolve(B.daily_raw(spark, SF), R.default_rules(spark)).collect()}


def test_rules_default_conflicts_and_errors(spark):
    names = spark.createDataFrame([(x,) for x in ["T2M_MAX", "PRECTOTCORR", "PREC_PROB", "cloud_COUNT", "T2M_RANGE", "T2M", "MAXMIN", "PROB_PREC_X", None, "T2M"]], "param string")
    got = {r.param: (r.rule, r.n_rules) for r in R.resolve(names, R.default_rules(spark)).collect()}
    assert got == {"T2M_MAX": ("max", 1), "PRECTOTCORR": ("sum", 1), "PREC_PROB": ("mean", 1), "cloud_COUNT": ("sum", 1),
                   "T2M_RANGE": ("range", 1), "T2M": ("mean", 0), "MAXMIN": ("max", 2), "PROB_PREC_X": ("mean", 1)}
    by_case = names.where("param IS NOT NULL").select("param", climate.rule_of("param").alias("rule")).collect()
    assert all(got[r.param][0] == r.rule for r in by_case)
    assert [r.param for r in R.conflicts(names, R.default_rules(spark)).collect()] == ["MAXMIN"]
    with pytest.raises(R.RuleError, match="MAXMIN .max/min."):
        R.expect_unambiguous(names, R.default_rules(spark))
    with pytest.raises(R.RuleError, match="unknown"):
        R.resolve(names, spark.createDataFrame([("x", "median", 1)], R.RULE_SCHEMA))
    assert R.resolve(names, spark.createDataFrame([], R.RULE_SCHEMA)).where("rule <> 'mean'").count() == 0
