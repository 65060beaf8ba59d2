"""Row-level validation, splittable payloads, ordered export, year rewrites, SQL surface, thinned ROC."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroseries import sql as SQL
from agroseries.operators import evaluation as EV, quality as Q, ranges as RA
from agroseries.sources import readers as R, sinks as K

SMALL = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("v", T.DoubleType())])


def test_bad_rows_are_put_aside_with_file_and_reason(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿k,n,v\r\na,1,1.5\r\nb,x,2\r\n\"c, d\",3,\r\nonly\r\n,4,4\r\n".encode())
    (tmp_path / "b.csv").write_text('k,n,v\n"say ""hi"", ok",5,5e3\nz,6,7,8\n\nw,2147483648,1\nnan,7,NaN\n')
    good, bad = R.read_csv_checked(spark, str(tmp_path), SMALL, required=["k"])
    assert sorted(((r.k, r.n, r.v) for r in good.where("NOT isnan(v) OR v IS NULL").collect())) == [("a", 1, 1.5), ("c, d", 3, None), ('say "hi", ok', 5, 5000.0)]
    got = {(os.path.basename(r.file), r.reason, r.line) for r in bad.collect()}
    assert got == {("a.csv", "type of n", "b,x,2"), ("a.csv", "fields 1 instead of 3", "only"), ("a.csv", "missing k", ",4,4"),
                   ("b.csv", "fields 4 instead of 3", "z,6,7,8"), ("b.csv", "type of n", "w,2147483648,1")}
    with pytest.raises(Q.ExpectationError, match="(?s)type of n.*b,x,2|w,2147483648"):
        Q.expect_no_bad_rows(bad)
    Q.expect_no_bad_rows(bad.limit(0))


def test_incomplete_rows_are_shown(spark):
    df = spark.createDataFrame([("a", 1), (" ", 2), ("c", None)], "k string, n int")
    assert {(r.k, tuple(r.missing)) for r in Q.incomplete_rows(df).collect()} == {(" ", ("k",)), ("c", ("n",))}
    with pytest.raises(Q.ExpectationError, match=r"for example .*\['n'\]"):
        Q.expect_complete(df, ["n"])


def test_a_payload_is_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    body = "".join(f"{2000 + i // 366},{i % 366 + 1},{i},{-999 if i % 7 == 0 else i / 2}\r\n" for i in range(n))
    (tmp_path / "payload_7.csv").write_text("prose, with commas\n-END HEADER- of a part\nmore prose\n-END HEADER-\n\n  \nYEAR,DOY,T2M,RAIN\n" + body)
    (tmp_path / "payload_8.csv").write_text("x -END HEADER-YEAR,DOY,T2M\n2021,1,5\n2021,2\n")
    (tmp_path / "payload_9.csv").write_text("\n")
    (tmp_path / "payload_10.csv").write_text("-END HEADER-\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        assert R.payload_lines(spark, str(tmp_path / "payload_7.csv")).select("block").distinct().count() > 8
        rows, bad = R.read_point_payloads(spark, str(tmp_path))
        got = rows.where("site_id = '7'").groupBy("param").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()
        assert {(r.param, r.n, r.s) for r in got} == {("T2M", n, float(sum(range(n)))), ("RAIN", n, float(sum(-999 if i % 7 == 0 else i / 2 for i in range(n))))}
        assert sorted((str(r.date), r.value) for r in rows.where("site_id = '8'").collect()) == [("2021-01-01", 5.0), ("2021-01-02", None)]
        assert {(os.path.basename(r.file), r.reason) for r in bad.collect()} == {("payload_9.csv", "missing header marker"), ("payload_10.csv", "missing YEAR/DOY")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_parts_are_one_ordered_csv(spark, tmp_path, n):
    rows = [(i * 7919 % 100_003, f'name "{i}", é' if i % 3 else None, i / 4) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, `a, b` string, v double").repartition(5)
    out = str(tmp_path / "out")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = K.write_ordered_csv(df, out, ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    whole = b"".join(open(os.path.join(out, f), "rb").read() for f in parts)
    assert whole.startswith("﻿k,\"a, b\",v\n".encode()) and whole.count("﻿".encode()) == 1
    import csv
    import io
    got = list(csv.reader(io.StringIO(whole.decode("utf-8-sig"))))
    assert got[0] == ["k", "a, b", "v"] and [(int(k), a or None, float(v)) for k, a, v in got[1:]] == sorted(rows, key=lambda r: r[0])
    assert sum(r.n_rows for r in manifest) == n and all(r.part in parts for r in manifest)
    if n > 1:
        assert len([r for r in manifest if r.n_rows]) > 3
        firsts = [int(r.first.split(",")[0]) for r in sorted(manifest, key=lambda r: r.part)]
        assert firsts == sorted(firsts)


def test_one_year_is_rewritten(spark, tmp_path):
    out = str(tmp_path / "years")
    df = spark.range(3000).selectExpr("CAST(2000 + id % 3 AS INT) AS year", "lpad(CAST(id % 50 AS STRING), 7, '0') AS site_id", "CAST(id AS DOUBLE) AS value")
    K.rewrite_years(df, out)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, x in os.walk(out) for f in x if f.endswith(".parquet")}
    before = files()
    K.rewrite_years(df.where("year = 2001").withColumn("value", F.lit(-1.0)), out)
    after = files()
    same = {k for k in before if "year=2001" not in k}
    assert {k: after[k] for k in same} == {k: before[k] for k in same} and not any("year=2001" in k and k in before for k in after)
    got = {r.year: (r.n, r.s) for r in R.read_dekads(spark, out).groupBy("year").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert got[2001] == (1000, -1000.0) and got[2000] == (1000, sum(range(0, 3000, 3))) and len(got) == 3
    # sites stand in runs, so statistics of files and row groups prune
    import pyarrow.parquet as pq
    for f in after:
        sites = pq.read_table(f, partitioning=None).column("site_id").to_pylist()
        assert sites == sorted(sites)


def test_thin_roc_keeps_the_corners(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 2)), c, float(np.round(rng.random(), 2))) for _ in range(400) for c in range(2)]
    rows += [(1, 1, 2.0 + i / 100) for i in range(60)]  # a long straight run
    df = spark.createDataFrame(rows, "y_true int, cls int, score double")
    full, thin = ([(r.cls, r.threshold, r.tpr, r.fpr) for r in f(df).collect()] for f in (EV.roc_points, EV.roc_points_thin))
    assert set(thin) <= set(full) and len(thin) < len(full) - 50
    area = lambda pts, c: np.trapezoid(*zip(*[(t, f) for _, _, t, f in sorted((p for p in pts if p[0] == c), key=lambda p: -p[1])]))
    for c in (0, 1):
        assert area(thin, c) == pytest.approx(area(full, c), abs=1e-12)
        own = sorted((p for p in thin if p[0] == c), key=lambda p: -p[1])
        for (_, _, t0, f0), (_, _, t1, f1), (_, _, t2, f2) in zip(own[1:], own[2:], own[3:]):
            assert abs((t1 - t0) * (f2 - f1) - (t2 - t1) * (f1 - f0)) > 1e-12


def test_next_row_over_range_edges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame([(g, v * 3, v) for g in (None, 1, 2) for v in range(40 if g != 2 else 1)], "g int, v int, w int").repartition(4)
        got = {(r.g, r.v): r.w_next for r in RA.with_next(df, ["g"], "v", ["w"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == 81 and got[2, 0] is None
    assert all(got[g, v * 3] == (v + 1 if v < 39 else None) for g in (None, 1) for v in range(40))


def test_sql_functions_equal_the_columns(spark):
    from agroseries.functions import columns as C, formatting as FM
    SQL.install_functions(spark)
    days = spark.sql("SELECT explode(sequence(DATE'2019-12-25', DATE'2021-01-05')) AS d")
    bad = days.withColumns({"a": F.expr("agro_dekad(d)"), "b": C.dekad_of_day(F.dayofmonth("d")), "c": F.expr("agro_dekad36(d)"),
                            "e": C.dekad36(F.month("d"), C.dekad_of_day(F.dayofmonth("d"))), "f": F.expr("agro_doy_date(2021, dayofyear(d))"), "g": C.date_from_doy(F.lit(2021), F.dayofyear("d"))})
    assert bad.where("a <> b OR c <> e OR f <> g").count() == 0
    texts = spark.createDataFrame([(x,) for x in ["-", " - ", "..", "12", " 1.5e3 ", "", None, "x1", "-7", "0001234567", " 12 "]], "t string")
    got = texts.select("t", F.expr("agro_clean_number(t)").alias("a"), C.clean_number("t").alias("b"), F.expr("agro_site_code(t)").alias("c"), C.norm_code("t").alias("d"),
                       F.expr("agro_dekad_rule(t)").alias("e")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    numbers = spark.createDataFrame([(x,) for x in [0.0, -1234.5, 1e9, None, float("nan"), -999.0, 0.71, 0.4, -0.5]], "x double")
    got = numbers.select(F.expr("agro_br_number(x, 2)").alias("a"), FM.format_br("x", 2).alias("b"), F.expr("agro_observed(x)").alias("c"), C.sentinel_null("x").alias("d"),
                         F.expr("agro_strength(x)").alias("s"), "x").collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    assert [r.s for r in got if r.x in (0.71, 0.4, -0.5)] == ["strong", "weak", "moderate"]
    assert spark.sql("SELECT agro_loss_pct(0D, 1D) AS a, agro_loss_pct(4D, 1D) AS b, agro_in_season(1, 26) AS c, agro_in_season(2, 16) AS d, agro_pearson(2, 1D, 1D, 1D, 1D, 1D) AS r").first() == (0.0, 75.0, True, False, 1.0)
    assert "Python" not in spark.sql("SELECT agro_dekad(DATE'2020-01-01'), agro_clean_number('1')")._jdf.queryExecution().toString()
