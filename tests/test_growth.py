"""Steps that once did their work again and again, or by the row where a key would do."""
import glob
import os


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_rules_are_matched_by_different_parameters(spark, tmp_path):
    """A filter on what the rules found stays above the generator, not in the scan's rows."""
    from agroseries.operators import rules as R
    rows = [("PREC_QTY",), ("PREC_QTY",), ("T_MAX",), (None,)]
    spark.createDataFrame(rows, "param string").write.parquet(str(tmp_path / "p"))
    found = R.conflicts(spark.read.parquet(str(tmp_path / "p")), spark.createDataFrame([("prec", "sum", 1), ("qty", "mean", 2)], R.RULE_SCHEMA))
    assert [(r["param"], r["n_rules"]) for r in found.collect()] == [("PREC_QTY", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan[:plan.index("Generate")] and "RLIKE" not in plan[plan.index("Generate"):]


def test_days_are_aggregated_once(spark, tmp_path):
    from agroseries.operators import climate, rules as R
    rows = [("1", "A", 0.0, 0.0, f"2000-01-0{d}", p, float(d)) for d in range(1, 6) for p in ("PREC_QTY", "T_MAX")]
    frame = spark.createDataFrame(rows, "site_id string, name string, lat double, lon double, date string, param string, value double")
    frame.selectExpr("* except (date)", "cast(date as date) as date").write.parquet(str(tmp_path / "days"))
    got = climate.dekad_aggregate(spark.read.parquet(str(tmp_path / "days")), R.default_rules(spark))
    assert {r["param"]: r["value"] for r in got.collect()} == {"PREC_QTY": 15.0, "T_MAX": 5.0}
    assert "FileScan" not in plan_of(got)


def test_daily_files_are_compressed_and_not_sorted(spark, tmp_path):
    from agroseries.sources import readers, sinks
    rows = [("0000001", "A, b", -1.5, 2.0, f"2000-01-{d:02}", float(d) if d % 7 else None, p) for d in range(1, 29) for p in ("X", "Y", "Z")]
    frame = spark.createDataFrame(rows, "site_id string, name string, lat double, lon double, date string, value double, param string").selectExpr("* except (date)", "cast(date as date) as date")
    path = str(tmp_path / "daily")
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    sinks.write_daily(frame, path)
    assert spark.conf.get(key) == before
    files = glob.glob(path + "/param=*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files) and len(os.listdir(path)) >= 3
    got = sorted((r["param"], str(r["date"]), r["value"], r["name"]) for r in readers.read_daily(spark, path).collect())
    assert got == sorted((r[6], r[4], r[5], r[1]) for r in rows)


def test_long_variables_shuffle_a_row_per_code(spark, monkeypatch):
    from agroseries.operators import production as P
    schema = "code string, name string, year int, raw string"
    a = spark.createDataFrame([("1", "A", y, str(y)) for y in range(2000, 2007)] + [("1", "A", 2000, "1"), (None, "B", None, "-"), ("2", "C", 2001, None)], schema)
    b = spark.createDataFrame([("1", "A", 2003, "5"), ("3", "D", 2009, ".."), (None, "B", None, "7")], schema)
    combine = lambda **k: P.combine_variables([("p", a), ("q", b)], sort=False, **k)
    plan = plan_of(combine())
    assert plan.count("Exchange hashpartitioning") == 1 and "year" not in plan[plan.index("Exchange hashpartitioning"):].split("\n")[0]
    rows = lambda d: sorted(map(str, d.collect()))
    few, raw = rows(combine()), rows(combine(missing_as_zero=False))
    assert len(few) == 10 and combine().schema["year"].dataType == a.schema["year"].dataType
    monkeypatch.setattr(P, "MOST_CELLS", 1)
    assert few == rows(combine()) and raw == rows(combine(missing_as_zero=False))
    assert P.combine_variables([("p", a.limit(0)), ("q", b.limit(0))]).collect() == []


def test_lines_are_parsed_once(spark, tmp_path):
    from agroseries.sources import readers
    lines = ["﻿site_id,name,lat,lon,date,value,param", '0000001,"A, ""b""",1,2,2000-01-01,5,X', "0000001,A,1,2,2000-13-01,5,X", ",A,1,2,2000-01-01,5,X", "1,A,x,2,2000-01-01,5,X",
             "1,A,1,2,2000-01-01", "1,A,1,2,2000-01-01,5,X,more", "", "1,A,1,2,2000-01-01,-999,X"]
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = readers.read_daily_checked(spark, str(tmp_path / "d.csv"))
    assert sorted((r["site_id"], r["name"], r["value"] if r["value"] is not None else "none") for r in good.collect()) == [("0000001", 'A, "b"', 5.0), ("1", "A", "none")]
    assert sorted((r["reason"], r["line"], r["file"] is None) for r in bad.collect()) == [
        ("fields 5 instead of 7", lines[5], False), ("fields 8 instead of 7", lines[6], False), ("missing site_id", lines[3], False),
        ("type of date", "0000001,A,1.0,2.0,2000-13-01,5.0,X", True), ("type of lat", lines[4], False)]
    for table in (good, bad):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def test_kmeans_tasks_grow_with_rows_not_with_shuffle_partitions(spark, monkeypatch):
    """Each fit runs some twenty jobs over the sites' partitions."""
    from pyspark.ml.linalg import Vectors
    from agroseries.operators import clustering as CL
    fitted = []

    class Fits(CL.KMeans):
        def fit(self, data):
            fitted.append(data.rdd.getNumPartitions())
            return super().fit(data)

    monkeypatch.setattr(CL, "KMeans", Fits)
    rows = [(f"{i:07}", Vectors.dense([float(i * 37 % 11), float(i * 53 % 7)])) for i in range(30)]
    sites = spark.createDataFrame(rows, ["site_id", "pca"])
    at = lambda n: CL.kmeans_best(sites.repartition(n, "site_id"), restarts=2, max_iter=20)
    (a, cost_a), (b, cost_b) = at(40), at(64)
    assert fitted == [CL.KMEANS_PARTITIONS] * 4
    assert cost_a == cost_b and [list(c) for c in a.clusterCenters()] == [list(c) for c in b.clusterCenters()]
    # no row is left out, few partitions stay as they came, and many rows keep more of them
    assert a.summary.cluster.count() == 30 and sum(a.summary.clusterSizes) == 30
    few = sites.repartition(5, "site_id").cache()
    assert CL.dealt_by_rows(few) is few
    monkeypatch.setattr(CL, "KMEANS_ROWS", 1)
    many = CL.dealt_by_rows(sites.repartition(64, "site_id").cache())
    assert many.rdd.getNumPartitions() == 30 and sorted(r.site_id for r in many.collect()) == [r[0] for r in rows]
    spark.catalog.clearCache()
