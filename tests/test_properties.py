"""Cross-query invariants on the smallest driver tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_yearly_totals_add_up_to_kpi_total(spark, q):
    tot = q["kpi_summary"](spark, SF).filter("is_total").first()
    yearly = q["yearly_totals"](spark, SF).agg(F.sum("planted_ha").alias("p"), F.sum("produced_kg").alias("k")).first()
    assert tot.planted_ha == pytest.approx(yearly.p) and tot.produced_kg == pytest.approx(yearly.k, rel=1e-9)


def test_scores_sum_to_one(spark, q):
    s = q["inverse_distance_scores"](spark, SF).groupBy("vec_id").agg(F.sum("score").alias("s"))
    assert s.filter(F.abs(F.col("s") - 1) > 1e-5).count() == 0


def test_confusion_sums_to_n(spark, q):
    n = q["confusion"](spark, SF).agg(F.sum("n")).first()[0]
    assert n == q["quantile_classes"](spark, SF).count()
    rs = q["confusion"](spark, SF).groupBy("y_true").agg(F.sum("row_share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-5 for r in rs)


def test_dekad_sums_add_to_month_sums(spark):
    from agroseries import bindings as B
    from agroseries.operators import climate
    d = B.daily(spark, SF).filter(F.col("param") == "PREC_QTY")
    dek = climate.dekad_aggregate(d).groupBy("site_id", "year", "month").agg(F.sum("value").alias("a"))
    mon = (d.groupBy("site_id", F.year("date").alias("year"), F.month("date").alias("month"))
            .agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("b")))
    j = dek.join(mon, ["site_id", "year", "month"], "full")
    assert j.filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > 1e-6)).count() == 0


def test_season_rows_are_two_years_of_collapsed_rows(spark, q):
    s = q["season_pairs"](spark, SF)
    c = q["dekad36_mean"](spark, SF)
    valid = s.select("site_id", "season_year").distinct()
    y1 = c.join(valid.select("site_id", (F.col("season_year") - 1).alias("year")), ["site_id", "year"], "left_semi").count()
    y2 = c.join(valid.select("site_id", F.col("season_year").alias("year")), ["site_id", "year"], "left_semi").count()
    assert s.count() == y1 + y2


def test_exact_window_inside_substring_window(spark, q):
    ex = q["season_window_exact"](spark, SF)
    assert ex.filter(~(((F.col("rel_year") == 1) & F.col("dekad36").between(26, 36))
                       | ((F.col("rel_year") == 2) & F.col("dekad36").between(1, 15)))).count() == 0


def test_auc_in_unit_interval(spark, q):
    a = q["auc_ovr"](spark, SF).collect()
    assert all(0.0 <= r.auc <= 1.0 for r in a)


def test_kmeans_cost_not_above_any_single_restart(spark):
    from agroseries.operators import clustering as CL, features as FE
    from agroseries.plans import registry as RG
    long, _ = RG.mining_table(spark, SF)
    proj, explained, k = CL.pca_reduce(FE.site_vectors(long))
    cum = 0.0
    for e in explained:
        assert e >= 0
        cum += e
    assert cum <= 1 + 1e-9 and k >= min(5, len(explained))
    best, cost = CL.kmeans_best(proj, restarts=4, max_iter=50)
    single, c1 = CL.kmeans_best(proj, restarts=1, max_iter=50)
    assert cost <= c1 + 1e-9
