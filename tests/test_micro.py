"""Hand-written micro-fixtures per operator (expected values from the documented semantics)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroseries.functions import columns as C
from agroseries.functions.formatting import format_br, format_scaled
from agroseries.operators import analysis, climate, evaluation as EV, features as FE, geo as G
from agroseries.operators import production as PR, quality as Q


def daily_df(spark, rows):
    return spark.createDataFrame(
        rows, "site_id string, name string, lat double, lon double, date date, param string, value double")


# 1. dekad edges
def test_dekad_edges(spark):
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 10), dt.date(2020, 1, 11), dt.date(2020, 1, 20),
            dt.date(2020, 1, 21), dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = [(r.dekad, r.d36) for r in C.with_dekad(df).withColumn("d36", C.dekad36("month", "dekad")).collect()]
    assert got == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3), (3, 6), (3, 36)]


# 2. all-missing group per rule
def test_all_missing_groups(spark):
    d = dt.date(2020, 1, 5)
    rows = [("1", "A", 0.0, 0.0, d, p, None) for p in ["PRECTOT", "T2M_MAX", "T2M_MIN", "T2M_RANGE", "RH2M", "PREC_PROB", "EVT_COUNT"]]
    rows.append(("1", "A", 0.0, 0.0, d, "RH2M", float("nan")))
    out = {r.param: r.value for r in climate.dekad_aggregate(daily_df(spark, rows)).collect()}
    assert out == {"PRECTOT": 0.0, "EVT_COUNT": 0.0}


def test_rules_and_range(spark):
    rows = [("1", "A", 0.0, 0.0, dt.date(2020, 1, day), p, v)
            for day, v in [(1, 1.0), (2, 4.0), (3, 2.5)]
            for p in ["PRECTOT", "T2M_MAX", "T2M_MIN", "T2M_RANGE", "RH2M", "PREC_PROB", "EVT_COUNT"]]
    rows.append(("1", "A", 0.0, 0.0, dt.date(2020, 1, 4), "RH2M", -999.0))
    df = daily_df(spark, rows).withColumn("value", C.sentinel_null("value"))
    out = {r.param: r.value for r in climate.dekad_aggregate(df).collect()}
    assert out == {"PRECTOT": 7.5, "T2M_MAX": 4.0, "T2M_MIN": 1.0, "T2M_RANGE": 3.0, "RH2M": 2.5,
                   "PREC_PROB": 2.5, "EVT_COUNT": 7.5}


# 3. seasons need both years; the first year is never a season
def test_season_pairing(spark):
    rows = [("1", "A", 0.0, 0.0, dt.date(y, 3, 5), "RH2M", float(y)) for y in (2017, 2018, 2020)]
    s = climate.season_table(daily_df(spark, rows)).collect()
    assert {(r.season_year, r.rel_year, r.value) for r in s} == {(2018, 1, 2017.0), (2018, 2, 2018.0)}


# 4. window modes
def test_season_window_modes(spark):
    rows = [("1", "A", 2018, rel, d, "RH2M", 1.0) for rel in (1, 2) for d in range(1, 37)]
    df = spark.createDataFrame(rows, "site_id string, name string, season_year int, rel_year int, dekad36 int, param string, value double")
    exact = climate.season_window(df, exact=True)
    sub = climate.season_window(df, exact=False)
    assert exact.count() == 26 and sub.count() == 47
    assert exact.join(sub, ["rel_year", "dekad36"], "left_anti").count() == 0


# 5. correlation: constant feature, 5 pairs, 6 pairs
def test_correlation_pairs(spark):
    season_rows, panel_rows = [], []
    for i in range(6):
        season_rows += [("s%d" % i, "n", 2000, 1, 30, "CONST", 1.0), ("s%d" % i, "n", 2000, 1, 31, "VAR", float(i * i))]
        if i < 5:
            season_rows.append(("s%d" % i, "n", 2000, 1, 32, "FIVE", float(i)))
        panel_rows.append(("s%d" % i, 2000, float(i)))
    s = spark.createDataFrame(season_rows, "site_id string, name string, season_year int, rel_year int, dekad36 int, param string, value double")
    p = spark.createDataFrame(panel_rows, "site_id string, year int, y double")
    got = {r.param: r.r for r in analysis.climate_correlations(s, p, "y").collect()}
    assert set(got) == {"VAR"}
    assert got["VAR"] == pytest.approx(np.corrcoef([i * i for i in range(6)], range(6))[0, 1])


# 6. duplicate right key must fail
def test_duplicate_key_join_fails(spark):
    from agroseries.operators import panel as P
    prod = spark.createDataFrame([("1", 2000, 1.0)], "site_id string, year int, planted_ha double")
    sites = spark.createDataFrame([("1", 1, "R", 0.0, 0.0), ("1", 1, "R", 0.0, 0.0)],
                                  "site_id string, region_id int, region string, lat double, lon double")
    with pytest.raises(Q.ExpectationError):
        P.join_geo(prod, sites)


# 7. quartile edges: right-closed, lowest included; duplicate edges raise
def test_quartile_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9]], "x double")
    edges = FE.quartile_edges(df, "x")
    assert edges == [1.0, 3.0, 5.0, 7.0, 9.0]
    got = [r.y_true for r in FE.quantile_classes(df, "x").orderBy("x").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 3, 3]
    dup = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "x double")
    with pytest.raises(FE.DuplicateEdgesError):
        FE.quartile_edges(dup, "x")


# 8. AUC with ties vs brute force; a class never predicted has precision 0
def brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l]
    neg = [s for l, s in zip(labels, scores) if not l]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_and_roc(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200), 1)  # many ties
    df = spark.createDataFrame([(int(a), 1, float(b)) for a, b in zip(y, s)], "y_true int, cls int, score double")
    a = EV.auc_ovr(df, "y_true", "cls", "score").collect()[0]
    assert a.auc == pytest.approx(brute_auc(list(y == 1), list(s)))
    neg = df.withColumn("score", -F.col("score"))
    a2 = EV.auc_ovr(neg, "y_true", "cls", "score").collect()[0].auc
    assert a2 == pytest.approx(1 - brute_auc(list(y == 1), list(s)))
    roc = {r.threshold: (r.tpr, r.fpr) for r in EV.roc_points(df, "y_true", "cls", "score").collect()}
    t = 0.5
    tp = sum(1 for a, b in zip(y, s) if a == 1 and b >= t) / sum(y == 1)
    fp = sum(1 for a, b in zip(y, s) if a == 0 and b >= t) / sum(y == 0)
    assert roc[t] == pytest.approx((tp, fp))


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (2, 2)], "y_true int, y_pred int")
    m = {r.cls: r for r in EV.class_metrics(df).collect()}
    assert m[1].precision == 0.0 and m[1].recall == 0.0 and m[1].f1 == 0.0
    assert m[0].precision == 0.5 and m[0].recall == 1.0
    assert m[0].specificity == pytest.approx(2 / 3)
    s = EV.summary_metrics(EV.class_metrics(df)).collect()[0]
    assert s.accuracy == 0.75


def test_alignment_not_worse_than_identity(spark):
    rows = [(t, (t + 1) % 4) for t in range(4) for _ in range(5)] + [(0, 0)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    al = EV.align_labels(df, "y_true", "y_pred", "y_al")
    acc = al.filter("y_true = y_al").count()
    assert acc >= df.filter("y_true = y_pred").count() and acc == 20


# 9. polygon: interior, exterior, concave notch, border
def test_point_in_polygon(spark):
    # a "U": square 0..4 with a notch x in (1,3), y in (2,4)
    ring = [(0, 0), (4, 0), (4, 4), (3, 4), (3, 2), (1, 2), (1, 4), (0, 4), (0, 0)]
    verts = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(ring)],
                                  "ring_id int, seq int, x double, y double")
    edges = G.ring_edges(verts)
    pts = spark.createDataFrame([(0.5, 0.5), (2.0, 3.0), (5.0, 1.0), (2.0, 1.0), (0.0, 2.0), (3.5, 3.5)], "x double, y double")
    got = {(r.x, r.y): (r.inside, r.on_border) for r in G.point_in_polygon(pts, edges).collect()}
    assert got[(0.5, 0.5)][0] and got[(2.0, 1.0)][0] and got[(3.5, 3.5)][0]
    assert not got[(2.0, 3.0)][0] and not got[(5.0, 1.0)][0]
    assert got[(0.0, 2.0)][1]
    masked = {(r.x, r.y): r.inside for r in G.mask_grid(pts, edges).collect()}
    assert masked[(0.0, 2.0)] is False
    clipped = {(r.x, r.y) for r in G.clip_points(pts, edges, "x", "y").collect()}
    assert (0.0, 2.0) in clipped and (2.0, 3.0) not in clipped


def test_grid_and_surfaces(spark):
    g = G.make_grid(spark, (0.0, 0.0, 0.1, 0.05), 0.02)
    assert g.count() == 5 * 3
    st = spark.createDataFrame([(0.0, 0.0, 1.0), (0.1, 0.0, 4.0), (0.0, 0.05, 2.0), (0.1, 0.05, 3.0)], "lon double, lat double, z double")
    idw = {(r.i, r.j): r.z for r in G.idw_surface(g, st).collect()}
    assert idw[(0, 0)] == 1.0 and len(idw) == 15


def test_centroid_types(spark):
    df = spark.createDataFrame([
        ("Point", "[-50.1234567, -25.5]"),
        ("Polygon", "[[[0,0],[2,0],[2,2],[0,2],[0,0]],[[0.5,0.5],[1,0.5],[1,1],[0.5,0.5]]]"),
        ("MultiPolygon", "[[[[0,0],[1,0],[0,0]]],[[[4,4],[5,4],[4,4]]]]"),
        ("LineString", "[[0,0],[1,1]]")], "t string, c string")
    got = [(r.c.lat, r.c.lon) for r in df.select(G.centroid("t", "c").alias("c")).collect()]
    assert got[0] == (-25.5, -50.123457)
    assert got[1] == (0.8, 0.8)  # closing vertex counted twice (D8)
    assert got[2] == (2.0, round((0 + 1 + 0 + 4 + 5 + 4) / 6, 6))
    assert got[3] == (None, None)


# 10. crosstab cells
def test_clean_cells(spark):
    df = spark.createDataFrame([("-",), (" - ",), ("..",), (None,), ("12",), ("abc",)], "raw string")
    assert [r.v for r in df.select(C.clean_number("raw").alias("v")).collect()] == [0.0, 0.0, 0.0, 0.0, 12.0, 0.0]


def test_combine_variables_outer(spark):
    a = spark.createDataFrame([("1", "A", 2018, "5"), ("2", "B", 2018, "-")], "code string, name string, year int, raw string")
    b = spark.createDataFrame([("1", "A", 2019, "..")], "code string, name string, year int, raw string")
    out = {(r.code, r.year): (r.v1, r.v2) for r in PR.combine_variables([("v1", a), ("v2", b)]).collect()}
    assert out == {("1", 2018): (5.0, 0.0), ("2", 2018): (0.0, 0.0), ("1", 2019): (0.0, 0.0)}


# scalar traps
def test_doy_rollover_and_code_padding(spark):
    df = spark.createDataFrame([(2021, 366, " 123 "), (2020, 366, "12345678")], "y int, d int, c string")
    r = df.select(C.date_from_doy("y", "d").alias("dt"), C.norm_code("c").alias("code")).collect()
    assert r[0].dt == dt.date(2022, 1, 1) and r[1].dt == dt.date(2020, 12, 31)
    assert r[0].code == "0000123" and r[1].code == "12345678"


def py_br(v, d=0, prefix="", suffix=""):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    s = f"{v:,.{d}f}".replace(",", "X").replace(".", ",").replace("X", ".")
    return f"{prefix}{s}{suffix}".strip()


def py_scaled(v, prefix="", suffix=""):
    a = abs(v)
    sign = "- " if v < 0 else ""
    for th, div, unit in [(1e9, 1e9, " bi"), (1e6, 1e6, " mi"), (1e4, 1e3, " mil")]:
        if a >= th:
            s = f"{a / div:,.2f}".replace(",", "X").replace(".", ",").replace("X", ".")
            return f"{sign}{prefix}{s}{unit}{suffix}".strip()
    return py_br(v, 0, f"{sign}{prefix}", suffix)


def test_formatting(spark):
    vals = [1234.5, -0.125, 9999.5, 12345.678, -2.5e6, 3.2e9, None, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    rows = df.select(format_br("v", 2, "R$ ", "").alias("a"), format_scaled("v", "", " ha").alias("b")).collect()
    for v, r in zip(vals, rows):
        assert r.a == py_br(v, 2, "R$ ")
        if v is not None:
            assert r.b == py_scaled(v, "", " ha")


def test_kpi_delta_zero_base(spark):
    t = spark.createDataFrame([(2018, 0.0, 0.0, 0.0, 0.0, 0.0), (2019, 10.0, 5.0, 0.0, 3.0, 1.0)],
                              "year int, planted_ha double, harvested_ha double, lost_ha double, produced_kg double, value_brl double")
    d = {r.measure: (r.delta_kind, r.delta_text) for r in PR.kpi_delta(t).collect()}
    assert d["planted_ha"] == ("abs", "+ 10 ha")
    assert d["lost_ha"] == ("zero", "= 0")
    assert d["yield_kg_ha"][0] == "none"


def test_combine_crosstabs_equals_long_form(spark):
    a = spark.createDataFrame([("1", "A", "5", "-"), ("2", "B", "..", "7"), (None, None, "x", "y")],
                              "code string, name string, `2018` string, `2019` string")
    b = spark.createDataFrame([("1", "A", "3"), ("3", "C", None)], "code string, name string, `2018` string")
    wide = PR.combine_crosstabs([("v1", a), ("v2", b)], [2018, 2019])
    longs = [("v1", PR.unpivot_years(a, [2018, 2019])), ("v2", PR.unpivot_years(b, [2018, 2019]))]
    lng = PR.combine_variables(longs, sort=False)
    as_set = lambda df: sorted(tuple(r) for r in df.select("code", "name", "year", "v1", "v2").collect())
    assert as_set(wide) == as_set(lng)
    assert ("2", "B", 2019, 7.0, 0.0) in as_set(wide) and ("3", "C", 2018, 0.0, 0.0) in as_set(wide)


def brute_inside(px, py, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_band_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    ang = np.sort(rng.random(12) * 2 * np.pi)
    rad = 1 + rng.random(12) * 2
    ring = [(float(r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(ang, rad)]
    ring.append(ring[0])
    verts = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(ring)], "ring_id int, seq int, x double, y double")
    pts = [(float(x), float(y)) for x, y in rng.uniform(-3.5, 3.5, size=(400, 2))]
    df = spark.createDataFrame(pts, "x double, y double")
    for bands in (1, 7, 64):
        got = {(r.x, r.y): r.inside for r in G.point_in_polygon(df, G.ring_edges(verts), n_bands=bands).collect()}
        assert all(got[p] == brute_inside(p[0], p[1], ring) for p in pts)


def test_roc_ranges_match_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 3)), c, float(np.round(rng.random(), 2))) for _ in range(300) for c in range(3)]
    df = spark.createDataFrame(rows, "y_true int, cls int, score double")
    roc = {(r.cls, r.threshold): (r.tpr, r.fpr) for r in EV.roc_points(df).collect()}
    for (c, t), (tpr, fpr) in list(roc.items())[:40]:
        pos = [s for y, k, s in rows if k == c and y == c]
        neg = [s for y, k, s in rows if k == c and y != c]
        assert tpr == pytest.approx(sum(s >= t for s in pos) / len(pos))
        assert fpr == pytest.approx(sum(s >= t for s in neg) / len(neg))
