"""Readers and writers on small files written by the tests themselves."""

import json

from agroseries.sources import readers as R, sinks as K


def test_attributes_bom_and_quoted_commas(spark, tmp_path):
    p = tmp_path / "attrs.csv"
    p.write_bytes("﻿Atributo,Descrição\n T2M ,\" Temperature, at 2 m \"\nRH2M,Humidity\n".encode("utf-8"))
    got = {r.code: r.description for r in R.read_attributes(spark, str(p)).collect()}
    assert got == {"T2M": "Temperature, at 2 m", "RH2M": "Humidity"}


def test_params_distinct_non_null(spark, tmp_path):
    p = tmp_path / "params.csv"
    p.write_text("Atributo\nT2M\n\nT2M\nRH2M\n")
    assert sorted(r.param for r in R.read_params(spark, str(p)).collect()) == ["RH2M", "T2M"]


def test_sites_json_array(spark, tmp_path):
    p = tmp_path / "sites.json"
    p.write_text(json.dumps([
        {"id": 4100103, "nome": "A", "microrregiao": {"mesorregiao": {"id": 4101, "nome": "North"}}},
        {"id": 12, "nome": "B", "microrregiao": None},
        {"id": 4100202, "nome": "C", "microrregiao": {"mesorregiao": {"id": 4102, "nome": "South"}}}]))
    got = [tuple(r) for r in R.read_sites(spark, str(p)).collect()]
    assert got == [("4100103", "A", 4101, "North"), ("4100202", "C", 4102, "South")]


def test_feature_collection(spark, tmp_path):
    from agroseries.operators import geo as G
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"codarea": "41"}, "geometry": {"type": "Point", "coordinates": [-50.0, -25.0]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
        {"type": "Feature", "properties": {"codarea": "42"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}}]}))
    b = R.read_boundaries(spark, str(p))
    got = {r.code: (r.c.lat, r.c.lon) for r in b.select("code", G.centroid("geom_type", "coords").alias("c")).collect()}
    assert got == {41: (-25.0, -50.0), 42: (0.5, 1.0)}


def test_payload_quarantine_and_rollover(spark, tmp_path):
    (tmp_path / "payload_1.csv").write_text("prose\n-END HEADER-\nYEAR,DOY,T2M\n2021,366,-999\n2020,60,1.5\n")
    (tmp_path / "payload_2.csv").write_text("prose without the marker\nYEAR,DOY,T2M\n")
    (tmp_path / "payload_3.csv").write_text("-END HEADER-\nMO,DY,T2M\n1,1,2\n")
    rows, q = R.read_point_payloads(spark, str(tmp_path))
    got = sorted((r.site_id, str(r.date), r.value) for r in rows.collect())
    assert got == [("1", "2020-02-29", 1.5), ("1", "2022-01-01", -999.0)]
    assert sorted((r.file.rsplit("/", 1)[-1], r.reason) for r in q.collect()) == [
        ("payload_2.csv", "missing header marker"), ("payload_3.csv", "missing YEAR/DOY")]


def test_fixed_digits_matches_c_printf(spark):
    df = spark.createDataFrame([(0.04625,), (1234567.5,), (None,), (-0.00005,)], "v double")
    got = [r.v for r in K.fixed_digits(df, 4).collect()]
    assert got == ["%.4f" % 0.04625, "%.4f" % 1234567.5, None, "%.4f" % -0.00005]
