"""Cases that ordinary files hold: wide and padded sheets, odd numbers, accents,
missing keys, zero cells, unbounded labels."""
import itertools
import random
import re
import unicodedata

import pytest


def sheet(folder, name, lines):
    path = folder / f"sheet={name}"
    path.mkdir(parents=True)
    (path / "part.csv").write_text("\n".join(lines), encoding="utf-8")


def test_production_sheets(spark, tmp_path):
    from agroseries.sources import readers
    years = list(range(1974, 2025))
    pad = "," * len(years)
    sheet(tmp_path, "Tabela 1", [
        f"Produção{pad},", f"Variável - Área plantada (Hectares){pad},", "Cód.,Município,Ano" + "," * (len(years) - 1), ",," + ",".join(map(str, years)),
        '"0001","Town, first",' + ",".join(str(y * 10) for y in years), '2,"Two\nlines",' + ",".join(["-"] * 45 + ["..", "NaN", "1d", "3f", " 7 ", ""]), f"Fonte: x{pad},"])
    sheet(tmp_path, "tabela 2", ["t", "Outra", "Cód.,Município,2024", ",,", "1,A,5"])
    sheet(tmp_path, "Tabela 3", ["t", "Variável - None", "Cód.,Município,Total", ",,", "1,A,5"])
    sheet(tmp_path, "Notas", ["t", "Variável - Notes", "Cód.,Município,2024", ",,", "1,A,5"])
    got = {(r["variable"], r["code"], r["year"]): r["value"] for r in readers.read_production(spark, str(tmp_path), range(2018, 2025)).collect()}
    area = "Área plantada (Hectares)"
    assert {k: v for k, v in got.items() if k[1] == "0001"} == {(area, "0001", y): y * 10.0 for y in range(2018, 2025)}
    assert [got[area, "2", y] for y in range(2018, 2025)] == [0, 0, 0, 0, 0, 7, 0]
    assert got["Outra", "1", 2024] == 5 and len(got) == 15


def test_clean_number(spark):
    from agroseries.functions.columns import clean_number
    cells = {"NaN": 0, "nan": 0, "1d": 0, "3f": 0, " - ": 0, "..": 0, "1e3": 1000, "-4.5": -4.5, "+2": 2, ".5": 0.5, "5.": 5, "Infinity": 0, None: 0}
    got = spark.createDataFrame([(c,) for c in cells], "c string").select("c", clean_number("c").alias("v")).collect()
    assert {r["c"]: r["v"] for r in got} == cells


def test_ascii_safe(spark):
    from agroseries.functions.columns import ascii_safe
    rng = random.Random(1)
    texts = ["Nº 3ª", "Škoda őř", "ﬁm", "São João d'Água", "½ km ™ 𝐀𝐁 ㎞", "straße", "", None] + ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x1E00, 0x2200), rng.randrange(0xFB00, 0xFB07), 0x1D400))) for _ in range(20)) for _ in range(80)]

    def plain(t):
        return None if t is None else re.sub(r"[^\w\-]", "_", unicodedata.normalize("NFKD", t).encode("ASCII", "ignore").decode())

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ascii_safe("t").alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_combine_with_missing_and_repeated_codes(spark):
    from agroseries.operators import production as P
    a = spark.createDataFrame([(None, "A", "1", "x"), ("2", "B", "5", "-"), ("2", "B", "6", None), ("3", None, "9", "9")], "code string, name string, `2000` string, `2001` string")
    b = spark.createDataFrame([(None, "A", "2"), ("4", "D", "7")], "code string, name string, `2000` string")
    wide = P.combine_crosstabs([("p", a), ("q", b)], [2000, 2001])
    long = P.combine_variables([("p", P.unpivot_years(a, [2000, 2001])), ("q", P.unpivot_years(b, [2000, 2001]))], sort=False)
    rows = lambda d: sorted(map(str, d.select("code", "name", "year", "p", "q").collect()))
    assert rows(wide) == rows(long)
    got = {(r["code"], r["year"]): (r["p"], r["q"]) for r in wide.collect()}
    assert got == {(None, 2000): (1, 2), (None, 2001): (0, 0), ("2", 2000): (11, 0), ("2", 2001): (0, 0), ("4", 2000): (0, 7)}
    plan = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_kpi_total_is_one_row(spark):
    from agroseries.operators import production as P
    rows = [(y, 1.0, 1.0, 0.0, 1.0, 1.0) for y in (2000, 2001, None)]
    panel = spark.createDataFrame(rows, "year int, planted_ha double, harvested_ha double, lost_ha double, produced_kg double, value_brl double")
    got = P.kpi_summary(panel).collect()
    assert len(got) == 4 and [r["planted_ha"] for r in got if r["is_total"]] == [3.0]


def test_quantiles_and_prefix_sums(spark):
    import numpy as np
    from agroseries.operators import ranges
    rng = random.Random(8)
    rows = [(g, rng.choice((None, rng.randrange(7), rng.random()))) for g in ("a", "b", None) for _ in range(151)] + [("one", 3.0), ("none", None)]
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    probs = [0, 0.25, 0.5, 0.9, 1]
    got = {r["g"]: r["q"] for r in ranges.quantiles(frame, ["g"], "v", probs).collect()}
    for g in ("a", "b", None, "one"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], probs))
    assert "none" not in got


def test_assignment(spark):
    from agroseries.operators import evaluation as E
    rng = random.Random(3)
    for k in (1, 2, 3, 4, 5):
        for _ in range(30):
            counts = {(t, p): rng.randrange(4) for t in range(k) for p in range(k)}
            scored = [(sum(counts[perm[i], i] for i in range(k)), perm) for perm in itertools.permutations(range(k))]
            best = max(s for s, _ in scored)
            first = min(p for s, p in scored if s == best)
            assert E.best_alignment(counts, list(range(k))) == dict(enumerate(first))
    big = E.best_alignment({(i, (i * 7) % 30): 5 for i in range(30)}, list(range(30)))
    assert all(big[(i * 7) % 30] == i for i in range(30))
    frame = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 0), (1, None), (2, 2)], "y_true int, y_pred int")
    assert [r["y_aligned"] for r in E.align_labels(frame).collect()] == [0, 0, 1, 1, None, 2]
    assert E.align_labels(frame.limit(0)).collect() == []
    full = {(r["y_true"], r["y_pred"]): r["n"] for r in E.confusion(frame).collect()}
    assert len(full) == 9 and sum(full.values()) == 4 and full[0, 0] == 0


def test_roc_starts_at_zero(spark):
    from agroseries.operators import evaluation as E
    frame = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.9), (0, 1, 0.1), (1, 1, 0.5)], "y_true int, cls int, score double")
    points = {r["threshold"]: (r["tpr"], r["fpr"]) for r in E.roc_points(frame).collect()}
    assert points == {float("inf"): (0, 0), 0.9: (0.5, 0.5), 0.5: (1, 0.5), 0.1: (1, 1)}
    best = E.youden(E.roc_points(frame)).first()
    assert (best["threshold"], best["youden_j"]) == (0.5, 0.5)


def test_strict_readers(spark, tmp_path):
    from agroseries.sources import readers
    schema = spark.createDataFrame([], "a int, b string").schema
    (tmp_path / "good.csv").write_text("a,b\n1,x\n")
    (tmp_path / "names.csv").write_text("b,a\nx,1\n")
    (tmp_path / "types.csv").write_text("a,b\none,x\n")
    assert readers.read_csv(spark, str(tmp_path / "good.csv"), schema).collect()[0]["a"] == 1
    for bad in ("names", "types"):
        with pytest.raises(Exception, match="(?i)schema|malformed"):
            readers.read_csv(spark, str(tmp_path / f"{bad}.csv"), schema).collect()


def test_expect_complete_fails(spark):
    from agroseries.operators import quality as Q
    frame = spark.createDataFrame([("1", 2.0, 3.0), ("2", None, 1.0)], "site_id string, lat double, lon double")
    with pytest.raises(Q.ExpectationError):
        Q.expect_complete(frame)
    with pytest.raises(Q.ExpectationError):
        Q.expect_complete(frame.dropna(), n_fields=4)
    assert Q.expect_complete(frame.dropna(), n_fields=3).count() == 1


def test_idw_any_number_of_stations(spark, monkeypatch):
    from agroseries.operators import geo
    rng = random.Random(2)
    stations = [(rng.random(), rng.random(), float(rng.randrange(1, 5))) for _ in range(50)]
    frame = spark.createDataFrame([*stations, (None, 1.0, 1.0)], "lon double, lat double, z double")
    monkeypatch.setattr(geo, "STATION_BLOCK", 3)
    grid = spark.createDataFrame([(0, 0, 0.5, 0.5), (1, 0, stations[4][0], stations[4][1])], "i long, j long, x double, y double")
    got = {r["i"]: r["z"] for r in geo.idw_surface(grid, frame).collect()}
    d = [(z, (x - 0.5) ** 2 + (y - 0.5) ** 2) for x, y, z in stations]
    assert abs(got[0] - sum(z / q for z, q in d) / sum(1 / q for _, q in d)) < 1e-9 and got[1] == stations[4][2]


def test_checkpoint_folder_is_shared(spark, monkeypatch):
    from types import SimpleNamespace
    from agroseries import session
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(cluster)
