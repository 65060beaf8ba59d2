"""op11, op12 and op13 against plain loops over the same texts."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


# --- op11 -----------------------------------------------------------------------------
def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    """Least node reachable, for node -> neighbours."""
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += [y for y in linked(x) if y not in out]
    return out


def test_fingerprints_and_components(documents):
    from agroseries.llm import simhash
    rows = [(r["key"], r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(documents).collect()]
    own = [(r["doc_id"], plain_fingerprint(r["text"])) for r in documents.collect()]
    assert sorted(map(str, own)) == sorted(str((k, f)) for k, f, _ in rows)
    prints = {f for k, f in own if k is not None}
    same = plain_components(prints, lambda f: [g for g in prints if (f ^ g).bit_count() <= 4])
    least = {}
    for k, f in own:
        if k is not None:
            least[same[f]] = min(k, least.get(same[f], k))
    assert all(c == (None if k is None else least[same[f]]) for k, f, c in rows)
    assert len(set(c for _, _, c in rows)) < len(rows) - 8


@pytest.fixture(scope="module")
def prints(shipped):
    """Fingerprints with unbalanced, correlated bits, chains and a dense group."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) & rng.getrandbits(64) | 0xFF for _ in range(150)]
    base = [b | 0xFF000000 if b & 1 << 40 else b & ~0xFF000000 for b in base]
    out = set(base)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    for b in base[:40]:
        for n in (2, 3, 4, 4, 5, 6):
            out.add(b := flip(b, n))
    out |= {flip(base[0], rng.randrange(1, 4)) for _ in range(300)}
    out |= {0, 1, 3 << 62, 2**64 - 1, 2**64 - 2}
    frame = shipped.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in sorted(out)], "fp bigint").repartition(3)
    return frame, out


@pytest.mark.parametrize("thresholds", [None, [0, 0, 0, 0, 0], [1, 1, 0], [2, 1], [-1, 1, 0, 1], [0, -1, 0, 1, 0]])
def test_every_allotment_finds_every_link(prints, thresholds):
    from agroseries.llm import simhash
    frame, own = prints
    how = None
    if thresholds:
        bits = list(range(64))
        random.Random(2).shuffle(bits)
        cuts = [i * 64 // len(thresholds) for i in range(len(thresholds) + 1)]
        how = simhash.Plan([sorted(bits[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], thresholds)
        assert sum(t + 1 for t in thresholds) == simhash.RADIUS + 1
    found = {r["node"] % 2**64: r["component"] % 2**64 for r in simhash.link_components(frame, how=how, cell_size=64).collect()}
    same = plain_components(own, lambda f: [g for g in own if (f ^ g).bit_count() <= 4])
    groups = lambda m: {frozenset(x for x in own if m.get(x, x) == c) for c in {m.get(x, x) for x in own}}
    assert groups(found) == groups(same)


def test_thresholds_follow_the_costs(prints):
    from agroseries.llm import simhash
    plan = simhash.plan(prints[0])
    assert sorted(b for p in plan.bits for b in p) == list(range(64))
    assert sum(t + 1 for t in plan.thresholds) == simhash.RADIUS + 1
    # all allotments of three partitions, by trying them
    rng = random.Random(1)
    for _ in range(20):
        costs = [[rng.random() for _ in range(6)] for _ in range(3)]
        best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in ((a, b, 4 - 2 - a - b) for a in range(-1, 5) for b in range(-1, 5)) if -1 <= ts[2] <= 4)
        cost, chosen = simhash.allot(costs, 4)
        assert abs(cost - best) < 1e-12 and sum(t + 1 for t in chosen) == 5
    # a bit that is always the same goes with none; bits that are equal stand together
    agree = np.zeros((64, 64))
    agree[:8, :8] = 1
    np.fill_diagonal(agree, 0)
    assert simhash.grouped_bits(agree, 8)[0] == list(range(8))


def test_simhash_of_empty_and_long(shipped, empty):
    from agroseries.llm import simhash
    assert simhash.near_duplicates(empty).collect() == []
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(200_000))
    docs = shipped.createDataFrame([(3, long), (1, None), (2, " \n"), (7, long), (9, "x" * 3000)], "doc_id bigint, text string")
    got = {r["key"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == (0, 1) and got[3] == got[7] == (plain_fingerprint(long), 3) and got[9] == (plain_fingerprint("x" * 3000), 9)


# --- op12 -----------------------------------------------------------------------------
def plain_audit(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in sources:
            total.update(count[lang, s])
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


def test_source_divergence(shipped):
    from agroseries.llm import divergence
    rng = random.Random(3)
    words = ["a", "B", "été", "Zürich", "日本語", "x1y", "don't", "ÄÖ", "ſ", "K", "\U0001f600b"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["de", "en", None, ""]), rng.choice(["s0"] * 6 + [f"s{j}" for j in range(9)] + [None, "\U0001f600", "￿"])
        rows.append((lang, source, " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(0, 60)))))
    rows += [("fr", "only", "un deux"), ("it", "a", None), ("it", "b", "123 456"), ("it", "c", "uno"), rows[0], rows[0], ("en", "silent", None), ("en", "s0", "a " * 50_000)]
    docs = shipped.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, count int").repartition(4)
    expected = plain_audit(rows, 10, 10)
    for sizes in ({}, {"chunk_terms": 16, "in_block": 3}):
        got = [tuple(r) for r in divergence.audit(docs, **sizes).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(expected) and set(got) == expected
    assert ("it", "a", "pair", "b", 0, 1) in expected and not any(x[0] == "fr" for x in expected)


def test_shares_are_exact(shipped):
    from agroseries.llm import divergence
    cases = [(0, 2), (1, 3), (5, 10**15), (9 * 10**15 - 10, 9 * 10**15), (123_456_789_012, 987_654_321_098_765), (10**12, 10**12 + 2)]
    expected = [1 + 10**9 * (c + 2) // n for c, n in cases]
    frame = shipped.createDataFrame(cases, "c bigint, n bigint")
    from pyspark.sql import functions as F
    assert [r["p"] for r in frame.select("c", "n", divergence.share(F.col("c"), F.col("n")).alias("p")).collect()] == expected
    assert [int(divergence.shares(np.array([c]), n)[0]) for c, n in cases] == expected


def test_divergence_of_empty(empty):
    from agroseries.llm import divergence
    assert divergence.audit(empty).collect() == []


def test_order_shortens_the_columns(shipped):
    """Run boundaries are far fewer than terms when counts cluster."""
    from agroseries.llm import divergence
    rng = random.Random(4)
    rows = [("en", f"s{i % 5}", " ".join(f"{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnop" if rng.random() < 0.9 or i % 5 < 3)) for i in range(40)]
    docs = shipped.createDataFrame(rows, "lang string, source string, text string")
    kept = divergence.counted(docs, "lang", "source", "text", 1).cache()
    order = divergence.placed(kept, kept.groupBy("lang", "source").agg({"count": "sum"}).withColumnRenamed("sum(count)", "count"), 1 << 16)
    cells = kept.select("lang", "source", "term", "count").join(order, ["lang", "term"]).collect()
    columns = defaultdict(dict)
    for r in cells:
        columns[r["source"]][r["place"]] = r["count"]
    runs = {s: sum(1 for i in range(len(c)) if i == 0 or c.get(i, 0) != c.get(i - 1, 0)) for s, c in columns.items()}
    assert len(columns["s0"]) == 128 and all(runs[s] == 1 for s in ("s0", "s1", "s2")) and min(runs["s3"], runs["s4"]) <= 9


# --- op13 -----------------------------------------------------------------------------
def plain_fim(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units, size", [(2048, 64 << 10), (3, 7), (1, 1)])
def test_fill_in_middle(shipped, texts, monkeypatch, units, size):
    from agroseries.llm import fim
    monkeypatch.setattr(fim, "UNITS", units)
    monkeypatch.setattr(fim, "PIECE_BYTES", size)
    odd = ["<", "<P", "<S<P<M", "> <M > <", "a <P> b", "x<S>", "\x0b \x85 y", " lead", "trail \n", "word", "<<<>>>", "ä" * 40, "日本 語　x "]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts) if units > 1 or len(t or "") < 2000] + [(1000 + i, t) for i, t in enumerate(odd * 6)]
    rows += [(None, "no key at all here"), (None, "no key at all here"), (5, "five"), (5, "five"), (5, "other five"), (-7, "minus < seven > <")]
    docs = shipped.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id bigint, text string, form string, n int").repartition(3)
    got = fim.transform(docs, with_output=True).collect()
    make = lambda k, f: (str(k), f[0], f[1], f[2], f[3], f[4])
    assert sorted(map(repr, (make(k, plain_fim(k, t)) for k, t in rows))) == sorted(map(repr, (make(r["key"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got)))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert all(r["output_sha256"] == digest(r["output"]) for r in got)
    assert sorted(r["restored_sha256"] for r in got) == sorted(digest(t or "") for _, t in rows)
    assert {"plain", "spm", "psm"} == {r["form"] for r in got}


def test_restoration_reads_the_output(shipped):
    """Sections are found however the output is cut; nothing else tells where they are."""
    from agroseries.llm import fim
    out = b"<S>suf <P <S<P>pre>x<M>mid<"
    for size in (1, 2, 3, 5, 50):
        parts, found = fim.Sections("spm"), {1: b"", 2: b"", 3: b""}
        for i in range(0, len(out), size):
            for section, data in parts.feed(out[i : i + size]):
                found[section] += data
        for section, data in parts.end():
            found[section] += data
        assert found == {1: b"pre>x", 2: b"mid<", 3: b"suf <P <S"}


def test_fim_of_empty_and_one_shuffle(shipped, empty):
    from agroseries.llm import fim
    assert fim.transform(empty).collect() == []
    frame = fim.transform(shipped.range(30).selectExpr("id AS doc_id", "repeat('word ', 3000) AS text"))
    assert frame.count() == 30
    debug = frame.rdd.toDebugString().decode()
    assert debug.count("partitionBy") <= 1 or debug.count("ShuffledRDD") == 1
