"""op3, op6, op8, op9, op10."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").translate(LOWER).encode().split()


def test_top_k(shipped, monkeypatch):
    from agroseries.llm import topk
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1.0, -0.25, 0.0, 0.3, 2.0)) for _ in range(10)], "x") for i in range(200)]
    rows += [(300 + i, rows[7][1], "x") for i in range(30)]          # copies: ties
    rows += [rows[3], (401, None, ""), (402, [], ""), (403, [None] * 10, ""), (404, [float("nan")] * 10, ""), (450, [float("inf")] * 10, ""), (None, rows[0][1], ""), (500, [1.0] * 3, ""), (501, [2.0] * 3, "")]
    frame = shipped.createDataFrame(rows, "vec_id bigint, embedding array<float>, vector string")
    monkeypatch.setattr(topk, "VECTORS_IN_CELL", 64)
    monkeypatch.setattr(topk, "QUERIES_IN_CELL", 2)
    got = [tuple(r) for r in topk.top_k(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    use = {k: np.floor(256 * np.array(v, np.float32).astype(float)) for k, v, _ in rows if k is not None and v and k not in (403, 404, 450)}
    want = []
    for q in sorted(k for k in use if k % 50 == 0):
        best = sorted(((-int(use[q] @ x), k) for k, x in use.items() if k != q and len(x) == len(use[q])))[:5]
        want += [(q, i + 1, k, float(-s)) for i, (s, k) in enumerate(best)]
    assert got == want
    assert topk.top_k(frame.limit(0), F.col("id") % 50 == 0).collect() == []


def test_top_k_leaves_pairs_out():
    """Products of clustered vectors: a small part of all pairs, and the right ones;
    floors that are met leave the results as they are."""
    from agroseries.llm import topk
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = np.floor(256 * (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 64))))
    x[17], x[5000:5020], x[30] = x[50], x[100], 0
    ids = np.arange(6000) * 2
    queries = np.flatnonzero(ids % 50 == 0)
    every = x[queries] @ x.T
    every[np.arange(len(queries)), queries] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, every.shape), -every), axis=1)[:, :5]
    fifth = np.take_along_axis(every, want[:, 4:], axis=1)[:, 0]
    for floors in (None, fifth):
        place, found, score, products = topk.search(x, ids, x[queries], ids[queries], 5, (1, 4, 16), floors)
        assert (found.reshape(-1, 5) == ids[want]).all() and (score.reshape(-1, 5) == np.take_along_axis(every, want, axis=1)).all()
        assert len(queries) * 5 <= products < 0.3 * every.size
    assert not len(topk.search(x, ids, x[queries], ids[queries], 5, (1, 4, 16), fifth + 1e9)[0])


def test_decontaminate(shipped, empty):
    from agroseries.llm import decontam
    rng = random.Random(4)
    line = lambda n: [f"t{rng.randrange(300)}" for _ in range(n)]
    items = [(i, line(n)) for i, n in enumerate((3, 4, 5, 12, 40, 40, 41))] + [(7, [])]
    rows = []
    for i, (k, w) in enumerate(items):
        rows.append((10 * i, line(30) + w + line(30)))
        rows.append((10 * i + 1, w))
        if len(w) >= 40:
            near, far = list(w), list(w)
            near[0] = "new"
            for j in range(0, len(far), 6):
                far[j] = "new"
            rows += [(10 * i + 2, line(9) + [x.upper() for x in near] + line(5) + w), (10 * i + 3, line(9) + far)]
    docs = [(k, "\t".join(w), 1) for k, w in rows] + [(900, None, 1), (901, "", 1), (None, " ".join(items[4][1]), 1), (902, "x " * 5000, 1)]
    docs = shipped.createDataFrame(docs, "doc_id bigint, text string, item int")
    bench = shipped.createDataFrame([(k, " ".join(w)) for k, w in items] + [(8, None)], "item_id bigint, text string")

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    want = set()
    for r in docs.collect():
        w = words(r["text"])
        for k, item in items:
            c = grams([x.encode() for x in item])
            for s in range(len(w) - len(item) + 1 if item else 0):
                d = grams(w[s : s + len(item)])
                if 100 * sum((c & d).values()) >= 75 * sum((c | d).values()):
                    want.add((r["doc_id"], k))
    got = decontam.matches(docs, bench).collect()
    assert {(r["key"], r["item"]) for r in got} == want and len(want) > 12
    assert sum(r["key"] == 42 for r in got) == 2 and all(0.75 <= r["similarity"] <= 1 for r in got)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - {k for k, _ in want}
    assert decontam.matches(docs, bench.limit(0)).collect() == [] and decontam.matches(empty, bench).collect() == []
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()


def test_decontaminate_documents_shorter_than_the_item(shipped):
    from agroseries.llm import decontam
    rng = random.Random(9)
    line = lambda n, of=300: [f"t{rng.randrange(of)}" for _ in range(n)]
    items = [line(40), line(40), line(41), line(12), line(5), line(200), ["x", "y"] * 30, line(30, 2)]
    rows = []
    for w in items:
        rows += [w[:-1], w[1:], w[:-3], w[2:-2], w[: len(w) * 3 // 4], w[: len(w) * 4 // 5 + 1], [*w[:5], "new", *w[6:-1]], [*w[:-2], "new"][1:], w[:4], w[:-1] + line(30)]
    docs = shipped.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    bench = shipped.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    want = {}
    for i, w in enumerate(rows):
        for k, item in enumerate(items):
            a, b = grams(w), grams(item)
            if len(w) < len(item) and 100 * sum((a & b).values()) >= 75 * sum((a | b).values()):
                want[i, k] = (0, len(w), sum((a & b).values()) / sum((a | b).values()))
    got = {(r["key"], r["item"]): (r["start"], r["n_words"], r["similarity"]) for r in decontam.matches(docs, bench).collect()}
    assert {p: v for p, v in got.items() if len(rows[p[0]]) < len(items[p[1]])} == want and (0, 0) in want and len(want) > 20
    assert not {r["doc_id"] for r in decontam.clean(docs, bench).collect()} & {i for i, _ in want}


def test_near_values_finds_all():
    from agroseries.llm import decontam
    near = decontam.near_values(np.array([0, 0xF0F0], np.uint16), 3)
    bits = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
    far = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16) ^ np.uint16(0xF0F0))
    assert (near == ((bits <= 3) | (far <= 3))).all()


def test_pitman_yor(documents, empty):
    from agroseries.llm import pitmanyor
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    scores, shared = pitmanyor.score(documents, learn)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    learned = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 != 2
    count = Counter(x for k, t in rows if learned(k) for x in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert (shared.tokens, shared.vocabulary) == (n, v)
    got = sorted((r["key"] is not None, r["key"] or 0, r["n_tokens"], r["n_known"], r["learned"], round(r["base_score"], 6)) for r in scores.collect())
    want = sorted((k is not None, k or 0, len(words(t)) + 1, sum(count[x] > 0 for x in [*words(t), None]), learned(k),
                   round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*words(t), None]), 6)) for k, t in rows)
    assert got == want
    assert scores.agg(F.sum("score") > F.sum("base_score")).first()[0] and scores.agg(F.max("score") <= 0).first()[0]
    assert pitmanyor.score(empty, learn)[0].collect() == []
    none, _ = pitmanyor.score(documents, F.lit(False))
    assert none.count() == documents.count() and none.agg(F.max("n_known")).first()[0] == 0


def test_pitman_yor_uses_contexts(shipped):
    from agroseries.llm import pitmanyor as m
    text = "a b a c a b d . e a b"
    rows = [(0, text)] * 3 + [(10 + i, f"a {w}") for i, w in enumerate("a b c d . e unknown".split())]
    frame = shipped.createDataFrame(rows, "doc_id bigint, text string")
    scores, shared = m.score(frame, F.col("doc_id") == 0)
    got = {r["key"]: r["score"] for r in scores.collect()}
    assert (shared.tokens, shared.vocabulary) == (3 * 12, 7)
    assert got[11] > got[16] and got[11] > got[14]
    # the parent's probabilities of all words and one unknown word sum to one
    customers, tables = shared.parent[-1]
    words, at = shared.frequent[-1]
    whole = np.arange(len(words))
    known = shared.word_probability(m.SWEEPS, words, at, whole).sum() - len(words) * shared.base(m.SWEEPS)
    rest = (customers - words.sum() - shared.discounts[0] * (tables - at.sum())) / (m.THETA + customers)
    assert abs(known + rest + (shared.vocabulary + 1) * shared.base(m.SWEEPS) - 1) < 1e-9


def test_pitman_yor_contexts_are_whole_hashes(shipped):
    """Two previous words whose hashes agree in their upper 18 bits keep apart."""
    import pyarrow as pa
    from agroseries.llm import blocks as B, pitmanyor as m
    names = [f"w{i}" for i in range(4000)]
    upper = B.mix(B.Words(pa.array([" ".join(names).encode()], pa.large_binary()), lower=True).hash) >> np.uint64(46)
    order = np.argsort(upper, kind="stable")
    i = int(np.flatnonzero(np.diff(upper[order].astype(np.int64)) == 0)[0])
    u, v = (names[j] for j in order[i : i + 2])
    rows = [(0, f"{u} a {v} b " * 40), (1, f"{u} a"), (2, f"{u} b"), (3, f"{v} a"), (4, f"{v} b")]
    frame = shipped.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["key"]: r["score"] for r in m.score(frame, F.col("doc_id") == 0)[0].collect()}
    assert got[1] - got[2] > 1 and got[4] - got[3] > 1


def test_pitman_yor_sums_of_contexts(documents):
    """Customers and tables of every context, as the owners of its pairs have them."""
    from agroseries.llm import pitmanyor as m
    known, shared = m.train(documents.select("text"), "text", F.lit(True), 1)
    routing, rows = shared.routing, known.collect()
    for sweep in m.AVERAGED:
        customers, tables, told = Counter(), Counter(), Counter(dict(zip(routing.frequent.tolist(), shared.contexts[sweep].tolist())))
        for r in rows:
            if r["kind"] == m.FULL:
                own = m.read_owned(r, routing)
                for c, n in zip(own.context.tolist(), own.count.tolist()):
                    customers[c] += n
                    tables[c] += n == 1
                told.update({w: t for w, t, x in zip(own.words.tolist(), own.totals.tolist(), routing.whole(own.words)) if x < 0})
            elif r["kind"] == sweep:
                seats = m.Seats.read(r, routing)
                for c, t in zip(seats.context.tolist(), seats.tables.tolist()):
                    tables[c] += t
            elif r["kind"] == m.LESS + sweep:
                told.subtract(dict(zip(m.B.from_planes(r["words"]).tolist(), m.from_small(r["counts"]).tolist())))
        assert tables == told and sum(tables.values()) == shared.parent[sweep][0] and sum(customers.values()) == shared.tokens
        assert any(tables[c] < customers[c] for c in customers)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x > y --><div class="cookie-notice">We use</div><div class="ad">Buy</div>
%s<aside>more</aside><form>mail <input name=x></form><div id="comments"><p>I agree</p></div><footer>&copy; me</footer>%s"""


def test_extract(shipped):
    from agroseries.llm import extract
    cases = [("<article><h1>He&amp;ad</h1><p><b>Bo</b>ld  one<br>two<p>x &lt; y<p>caf&eacute;&nbsp;z</article>", "He&ad Bold one two x < y café z"),
             ("<article><p>a</p><div class=share>tweet</div><section class='comments'><p>no</p></section><p>b", "a b"),
             ("<div class='content'><p>plain &#65;&#x42;</p><ul><li>one<li>two</ul></div>", "plain AB one two"),
             ("<article></article>", ""), ("<article><p>2 < 3 and <i>x</i>y</p></article>", "2 < 3 and xy")]
    rows = [(i, f"http://h{i}.org/x", PAGE % (c, "</body></html>" if i % 2 else ""), "t") for i, (c, _) in enumerate(cases)]
    rows += [(90, None, None, "t"), (91, "odd", "", "t"), (92, "http://h/", "<a <b <c", "t"), (93, "http://h/", "<p>" * 500 + "deep" + "<div>" * 500, "t"), (94, "x", "just text &am", "t")]
    rows += [rows[0]]
    pages = shipped.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    out = extract.extract(pages)
    assert set(out.columns) == {*pages.columns, "text"}
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: t for i, (_, t) in enumerate(cases)}
    assert (got[90], got[91], got[93], got[94]) == ("", "", "deep", "just text &am") and out.count() == len(rows)
    assert extract.extract(pages.limit(0)).collect() == []


def test_extract_weighs_names_and_articles():
    from agroseries.llm.extract import main_text
    story, page = "The story of the day is told here at some length, for all to read.", "<html><body>%s<footer>us</footer></body></html>"
    cases = [  # cards beside a story; a comment that is an article
        (f"<div class=story><p>{story}</p></div><article><p>Card</p></article><article><p>Card two</p></article>", f"{story} Card Card two"),
        (f"<div class=story><p>{story}</p></div><article class=comment><p>I agree</p></article>", story),
        (f"<article><p>{story}</p></article><article class=comment><p>{story} Yes</p><p>{story} No</p></article>", story),
        # names inside longer names, on wrappers, headings and places to jump to
        (f"<div class='content has-sidebar'><p>{story}</p><div class=sidebar>links</div></div>", story),
        (f"<div class=menu><article><p>{story}</p></article></div>", story),
        (f"<form><p>{story}</p><div class=cookie-notice>We use</div></form>", story),
        (f"<article><h1>On</h1><p>{story}</p><h2 id=related-work class=related>Related work</h2><section id=search><p>Search</p></section><div class=share>tweet</div></article>", f"On {story} Related work Search"),
        (f"<p>teaser</p><main><p>{story}</p></main><p>more</p>", story),
        (f"<article><p>Short.</p></article><div class=comments><p>{story}</p><p>{story}</p></div>", "Short.")]
    for html, want in cases:
        assert main_text(page % html, frozenset()) == want, html


def test_style_tree_removes_what_all_pages_share(shipped):
    """No name gives the box away, its sameness over the host does; another host's
    box that differs from page to page stays."""
    from agroseries.llm import extract
    page = "<html><body><div class='box'><p>Read our rules</p></div><div class='story'><p>Story %d tells of %d</p></div></body></html>"
    other = "<html><body><div class='box'><p>Box %d</p></div><div class='story'><p>Story %d</p></div></body></html>"
    rows = [(i, "https://same.org/%d" % i, page % (i, i * i)) for i in range(20)] + [(100 + i, "https://differs.org/", other % (i, i)) for i in range(20)]
    pages = shipped.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    assert got[3] == "Story 3 tells of 9" and got[103] == "Box 3 Story 3"


def test_style_tree_against_plain_loops(shipped):
    """Importance of every branch, computed page by page."""
    from agroseries.llm import extract
    rng = random.Random(5)
    lines = [f"line {i} " * rng.randrange(1, 5) for i in range(9)]
    def page(host):
        items = "".join(f"<li>{rng.choice(lines)}</li>" for _ in range(rng.randrange(3)))
        head = "<h2>Story</h2>" if host != "b" else ""
        own = "".join(f"<p>{rng.random()} told once</p>" if rng.random() < 0.8 else f"<p>{rng.choice(lines)}</p>" for _ in range(rng.randrange(4)))
        return f"<div class=x>{rng.choice(lines[:2 if host == 'a' else 9])}<ul>{items}</ul></div><div class=y>{head}{own}</div>{rng.choice(['', lines[0]])}"
    pages = [(h, page(h)) for h in "a" * 30 + "b" * 20 + "cc" + "d"]
    found = extract.style_nodes(shipped.createDataFrame([*pages, ("e", None), ("e", "")], "host string, html string").repartition(3)).groupBy("host", "path", "kind", "hash").agg(
        *(F.sum(c).alias(c) for c in ("n", "chars", "total")))
    got = {tuple(r) for r in extract.low_branches(found).collect()}
    parsed = [(h, *extract.parse(t)) for h, t in pages]
    leaf = lambda b: b.path + "/#"
    everywhere = Counter((t, p) for _, bs, _ in parsed for t, p in {(b.text, leaf(b)) for b in bs})
    everywhere = {t: sum(n for (x, _), n in everywhere.items() if x == t) for t, _ in everywhere}
    inside = lambda p, x: p == x or p.startswith(x + "/")
    share = lambda n, of: max(0, 1 - math.log(n) / math.log(of)) if of > 1 else 1
    want = set()
    for h in "abcd":
        own = [(bs, shapes) for x, bs, shapes in parsed if x == h]
        content = {}
        for p in {leaf(b) for bs, _ in own for b in bs}:
            held = Counter(t for bs, _ in own for t in {b.text for b in bs if leaf(b) == p})
            size, on = sum(len(t) * n for t, n in held.items()), sum(any(leaf(b) == p for b in bs) for bs, _ in own)
            mean = lambda f: sum(len(t) * n * f(t, n) for t, n in held.items()) / size  # noqa: E731, B023
            content[p] = size, min(mean(lambda t, n: share(n, on)), mean(lambda t, n: share(everywhere[t], len([1 for _, bs, _ in parsed if bs]))))  # noqa: B023
        mean = lambda ps: sum(content[p][0] * content[p][1] for p in ps) / sum(content[p][0] for p in ps)  # noqa: E731, B023
        for x in {"/".join(p.split("/")[:i]) for p in content for i in range(2, p.count("/") + 2)}:
            under = [p for p in content if inside(p, x)]
            on = [bs for bs, _ in own if any(inside(leaf(b), x) for b in bs)]
            if len(on) < 2 or 2 * sum(len(b.text) for bs in on for b in bs if inside(leaf(b), x)) > sum(len(b.text) for bs in on for b in bs) or "/h2" in x:
                continue
            shapes = Counter(s for _, ss in own for p, s in set(ss) if p == x)
            value = mean(under)
            if any(shapes):
                n, w = sum(shapes.values()), extract.GAMMA ** len(under)
                varied = (math.log(n) - sum(c * math.log(c) for c in shapes.values()) / n) / math.log(n) if n > 1 else 1
                value = max(value, (1 - w) * varied + w * value)
            if value < extract.LOW * mean(content):
                want.add((h, x))
    assert got == want and ("a", "/div.x/#") in got and not {("a", "/div.y"), ("a", "/div.y/p"), ("b", "/div.y")} & got


def test_style_tree_finds_articles_without_names(shipped):
    """The given pages with classes and ids gone and every article a div: the tree
    alone tells notices from the article."""
    from agroseries.llm import extract
    pages = shipped.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    plain = F.regexp_replace(F.regexp_replace("html", r'(<\w+[^>]*?) (?:class|id)="[^"]*"', "$1"), r"<(/?)(?:article|main)\b", "<$1div")
    named = F.udf(lambda t: " ".join(b.text for b in extract.parse(t or "")[0] if "/article" in b.path))
    want = {r[0]: r[1] for r in pages.select("page_id", named("html")).collect()}
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    bare = {r["page_id"]: r["text"] for r in extract.extract(pages.withColumn("html", plain)).collect()}
    assert got == want
    assert sum(bare[i] == t for i, t in want.items()) >= 0.9 * len(want)


def test_style_tree_of_two_pages(shipped):
    """Two pages tell a shared box from two stories; a heading that both share stays with
    its story, and so does what is most of the page."""
    from agroseries.llm import extract
    page = "<div class=one>Read our rules</div><div class=two><h2>Story</h2><p>%s</p></div>"
    rows = [(i, "http://two.org/", page % t) for i, t in enumerate(("Once there was a king who had it all", "The queen left early in the morning"))]
    rows += [(10 + i, "http://copies.org/", page % "The same old story is told here twice") for i in range(2)]
    got = {r[0]: r["text"] for r in extract.extract(shipped.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == "Story Once there was a king who had it all" and got[1] == "Story The queen left early in the morning"
    assert got[10] == got[11] and got[10].endswith("Story The same old story is told here twice")


@pytest.fixture(scope="module")
def labelled(shipped):
    rng = random.Random(1)
    own = {"en": "the of and to in is that".split(), "de": "der die und nicht ein für schön".split(), "fr": "le la les être où ça avec".split()}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(rng.randrange(3, 60))), lang, "x") for i, lang in enumerate(rng.choice(list(own)) for _ in range(240))]
    rows += [(900, None, "en", ""), (901, "", "en", ""), (902, "12 %% 34", "de", ""), (903, "the and of", None, ""), (None, "le la les", None, ""), (904, "qzxj" * 200, None, "")]
    return shipped.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")


def test_language_id(labelled, empty):
    from agroseries.llm import langid
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = langid.fit(labelled.where(~held))
    rows = labelled.select("*", held.alias("held"), langid.predict(labelled, model).alias("p")).collect()
    judged = [(r["lang"], r["p"]["lang"]) for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(judged) > 20 and sum(a == b for a, b in judged) >= 0.95 * len(judged)
    by = {r["doc_id"]: r["p"] for r in rows}
    assert all(by[i]["lang"] == "und" and by[i]["score"] == 0 and not by[i]["accepted"] for i in (900, 901, 902))
    assert by[903]["lang"] == "en" and by[None]["lang"] == "fr" and not by[904]["accepted"]
    assert all(0 <= r["p"]["score"] <= 1 for r in rows) and all(r["p"]["accepted"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 900)
    nothing = langid.fit(empty)
    assert {r["p"]["lang"] for r in labelled.select(langid.predict(labelled, nothing).alias("p")).collect()} == {"und"}
    assert empty.select(langid.predict(empty, model).alias("p")).collect() == []


def test_kneser_ney_sums_to_one():
    from agroseries.llm import langid
    rng = np.random.default_rng(3)
    codes, counts = np.unique(rng.integers(0, 12, 4000) * langid.SYMBOLS**2 + rng.integers(0, 9, 4000) * langid.SYMBOLS + rng.integers(0, 7, 4000), return_counts=True)
    model = langid.fit_model(codes, counts)
    for context in (0, 5 * langid.SYMBOLS + 3, 40 * langid.SYMBOLS + 2, 63 * langid.SYMBOLS + 63):
        assert abs(np.exp(model.logp(context * langid.SYMBOLS + np.arange(langid.SYMBOLS))).sum() - 1) < 1e-9


# --- op10: several scripts ----------------------------------------------------------------
def test_languages_of_many_scripts(shipped):
    """Each language has its own letters: scripts with thousands of letters do not blur,
    and a script that nobody learned is turned away."""
    import random
    from agroseries.llm import langid
    from pyspark.sql import functions as F
    rng = random.Random(11)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnrulodéèà", "ru": "оеаинтсрвлкмдпу", "bg": "аиоетнрсвпкдъл", "el": "αοιετσνηυρπκμλ",
               "zh": "".join(chr(0x4E00 + 7 * i) for i in range(900)), "ja": "のにはをたがでてとしれさある" * 20 + "".join(chr(0x4E00 + 7 * i) for i in range(0, 900, 3))}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randrange(2, 7))) for _ in range(150)] for k, v in letters.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, k, text(k, rng.randrange(8, 40))) for i, k in enumerate(list(letters) * 60)]
    docs = shipped.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = langid.fit(docs.where("doc_id % 4 <> 2"))
    assert set(model.letters) == set(letters) and all(set(model.letters[k]) <= set(letters[k]) for k in letters)
    got = docs.where("doc_id % 4 = 2").withColumn("found", langid.predict(docs, model)).collect()
    assert sum(r["found"]["lang"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert sum(r["found"]["accepted"] for r in got) >= 0.97 * len(got)
    other = shipped.createDataFrame([(1, "שלום עולם זה טקסט בעברית שאיש לא למד כאן"), (2, "สวัสดีชาวโลกนี่คือข้อความ"), (3, "123 !"), (4, None)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["f"] for r in other.select("doc_id", langid.predict(other, model).alias("f")).collect()}
    assert not any(found[i]["accepted"] for i in (1, 2)) and found[3]["lang"] == found[4]["lang"] == "und"
