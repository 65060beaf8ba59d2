"""op4, op5 and op7 against plain loops over the same texts."""
import random
from itertools import combinations

import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def repeats(rows, length):
    """For sequences with keys: flags of what a window of an earlier place covers."""
    first = {}
    for key, seq in rows:
        if key is not None:
            for s in range(len(seq) - length + 1):
                w = tuple(seq[s : s + length])
                first[w] = min(first.get(w, (key, s)), (key, s))
    return first


@pytest.mark.parametrize("stretch", [5, 16_384])
def test_substring_dedup(documents, monkeypatch, stretch):
    from agroseries.llm import substring
    monkeypatch.setattr(substring, "STRETCH", stretch)
    k = 8
    out = substring.remove_repeats(documents, k=k, gram=4)
    assert {"n_words", "removed", "kept", "block", "ids"} <= set(out.columns) and out.count() == documents.count()
    rows = [(r["doc_id"], (r["text"] or "").encode().split(), r["kept"]) for r in out.collect()]
    first = repeats([(i, w) for i, w, _ in rows], k)
    changed = 0
    for key, words, kept in rows:
        gone = set()
        if key is not None:
            for s in range(len(words) - k + 1):
                if first[tuple(words[s : s + k])] != (key, s):
                    gone.update(range(s, s + k))
        assert kept == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        changed += bool(gone)
    assert changed > 8


def test_substring_dedup_of_long_repeats(shipped, monkeypatch):
    """A long document that repeats parts of itself and of which others hold parts: no
    task gets more than a stretch of it, and all repeats go."""
    from agroseries.llm import substring
    monkeypatch.setattr(substring, "STRETCH", 64)
    rng = random.Random(11)
    line = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    long = line(1500)
    long += line(30) + long[100:900] + line(20)
    texts = [long, line(10) + long[300:1200] + line(10), long[63:1000], ["one"] + long, line(50)]
    frame = shipped.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    first = repeats(list(enumerate(texts)), 20)
    for r in substring.remove_repeats(frame).collect():
        words = texts[r["doc_id"]]
        gone = {x for s in range(len(words) - 19) if first[tuple(words[s : s + 20])] != (r["doc_id"], s) for x in range(s, s + 20)}
        assert r["kept"].split() == [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("crowd", [0, 2, 65_536])
def test_suffix_dedup(documents, crowd):
    from agroseries.llm import suffix
    out = suffix.remove_repeats(documents, length=30, gram=12, crowd=crowd)
    rows = [(r["doc_id"], (r["text"] or "").encode(), bytes(r["kept"]), r["removed"]) for r in out.collect()]
    first = repeats([(i, t) for i, t, _, _ in rows], 30)
    for key, text, kept, spans in rows:
        gone = set()
        if key is not None:
            for s in range(len(text) - 29):
                if first[tuple(text[s : s + 30])][0] < key:
                    gone.update(range(s, s + 30))
        assert kept == bytes(b for i, b in enumerate(text) if i not in gone)
        assert sum(s["length"] for s in spans) == len(gone)
    whole = suffix.whole_characters(out).collect()
    assert all((r["text"] is None) == (t is None) for r, t in zip(whole, [x["text"] for x in whole]))
    assert {len(r["text"] or "") for r in whole}


@pytest.mark.parametrize("length", [8, 13, 50, 56])
def test_suffix_order(length):
    """Suffixes cut at a length, in the order of their bytes, each group's first one marked."""
    import numpy as np
    from agroseries.llm import suffix
    rng = random.Random(length)
    text = b"".join(rng.choice([b"ab", b"\x00", b"\xff" * 3, b"abcabc" * 12]) for _ in range(200))
    start = np.arange(len(text) - length + 1)
    order, fresh = suffix.suffix_order(np.frombuffer(text, np.uint8), start, length)
    cut = [text[s : s + length] for s in order.tolist()]
    assert cut == sorted(text[s : s + length] for s in start.tolist())
    assert fresh.tolist() == [i == 0 or cut[i] != cut[i - 1] for i in range(len(cut))]


def test_suffix_pieces():
    """Equal places stay together, other pieces hold about the weight asked for."""
    import numpy as np
    from agroseries.llm import suffix
    places = np.array([1, 1, 1, 2, 3, 3, 4, 5, 6])
    got = suffix.pieces(places, np.array([4, 4, 4, 1, 1, 1, 3, 5, 1]), 6)
    assert got == [(0, 3), (3, 7), (7, 9)]
    assert suffix.pieces(places[:0], places[:0], 6) == []


@pytest.mark.parametrize("crowd", [10, 65_536])
def test_suffix_dedup_of_a_frequent_line(shipped, crowd):
    """One line in every document, with other surroundings each time: its trigger has a
    crowd of phrases; what follows it repeats for some."""
    from agroseries.llm import suffix
    rng = random.Random(3)
    noise = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    line = noise(60)
    after = [noise(30) for _ in range(5)]
    texts = [noise(80) + line + rng.choice(after) + noise(60) for _ in range(120)]
    frame = shipped.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    first = repeats(list(enumerate(texts)), 50)
    for r in suffix.remove_repeats(frame, crowd=crowd).collect():
        i, text = r["doc_id"], texts[r["doc_id"]]
        gone = {x for s in range(len(text) - 49) if first[tuple(text[s : s + 50])][0] < i for x in range(s, s + 50)}
        assert bytes(r["kept"]).decode() == "".join(c for x, c in enumerate(text) if x not in gone)


@pytest.mark.parametrize("name", ["substring", "suffix"])
def test_dedup_of_nothing(empty, shipped, name):
    import importlib
    module = importlib.import_module(f"agroseries.llm.{name}")
    assert module.remove_repeats(empty).collect() == []
    nulls = shipped.createDataFrame([(1, None), (None, None), (2, "")], "doc_id bigint, text string")
    assert sorted(bytes(r["kept"], "utf-8") if isinstance(r["kept"], str) else bytes(r["kept"]) for r in module.remove_repeats(nulls).collect()) == [b"", b"", b""]


def shingles(text, n=5):
    w = (text or "").translate(LOWER).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows):
    """Component of each (key, text) by all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if sets[i][0] is not None and sets[j][0] is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), None if k is None else least[find(i)]) for i, (k, s) in enumerate(sets)), key=str)


def test_jaccard_components(documents, empty, texts, shipped):
    from agroseries.llm import jaccard
    rows = rows_of(documents, "doc_id", "text")
    assert sorted(rows_of(jaccard.join(documents), "key", "n_shingles", "component"), key=str) == brute_components(rows)
    assert jaccard.join(empty).collect() == []
    left = jaccard.one_of_each(documents)
    assert left.columns == documents.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    n = len({(c, k if not s else None) for k, s, c in brute_components(rows) if k is not None})
    assert len(kept) >= n and len({x for x in kept if x[0] is not None}) == len([x for x in kept if x[0] is not None])


def test_jaccard_chain_and_threshold(shipped):
    """A chain whose ends do not link, a pair just at 75 percent, one just below."""
    from agroseries.llm import jaccard
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 5 : i * 5 + 60])) for i in range(8)]
    seven = [f"v{i}" for i in range(11)]
    at = [(100, " ".join(seven)), (101, " ".join(seven[:10])), (102, " ".join(seven[:9] + ["q"]))]
    many = [(200 + i, " ".join(f"m{j}" for j in range(100)) + f" end{i}") for i in range(60)]
    rows = chain + at + many
    frame = shipped.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(rows_of(jaccard.join(frame), "key", "n_shingles", "component"), key=str) == brute_components(rows)


def test_star_components(shipped):
    from agroseries.llm import jaccard
    import random
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in jaccard.components(shipped.createDataFrame(edges, "x bigint, y bigint")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_jaccard_frees_shuffles_of_texts(shipped, monkeypatch):
    """What the sets were made from is let go before the classes are made."""
    from agroseries.llm import blocks as B, jaccard
    rows = [(i, f"one two three four five six seven eight nine {i // 2}") for i in range(8)]
    steps, settle, ordered = [], B.settle, jaccard.ordered
    monkeypatch.setattr(B, "settle", lambda spark: steps.append("settle") or settle(spark))
    monkeypatch.setattr(jaccard, "ordered", lambda *a: steps.append("classes") or ordered(*a))
    got = jaccard.join(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 8 and steps[:2] == ["settle", "classes"] and steps[2:].count("settle") >= 2
