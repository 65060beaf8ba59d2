"""The pipeline against plain loops, stage by stage."""
import random

import pytest

from test_dedup import brute_components, repeats


@pytest.fixture(scope="module")
def folder(shipped, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(200, texts[1][:40] + " " + item + " end", "en", "s", 1), (201, "12 34 !!", None, "s", 1), (None, texts[2], "en", "s", 1)]
    rows += [rows[3], rows[3]]
    shipped.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{path}/documents.parquet")
    shipped.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def whole_characters(text, gone):
    """Bytes that go, without characters of which only a part would."""
    raw, out, at = text.encode(), [], 0
    for c in text:
        n = len(c.encode())
        if not all(at + i in gone for i in range(n)):
            out.append(c)
        at += n
    assert at == len(raw)
    return "".join(out)


def test_stages(shipped, folder):
    import corpus_pipeline
    docs = shipped.read.parquet(f"{folder}/documents.parquet")
    columns, read = docs.columns, lambda d: [(r["doc_id"], r["text"]) for r in d.collect()]
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        before = read(docs)
        after = stage(shipped, docs, folder)
        if name != "byte_bpe":
            assert after.columns == columns
            path = f"{folder}/{name}"
            after.write.parquet(path)
            after = shipped.read.parquet(path)
            results[name] = before, read(after)
        else:
            rows = after.collect()
            assert len(rows) == len(before) and all(r["round_trip"] for r in rows)
        docs = after

    before, after = results["language_id"]
    assert sorted(map(str, after)) == sorted(str(x) for x in before if any(c.isalpha() for c in x[1] or ""))
    before, after = results["ngram_jaccard"]
    components = {c for k, _, c in brute_components(before) if k is not None}
    assert sorted(k for k, _ in after if k is not None) == sorted(components) and set(after) <= set(before)
    assert (None, dict(before)[None]) in after
    before, after = results["suffix_dedup"]
    first, want = repeats([(k, (t or "").encode()) for k, t in before], 50), {}
    for k, t in before:
        raw, gone = t.encode(), set()
        for s in range(len(raw) - 49 if k is not None else 0):
            if first[tuple(raw[s : s + 50])][0] < k:
                gone.update(range(s, s + 50))
        want[k] = whole_characters(t, gone)
    assert dict(after) == want and any(want[k] != t for k, t in before)
    before, after = results["decontamination"]
    assert {k for k, _ in before} - {k for k, _ in after} == {200}


def test_run(shipped, folder):
    import corpus_pipeline
    out = corpus_pipeline.run(shipped, folder)
    assert out.count() > 10 and out.where("not round_trip").count() == 0
    assert out.where("n_tokens <> size(ids)").count() == 0
