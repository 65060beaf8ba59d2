"""Patterns that cancel in sums modulo 2**64 do not here; runs are told apart."""
import numpy as np
import pyarrow as pa
import pytest


def thue_morse(n, letters="ab"):
    return [letters[bin(i).count("1") & 1] for i in range(n)]


def test_runs_and_words_of_opposite_patterns():
    from agroseries.llm import blocks as B
    one, two = thue_morse(4096), thue_morse(4096, "ba")
    a, b = (np.frombuffer("".join(x).encode(), np.uint8) for x in (one, two))
    for n in (64, 1024, 2048, 4096):
        hashes = [int(B.span(B.prefix(x), np.array([0]), np.array([n]))[0]) for x in (a, b)]
        assert hashes[0] != hashes[1]
    words = B.Words(pa.array(["".join(x[:n]) for x in (one, two) for n in (1, 7, 8, 9, 64, 255, 256, 257, 1024, 4096)], pa.large_binary()))
    assert len(set(words.hash.tolist())) == len(words) == 20
    values = [np.where(np.array(x) == "a", np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)) for x in (one, two)]
    assert B.span(B.prefix(values[0]), np.array([0]), np.array([2048]))[0] != B.span(B.prefix(values[1]), np.array([0]), np.array([2048]))[0]


def test_sums_are_exact():
    from agroseries.llm import blocks as B
    rng = np.random.default_rng(0)
    p = (1 << 61) - 1
    x, y = rng.integers(0, p, 500, dtype=np.uint64), rng.integers(0, p, 500, dtype=np.uint64)
    x[:3], y[:3] = [0, p - 1, p - 1], [p - 1, p - 1, 1]
    assert [int(v) for v in B.times(x, y)] == [int(a) * int(b) % p for a, b in zip(x, y)]
    for values, plain in ((rng.integers(0, 256, 3000, dtype=np.uint8), lambda v: int(v) + 1), (rng.integers(0, 2**64, 3000, dtype=np.uint64), int)):
        total, sums = 0, B.prefix(values)
        for i, v in enumerate(values):
            total = (total + plain(v) * pow(B._BASE, i, p)) % p
            assert int(sums[i + 1]) % p == total
    text = np.frombuffer(b"abcabcabcxabc", np.uint8)
    starts = np.array([0, 3, 6, 10])
    assert len(set(B.span(B.prefix(text), starts, starts + 3).tolist())) == 1


def test_words_equal_across_slices_and_lengths():
    from agroseries.llm import blocks as B
    words = ["x" * n for n in (1, 8, 9, 16, 255, 256, 257, 5000)] + ["日本語", "a b"]
    one = B.Words(pa.array([" ".join(words)], pa.large_binary()))
    two = B.Words(pa.array([w for w in reversed(words)] + [None, ""], pa.large_binary()))
    assert one.hash.tolist() == two.hash.tolist()[::-1] and len(set(one.hash.tolist())) == len(words)


def test_long_words_do_not_link(shipped):
    from agroseries.llm import jaccard
    rows = [(1, "".join(thue_morse(1024))), (2, "".join(thue_morse(1024, "ba"))), (3, "".join(thue_morse(1024)))]
    got = {r["key"]: r["component"] for r in jaccard.join(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("other", [[], [(8, "again and " * 30), (9, "again and " * 30)]])
def test_opposite_word_sequences_stay(shipped, other):
    from agroseries.llm import substring
    text = lambda letters: " ".join(f"u{i} {x}" for i, x in enumerate(thue_morse(2048, letters)))
    rows = [(1, text("ab")), (2, text("ba")), *other]
    got = {r["doc_id"]: r["removed"] for r in substring.remove_repeats(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # windows of the two meet only where 20 words agree, which these patterns never do
    assert got[1] == got[2] == []


def test_opposite_byte_strings_stay(shipped):
    from agroseries.llm import suffix
    rows = [(1, "".join(thue_morse(4096, "xy"))), (2, "".join(thue_morse(4096, "zw"))), (3, "".join(thue_morse(4096, "zw")))]
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in suffix.remove_repeats(shipped.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [], 2: [], 3: [(0, 4096)]}
