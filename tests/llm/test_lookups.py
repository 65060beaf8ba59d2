"""op8's look-ups: as plain searches find them, and few of them."""
import numpy as np
import pytest

_U = np.uint64


def hashes(random, n):
    return random.integers(0, 2**63, n).astype(_U) * _U(2) + random.integers(0, 2, n).astype(_U)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1_000, 30_000])
def test_spread_places_are_those_of_a_search(n):
    from agroseries.llm import blocks as B
    random = np.random.default_rng(n)
    for known in (np.unique(hashes(random, n)), np.unique(hashes(random, n) >> _U(9)) + _U(5), np.arange(n, dtype=_U)):  # even, in a range, as dense as can be
        values = np.concatenate([random.permutation(known), hashes(random, 500), np.array([0, 2**64 - 1], _U), known + _U(1)])
        at, found = B.Spread(known).places(values)
        assert (found == np.isin(values, known)).all()
        assert (known[at[found]] == values[found]).all()
        again, same = B.places(known, values)
        assert (same == found).all() and (again[found] == at[found]).all()


def test_planes_are_bytes_from_the_highest():
    from agroseries.llm import blocks as B, pitmanyor as m
    values = hashes(np.random.default_rng(3), 100)
    for width in (3, 5, 8):
        assert B.planes(values, width) == b"".join(bytes(int(v) >> 8 * (7 - i) & 255 for v in values) for i in range(width))
        assert (B.from_planes(B.planes(values, width), width) == values >> _U(64 - 8 * width) << _U(64 - 8 * width)).all()
    numbers = np.array([0, 1, 255, 256, 2**32 - 1])
    assert m.small(numbers) == b"".join(bytes(int(v) >> 8 * (3 - i) & 255 for v in numbers) for i in range(4))
    assert (m.from_small(m.small(numbers)) == numbers).all() and m.small(numbers[:0]) == b""


def test_a_context_is_searched_once_a_block(monkeypatch):
    """Pairs of few contexts with many words: before, each pair's context was searched twice."""
    from agroseries.llm import pitmanyor as m
    random = np.random.default_rng(5)
    usual = np.unique(hashes(random, 40))
    routing = m.Routing(64, usual[:3].copy(), usual)
    word, context = random.choice(hashes(random, 3_000), 30_000), random.choice(np.concatenate([usual, hashes(random, 40)]), 30_000)
    words, contexts, pair = m.pairs_of(word, context)
    pairs = m.coded_pairs(pair)[0]
    assert len(pairs) > 5 * (len(words) + len(contexts))
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda known, values, *a, **k: searched.append(np.size(values)) or search(known, values, *a, **k))
    rows = list(m.rows_by_bucket(words, contexts, pairs, routing))
    assert sum(searched) <= 2 * (len(words) + len(contexts)) + 2
    monkeypatch.undo()
    read = [m.read_pairs(routing, *r[1:4]) for r in rows]
    got = {(int(w[i]), int(c)) for w, at, cs in read for i, c in zip(at, cs)}
    assert got == set(zip(word.tolist(), context.tolist())) and sum(len(at) for _, at, _ in read) == len(got)


def test_places_of_values_and_pairs():
    from agroseries.llm import pitmanyor as m
    random = np.random.default_rng(6)
    for values in (random.choice(hashes(random, 50), 900), np.zeros(0, _U), np.array([8, 9, 8, 10], _U)):  # the last alike but for the lower bits
        found, place = m.coded(values)
        assert (found == np.unique(values)).all() and (found[place] == values).all()
    pair = random.integers(0, 9, 500) << m.PLACE | random.integers(0, 9, 500)
    kept = pair.copy()
    found, place = m.coded_pairs(pair)
    assert (found == np.unique(pair)).all() and (found[place] == pair).all() and (pair == kept).all()
