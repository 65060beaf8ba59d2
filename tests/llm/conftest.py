import random

import pytest

#: Small vocabulary, so that windows repeat by chance as well.
WORDS = "the of and a in to it is was that he for on are with they be at one have this from ä日本 Zwölf".split()


@pytest.fixture(scope="session")
def shipped(spark):
    from agroseries.llm import blocks
    blocks.ship(spark)
    return spark


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, odd ones and nulls."""
    rng = random.Random(7)
    words = [w + s for w in WORDS for s in ("", "x", "yz", "ing")]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(rng.randrange(30, 120)) for _ in range(12)]
    passage = line(60)
    out = list(base)
    out += [base[0], base[0], base[1] + "\n" + line(3), base[2].replace(" ", "  ", 5), base[3].upper()]
    for t in base[4:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += [line(20) + " " + passage + " " + line(15) for _ in range(4)]
    out += ["a b c " * 40, "same " * 50, "", None, "one", "one two three", " \t\n ", "ß" * 200, line(2000)]
    return out


@pytest.fixture(scope="session")
def documents(shipped, texts):
    """doc_id, text and columns whose names operators might use themselves; one
    null id, one repeated row, one id with two texts."""
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), rows[5], (rows[6][0], texts[7])]
    rows = [(k, t, i, "x", None, 1.5, [i]) for i, (k, t) in enumerate(rows)]
    schema = "doc_id bigint, text string, block int, kept string, removed string, n double, ids array<int>"
    return shipped.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(shipped):
    return shipped.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
