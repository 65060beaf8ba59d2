"""The Gibbs step of op8 against exact recursions, and its scores against plain loops."""
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F


def exact(customers, others, p, mass, discount, most):
    """P(t) by plain sums of products."""
    s = {(0, 0): 1.0}
    row = [0.0] * (most + 2)
    row[0] = 1.0
    scale = 0.0
    for c in range(customers):
        row = [0.0] + [row[t - 1] + (c - discount * t) * row[t] if c > discount * t or row[t] == 0 else row[t - 1] for t in range(1, most + 1)] + [0.0]
        top = max(row)
        row, scale = [x / top for x in row], scale + math.log(top)
    w, product = [], 1.0
    for t in range(1, min(customers, most) + 1):
        i = t - 1
        product *= (1.0 + discount * (others + i)) * (p * mass + i) / (mass + i)
        w.append(row[t] * product)
    return np.array(w) / sum(w)


@pytest.mark.parametrize("customers", range(2, 9))
def test_tables_of_few_customers(customers):
    from agroseries.llm import pitmanyor as m
    n, d = 40_000, 0.6
    want = exact(customers, 7, 0.08, 300.0, d, customers)
    got = m.reseat(np.full(n, customers), np.full(n, 7), np.full(n, 0.08), np.full(n, 300.0), d, np.random.default_rng(customers))
    share = np.bincount(got, minlength=customers + 1)[1:] / n
    assert np.abs(share - want).max() < 4 * math.sqrt(0.25 / n)


def test_stirling_numbers_by_enumeration():
    """S(c, t) sums, over the partitions of c customers into t tables, the products of
    (1 - d)(2 - d)...(size - 1 - d)."""
    from agroseries.llm import pitmanyor as m
    d = Fraction(1, 2)

    def partitions(c):
        if c == 0:
            yield ()
            return
        for rest in partitions(c - 1):
            yield (*rest, 1)
            for i in range(len(rest)):
                yield (*rest[:i], rest[i] + 1, *rest[i + 1 :])
    logs = m.stirling_logs(0.5)
    for c in range(1, 8):
        total = defaultdict(Fraction)
        for sizes in partitions(c):
            total[len(sizes)] += math.prod((math.prod((j - d for j in range(1, x)), start=Fraction(1)) for x in sizes), start=Fraction(1))
        assert all(abs(logs[c, t] - math.log(total[t])) < 1e-9 for t in total)


@pytest.mark.parametrize("customers", [30, 300, 1_000, 4_000])
def test_mean_tables(customers):
    from agroseries.llm import pitmanyor as m
    d, others, p, mass = 0.75, 50, 0.05, 1e12
    want = exact(customers, others, p, mass, d, 300)
    mean = float((want * np.arange(1, len(want) + 1)).sum())
    n = 20_000
    got = m.reseat(np.full(n, customers), np.full(n, others), np.full(n, p), np.full(n, mass), d, np.random.default_rng(1)).mean()
    assert abs(got - mean) < 0.05 * mean


def test_reseat_of_none_one_and_many():
    from agroseries.llm import pitmanyor as m
    c = np.array([0, 1, 2, 3, 50_000, 700])
    t = m.reseat(c, np.array([0, 0, 0, 10**6, 10**6, 10**6]), np.array([0.1, 0.1, 1e-9, 0.9, 0.5, 0.9]), np.full(6, 1e6), 0.5, np.random.default_rng(0))
    assert t[0] == 0 and t[1] == 1 and t[2] == 1 and t[3] == 3 and 1 < t[4] <= m.MOST_TABLES and t[5] > 100
    assert len(m.reseat(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), 0.5, np.random.default_rng(0))) == 0


def test_scores_equal_plain_loops(shipped):
    """Every text's score from the counts, tables and parents that the sweeps left."""
    import random

    import pyarrow as pa
    from agroseries.llm import blocks as B, pitmanyor as m
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 60])]) for _ in range(rng.randrange(0, 60))) + (" new" * (i % 7 == 0))) for i in range(50)]
    frame = shipped.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    learn = F.col("doc_id") % 5 != 2
    got = {r["key"]: r["score"] for r in m.score(frame, learn)[0].collect()}
    own = frame.select(F.col("doc_id").alias("key"), learn.alias("learned"), "text")
    known, shared = m.train(own, "text", F.col("learned"), B.text_bytes(frame))
    routing, low, high = shared.routing, *shared.discounts
    frequent = {int(h): i for i, h in enumerate(routing.frequent)}
    count, tables = defaultdict(int), {s: {} for s in m.AVERAGED}
    word_customers, word_tables, less = ({s: defaultdict(int) for s in m.AVERAGED} for _ in range(3))
    totals = defaultdict(int)
    for row in known.collect():
        if row["kind"] == m.FULL:
            x = m.read_owned(row, routing)
            for w, c, n in zip(x.words[x.word].tolist(), x.context.tolist(), x.count.tolist()):
                count[w, c] += n
                totals[w] += n
        elif row["kind"] in m.AVERAGED:
            x = m.Seats.read(row, routing)
            for w, c, t in zip(x.words[x.word].tolist(), x.context.tolist(), x.tables.tolist()):
                tables[row["kind"]][w, c] = t
            for w, n, t in zip(x.words.tolist(), x.of_word.tolist(), x.parent.tolist()):
                word_customers[row["kind"]][w], word_tables[row["kind"]][w] = n, t
    of_context, tables_of = defaultdict(int), {s: defaultdict(int) for s in m.AVERAGED}
    for (w, c), n in count.items():
        of_context[c] += n
        for s in m.AVERAGED:
            tables_of[s][c] += tables[s].get((w, c), 1)

    def parent(s, token, split):
        customers, at = shared.parent[s]
        base = (m.THETA + low * at) / (shared.vocabulary + 1) / (m.THETA + customers)
        if token in frequent:
            n, t = shared.frequent[s][0][frequent[token]], shared.frequent[s][1][frequent[token]]
        else:
            n = word_customers[s].get(split, 1 if totals[split] else 0)
            t = word_tables[s].get(split, 1 if totals[split] else 0)
        return max(n - low * t, 0) / (m.THETA + customers) + base

    for key, text in rows:
        token, context, _ = m.tokens(B.flat(pa.array([text])))
        split = routing.split(token, context)
        total = 0.0
        for w, part, c in zip(token.tolist(), split.tolist(), context.tolist()):
            mean = 0.0
            for s in m.AVERAGED:
                p = parent(s, w, part)
                if of_context[c]:
                    n = count.get((part, c), 0)
                    t = tables[s].get((part, c), 1) if n else 0
                    p = (n - high * t + (m.THETA + high * tables_of[s][c]) * p) / (m.THETA + of_context[c])
                mean += p / len(m.AVERAGED)
            total += math.log10(min(mean, 1))
        assert got[key] == pytest.approx(total, abs=1e-6), key


def test_codes_of_values_and_pairs():
    from agroseries.llm import pitmanyor as m
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 2**64, 5000, dtype=np.uint64)[rng.integers(0, 700, 20_000)], np.arange(300, dtype=np.uint64)[rng.integers(0, 300, 4000)], np.zeros(0, np.uint64), np.full(9, 2**64 - 1, np.uint64)):
        found, place = m.coded(values)
        assert (found == np.unique(values)).all() and (found[place] == values).all()
    for words, contexts in ((900, 700), (2**31 - 1, 2**31 - 1), (1, 1)):
        pair = (rng.integers(0, words, 9000) << m.PLACE) | rng.integers(0, contexts, 9000)
        found, place = m.coded_pairs(pair)
        assert (found == np.unique(pair)).all() and (found[place] == pair).all()
    assert len(m.coded_pairs(np.zeros(0, np.int64))[0]) == 0
