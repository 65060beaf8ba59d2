"""Tables of dishes with more customers than the table of Stirling numbers has rows."""
import math

import numpy as np
import pytest

from test_pitman_yor import exact


def test_no_number_of_tables_is_cut():
    """With p = 1 the draws are those of a Chinese restaurant, whose mean is known."""
    from agroseries.llm import pitmanyor as m
    d, others, n = 0.5, 2_000, 150
    own = m.THETA + d * others
    for c in (900, 3_000):
        grown = math.exp(sum(math.lgamma(x) * s for x, s in ((own + d + c, 1), (own + d, -1), (own + c, -1), (own + 1, 1))))
        want = (grown - own) / d
        got = m.reseat(np.full(n, c), np.full(n, others), np.full(n, 1.0), np.full(n, 1e15), d, np.random.default_rng(1))
        assert abs(got.mean() - want) < 0.01 * want and want > 600


@pytest.mark.parametrize("by_draws", [False, True])
def test_many_customers_against_recursion(monkeypatch, by_draws):
    from agroseries.llm import pitmanyor as m
    if by_draws:
        monkeypatch.setattr(m, "LEAST", -1e9)  # nothing is summed in closed form, nothing is left early
    c, others, p, mass, d, n = 1_500, 50, 0.05, 1e12, 0.6, 400 if by_draws else 20_000
    want = np.cumsum(exact(c, others, p, mass, d, 200))
    got = m.reseat(np.full(n, c), np.full(n, others), np.full(n, p), np.full(n, mass), d, np.random.default_rng(5))
    share = np.cumsum(np.bincount(got, minlength=c + 1)[1:201]) / n
    assert np.abs(share - want).max() * math.sqrt(n) < 1.95  # Kolmogorov-Smirnov, 0.1 %


@pytest.mark.parametrize("discount", [0.3, 0.5, 0.8])
def test_closed_form_of_stirling_numbers(discount):
    from agroseries.llm import pitmanyor as m
    c = np.array([1_024, 1_000])
    logs, width = m.stirling_few(c, discount)
    for i in range(2):
        t = np.arange(1, width[i] + 1)
        assert width[i] >= 10 and np.allclose(logs[i, t - 1] + math.lgamma(c[i] - discount), m.stirling_logs(discount)[c[i], t], rtol=0, atol=1e-6)


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.76, 0.95])
def test_integral_of_stirling_numbers(discount):
    from agroseries.llm import pitmanyor as m
    c = 1_000
    t = np.arange(1, c + 1)
    want = m.stirling_logs(discount)[c, 1 : c + 1] + t * math.log(discount) + np.array([math.lgamma(x + 1) for x in t]) - math.lgamma(c + 1)
    assert np.abs(m.log_hits(np.full(c, c), t, discount) - want).max() < 1e-8
    for low, high in ((1, 400), (30, 300), (700, 1_000)):
        own = t[low - 1 : high]
        between = m.interpolated(np.array([c]), np.array([low]), np.array([high]), discount)
        assert np.abs(between(own[None].astype(float))[0] - want[own - 1]).max() < 1e-6


@pytest.mark.parametrize("customers, others, p, mass, discount", [(2_000, 10**7, 0.9, 1e15, 0.76), (1_500, 10**6, 0.99, 1e6, 0.9), (2_500, 12_488, 0.009, 2e6, 0.76), (1_200, 300, 1.0, 1e15, 0.2), (1_100, 0, 1.0, 300.0, 0.5)])
def test_draws_of_many_customers(customers, others, p, mass, discount):
    """Few tables, hundreds, and nearly one for each customer."""
    from agroseries.llm import pitmanyor as m
    n = 1_000
    i = np.arange(customers)
    row = np.full(customers + 1, -np.inf)
    row[0] = 0
    with np.errstate(divide="ignore"):
        for c in range(customers):
            stays = np.where(c > discount * (i + 1), np.log(np.maximum(c - discount * (i + 1), 1e-300)) + row[1:], -np.inf)
            row = np.concatenate([[-np.inf], np.logaddexp(row[:-1], stays)])
    logs = row[1:] + np.cumsum(np.log(m.THETA + discount * (others + i)) + np.log((p * mass + i) / (mass + i)))
    want = np.cumsum(np.exp(logs - logs.max()))
    got = m.reseat(np.full(n, customers), np.full(n, others), np.full(n, p), np.full(n, mass), discount, np.random.default_rng(2))
    share = np.cumsum(np.bincount(got, minlength=customers + 1)[1:]) / n
    assert np.abs(share - want / want[-1]).max() * math.sqrt(n) < 1.95


def test_draws_cost_the_same_for_all_numbers_of_customers(monkeypatch):
    """A million customers at thousands of tables, without a loop over tables."""
    from agroseries.llm import pitmanyor as m
    looked = [0]
    hits = m.log_hits
    monkeypatch.setattr(m, "log_hits", lambda c, t, d: looked.__setitem__(0, looked[0] + t.size) or hits(c, t, d))
    for c in (5_000, 10**6, 10**9):
        looked[0] = 0
        got = m.reseat(np.full(20, c), np.full(20, 10**5), np.full(20, 0.05), np.full(20, 1e7), 0.76, np.random.default_rng(1))
        assert looked[0] <= 20 * m.CELLS and (got > 100).all() and (got < c).all()
