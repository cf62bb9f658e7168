"""Exact tests by counting all sign patterns, and at sizes where that is out of reach."""

import random
from fractions import Fraction
from itertools import product
from math import comb

import pytest

from fenestra.operators import resources, stats, tree


def test_binomial_tails_at_any_size():
    for n in (0, 1, 7, 300, 2000, 2001, 5000):
        for k in {0, n // 3, max(0, n // 2 - 9), n // 2}:
            want = min(1.0, float(Fraction(2 * sum(comb(n, i) for i in range(k + 1)), 2**n))) if n else 1.0
            assert abs(stats.binomial_p(k, n - k) - want) <= 1e-9 * want
    assert 0 < stats.binomial_p(499_000, 501_000) < 0.05


def ranked(values):
    order = sorted(map(abs, values))
    return [(order.index(abs(v)) + 1 + order.index(abs(v)) + order.count(abs(v))) / 2 for v in values]


def test_signed_ranks_by_all_patterns():
    rng = random.Random(2)
    for _ in range(30):
        values = [rng.choice([-3, -2, -1, 1, 2, 3, 4.5]) for _ in range(rng.randint(1, 11))]
        ranks = ranked(values)
        w, half = sum(r for r, v in zip(ranks, values) if v > 0), sum(ranks) / 2
        far = sum(abs(sum(r for r, s in zip(ranks, signs) if s) - half) >= abs(w - half) for signs in product((0, 1), repeat=len(ranks)))
        ties = [(v, sum(abs(x) == v for x in values)) for v in {abs(x) for x in values}]
        got = stats.wilcoxon_p([(v, sum(x == v for x in values)) for v, _ in ties], ties)
        assert got[0] == w and abs(got[1] - far / 2 ** len(ranks)) < 1e-12


def test_halves_give_what_steps_give(monkeypatch):
    steps = [(2 * i + 2, 1 + i % 3, 0.5) for i in range(60)]
    by_steps = stats.rank_sums(steps)
    monkeypatch.setattr(stats, "STEPWISE", 10)
    assert abs(stats.rank_sums(steps) - by_steps).max() < 1e-15 and abs(by_steps.sum() - 1) < 1e-12


def subsets_up_to(steps, most):
    """How many choices of the ranks have a sum of at most ``most``, in whole numbers."""
    ways = [1] + [0] * most
    for r, n in steps:
        for _ in range(n):
            for s in range(most, r - 1, -1):
                ways[s] += ways[s - r]
    return sum(ways)


@pytest.mark.parametrize("stepwise", [1 << 31, 10])
def test_tails_are_right_to_the_last_orders(monkeypatch, stepwise):
    """Relative errors, from half the mass down to 1e-300, added one by one or multiplied in halves."""
    monkeypatch.setattr(stats, "STEPWISE", stepwise)
    plain = [(2 * i, 1) for i in range(1, 201)]  # doubled ranks without ties
    tied = [(i * 6 + 4, 3) for i in range(40)] + [(245, 2)]
    long = [(2 * i, 1) for i in range(1, 1061)]
    for steps, sums in ((plain, (0, 2, 40, 900, 6000, 15000, 20099)), (tied, (3, 4, 50, 3000, 7000)), (long, (900, 8000))):
        n = sum(k for _, k in steps)
        for most in sums:
            want = float(Fraction(subsets_up_to(steps, most), 2**n))
            assert want > 0 and abs(stats.lower_tail(steps, most) / want - 1) < 1e-9, (most, want)


def test_large_groups_of_differences(monkeypatch):
    """1,400 differences, one side stronger: p of some 1e-28 by two ways."""
    values = [(float(i), 1) for i in range(1, 1401)]
    positive = [(v, int(i % 3 == 0)) for i, (v, _) in enumerate(values)]
    w, p = stats.wilcoxon_p(positive, values)
    monkeypatch.setattr(stats, "STEPWISE", 1 << 20)
    assert 0 < p < 1e-25 and stats.wilcoxon_p(positive, values)[0] == w and abs(stats.wilcoxon_p(positive, values)[1] / p - 1) < 1e-9


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3)], "source long, target long")
    got = tree.reachable(edges, spark.createDataFrame([(0,)], "item long"))
    assert sorted(r.item for r in got.collect()) == list(range(13))
    chain = [("r", "string", f"s{i}", f"@string/s{i + 1}") for i in range(50)] + [("r", "string", "s50", "end"), ("r", "string", "x", "@string/y"), ("r", "string", "y", "@string/x")]
    out = {r.name: r.value for r in resources.resolved_table(spark.createDataFrame(chain, "root string, kind string, name string, value string")).collect()}
    assert all(out[f"s{i}"] == "end" for i in range(51))
