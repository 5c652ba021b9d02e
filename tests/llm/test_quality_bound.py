"""The exact bound against sums of the distribution, and its cost for large counts."""

import math
import time

import pytest

from metrika.llm import quality as Q


def by_sum(k, n, p):
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


@pytest.mark.parametrize("k, n", [(0, 1), (0, 50), (1, 2), (3, 40), (39, 40), (17, 900), (200, 5000)])
@pytest.mark.parametrize("p", [1e-6, 0.01, 0.3, 0.5, 0.97])
def test_at_most_equals_the_sum(k, n, p):
    assert Q.at_most(k, n, p) == pytest.approx(by_sum(k, n, p), rel=1e-9, abs=1e-13)


@pytest.mark.parametrize("k, n, level", [(0, 300, 1e-4), (5, 700, 1e-5), (40, 3000, 0.01)])
def test_the_bound_is_where_the_probability_is_the_level(k, n, level):
    p = Q.upper_bound(k, n, level)
    assert by_sum(k, n, p) == pytest.approx(level, rel=1e-6) and p > k / n


def test_none_and_all():
    assert Q.upper_bound(0, 0, 0.01) == 1.0 and Q.upper_bound(4, 4, 0.01) == 1.0
    assert Q.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05**0.01)


def test_large_counts_cost_no_more(capsys):
    start = time.time()
    p = Q.upper_bound(10_000_000, 1_000_000_000, 1e-5)
    assert 0.01 < p < 0.0101 and time.time() - start < 2
