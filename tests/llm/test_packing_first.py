"""The packing search's first solution: whole, valid, never worse than best-fit, and well below it where that pairs long pieces."""

import random
from collections import Counter

import pytest

from rareflow.llm import packing


@pytest.mark.parametrize("low,high,n,share", [(1000, 1999, 2000, 0.955), (1100, 1900, 1000, 0.955), (1300, 1500, 300, 0.95), (1, 4096, 3000, 1), (4096, 4096, 7, 1), (1, 3, 50, 1), (1366, 2048, 500, 1)])
def test_first_solution(low, high, n, share):
    r = random.Random(n)
    hist = Counter(r.randint(low, high) for _ in range(n))
    bound = packing.lower_bound(hist, 4096)
    found = packing.first_solution(hist, 4096, bound)
    used = Counter()
    for times, pattern in found:
        assert times > 0 and sum(x * c for x, c in pattern) <= 4096
        for x, c in pattern:
            used[x] += times * c
    assert used == hist
    assert bound <= sum(t for t, _ in found) <= share * sum(t for t, _ in packing.best_fit_decreasing(hist, 4096))


def test_fullest_bins_hold_all_pieces():
    r = random.Random(1)
    for _ in range(200):
        hist = Counter(r.randint(1, 60) for _ in range(r.randint(1, 40)))
        bins, work = packing.fullest_bins(hist, 60)
        used = Counter()
        for times, pattern in bins:
            assert sum(x * c for x, c in pattern) <= 60
            used.update({x: times * c for x, c in pattern})
        assert used == hist and work >= 0


def test_the_budget_ends_the_trials(monkeypatch):
    monkeypatch.setattr(packing, "WORK", -1)
    hist = Counter(random.Random(3).randint(1000, 1999) for _ in range(300))
    assert packing.first_solution(hist, 4096, packing.lower_bound(hist, 4096)) == packing.best_fit_decreasing(hist, 4096)
