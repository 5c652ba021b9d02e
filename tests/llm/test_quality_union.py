"""The share of good documents that a stratum's rules reject together."""

import numpy as np

from metrika.llm import quality


def chosen(levels, good):
    """The verdict from levels of the rules in columns: every fourth document proposes, the others test."""
    tune = np.arange(len(good)) % 4 == 0
    counts = {}
    for k, (rule, grid) in enumerate(quality.RULES.items()):
        counts["x", rule] = tuple(np.bincount(levels[keep, k], minlength=len(grid) + 1) for keep in ((good == 1) & tune, good == 0))
    path = quality.proposed(counts, 20.0).get("x", [])
    steps = quality.first_steps(path)
    first = np.min([np.array(steps[k])[levels[:, k]] for k in range(len(steps))], axis=0)
    by_step = dict(zip(*np.unique(first[(good == 1) & ~tune], return_counts=True)))
    cutoffs = {("x", r): j for r, j in quality.accepted(path, by_step, 0.02, 0.05).items()}
    hit = np.zeros(len(good), bool)
    for k, rule in enumerate(quality.RULES):
        if ("x", rule) in cutoffs:
            hit |= levels[:, k] > cutoffs["x", rule]
    return cutoffs, hit


def test_the_union_keeps_the_risk():
    n, rules = 40_000, len(quality.RULES)
    good = np.r_[np.ones(n, int), np.zeros(n // 4, int)]
    levels = np.zeros((len(good), rules), int)
    levels[n:] = 30  # a bad document is over every rule's cutoffs up to 29
    for k in range(rules):  # each rule meets good documents of its own, 1.4 %
        levels[k * 560 : (k + 1) * 560, k] = 30
    cutoffs, hit = chosen(levels, good)
    assert cutoffs and hit[good == 0].all()
    assert quality.upper_bound(int(hit[good == 1].sum()), n, 0.05) <= 0.02


def test_rules_that_cost_no_good_documents_are_all_kept():
    n, rules = 40_000, len(quality.RULES)
    good = np.r_[np.ones(n, int), np.zeros(800, int)]
    levels = np.zeros((len(good), rules), int)
    for k in range(rules):  # each rule meets bad documents of its own
        levels[n + k * 100 : n + (k + 1) * 100, k] = 30
    cutoffs, hit = chosen(levels, good)
    assert len(cutoffs) == rules and hit[good == 0].all() and not hit[good == 1].any()


def test_the_guarantee_over_many_draws():
    """A corpus in which rules meet good documents near the risk: the verdict's true rate is over it in 5 % of draws at most."""
    rng = np.random.default_rng(6)
    rules = len(quality.RULES)
    rates = np.full(rules, 0.006)  # true shares of good documents that a rule's lowest cutoffs meet, disjoint: 4.8 % together
    over, draws, some = 0, 60, 0
    for _ in range(draws):
        n = 4000
        good = np.r_[np.ones(n, int), np.zeros(n // 4, int)]
        levels = np.zeros((len(good), rules), int)
        levels[n:] = 30
        which = rng.choice(rules + 1, n, p=[*rates, 1 - rates.sum()])
        for k in range(rules):
            levels[:n][which == k, k] = 30
        cutoffs, _ = chosen(levels, good)
        some += bool(cutoffs)
        true = sum(rates[k] for k, rule in enumerate(quality.RULES) if ("x", rule) in cutoffs and cutoffs["x", rule] < 30)
        over += true > 0.02
    assert some and over <= 0.05 * draws


def test_first_steps_are_those_of_the_verdicts():
    """Each document's first step against the verdicts' definition, step by step; every verdict rejects what those before it reject."""
    rng = np.random.default_rng(3)
    rules = list(quality.RULES)
    counts = {("x", r): (rng.integers(0, 3, 41), rng.integers(0, 30, 41)) for r in rules}
    path = quality.proposed(counts, 0.5)["x"]
    assert len(path) > 40
    for r in rules:
        own = [j for rule, j in path if rule == r]
        assert own == sorted(own, reverse=True)
    steps = quality.first_steps(path)
    for levels in rng.integers(0, 41, (200, len(rules))):
        want = next((i for i, (rule, j) in enumerate(path, 1) if levels[rules.index(rule)] > j), len(path) + 1)
        assert min(steps[k][x] for k, x in enumerate(levels)) == want


def test_few_hundred_documents_suffice_for_several_rules():
    """330 good documents, of which 247 test: three rules that meet none of them reject together."""
    n, rules = 330, len(quality.RULES)
    good = np.r_[np.ones(n, int), np.zeros(30, int)]
    levels = np.zeros((len(good), rules), int)
    for k in range(3):
        levels[n + 10 * k : n + 10 * (k + 1), k] = 30
    cutoffs, hit = chosen(levels, good)
    assert len(cutoffs) == 3 and hit[good == 0].all() and not hit[good == 1].any()
    few = np.r_[0:150, n : n + 30]
    assert chosen(levels[few], good[few])[0] == {}
