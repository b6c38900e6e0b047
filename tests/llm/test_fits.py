"""The fits of the two models against plain searches on small data; no Spark."""

import numpy as np
import pytest

from strophe.llm import boosting, ordinal


@pytest.mark.parametrize("seed", range(6))
def test_first_split_is_the_best_of_all(seed):
    """One tree of one level: every cut of every feature tried by sums over the rows themselves."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (80, 3)).astype(float)
    y = (x[:, seed % 3] + rng.normal(0, 3, 80) > 6).astype(float)
    forest = boosting.fit(x, y, trees=1, depth=1, rate=0.5, least=1.0)
    p = 1 / (1 + np.exp(-forest.base))
    assert forest.base == pytest.approx(np.log((y.sum() + 1) / (80 - y.sum() + 1)))
    g, h = p - y, np.full(80, p * (1 - p))

    def gain(left):
        one = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return 0.0
        return one(left) + one(~left) - g.sum() ** 2 / (h.sum() + 1)

    cuts = {(f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))}
    best = max(gain(x[:, f] <= c) for f, c in cuts)
    chosen = x[:, forest.feature[0, 0]] <= forest.threshold[0, 0]
    assert gain(chosen) == pytest.approx(best) and best > 0
    for leaf, rows in enumerate((chosen, ~chosen)):
        assert forest.value[0, leaf] == pytest.approx(-0.5 * g[rows].sum() / (h[rows].sum() + 1))
    assert forest.margin(x) == pytest.approx(forest.base + np.where(chosen, *forest.value[0]))


def test_more_trees_lower_the_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    loss = [-np.mean(np.log(np.where(y == 1, s, 1 - s))) for s in (boosting.fit(x, y, trees=t, depth=3).score(x) for t in (1, 10, 60))]
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.2


def _loss(rows, grade, w, theta, l2):
    """Mean negative log-likelihood of the cumulative logits, row by row."""
    total = 0.0
    for r, k in zip(rows, grade, strict=True):
        m = sum(w[c] * np.log1p(v) for c, v in r.items())
        over = [1.0, *(1 / (1 + np.exp(-(m - t))) for t in theta), 0.0]
        total -= np.log(max(over[k] - over[k + 1], 1e-12))
    return total / len(rows) + l2 / 2 * (w**2).sum()


def test_likelihood_is_at_its_top():
    """No step away from the fitted weights and thresholds, one by one or at random, lowers the loss."""
    rng = np.random.default_rng(8)
    rows = [{int(c): int(rng.integers(1, 4)) for c in rng.choice(5, rng.integers(0, 4), replace=False)} for _ in range(150)]
    score = np.array([sum((1.5, -1, 0.5, 0, 2)[c] * np.log1p(v) for c, v in r.items()) for r in rows]) + rng.logistic(size=150)
    grade = np.digitize(score, [0.5, 1.5, 3.0])
    w, theta = ordinal.fit(rows, grade, 5, 4, steps=3000, rate=0.05, l2=1e-2)
    assert (np.diff(theta) > 0).all()
    at = _loss(rows, grade, w, theta, 1e-2)
    for k in range(8):
        for size in (-0.05, 0.05):
            move = np.zeros(8)
            move[k] = size
            assert _loss(rows, grade, w + move[:5], theta + move[5:], 1e-2) >= at - 1e-6
    for _ in range(20):
        move = rng.normal(size=8) * 0.1
        if (np.diff(theta + move[5:]) > 0).all():
            assert _loss(rows, grade, w + move[:5], theta + move[5:], 1e-2) >= at - 1e-6
