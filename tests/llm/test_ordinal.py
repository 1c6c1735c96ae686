"""The ordinal regression against the likelihood written out, finite differences and a fit without vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from datalode.llm.quality import SIZE, fit, likelihood


def plain(score, grades, thresholds):
    """The mean negative log likelihood, one row at a time."""
    below = lambda k, s: 1.0 if k == len(thresholds) else 0.0 if k < 0 else 1 / (1 + math.exp(s - thresholds[k]))
    return -sum(math.log(below(g, s) - below(g - 1, s)) for s, g in zip(score, grades, strict=True)) / len(grades)


def test_likelihood_and_slopes():
    r = np.random.default_rng(4)
    score, grades, thresholds = r.normal(size=40), r.integers(0, 4, 40), np.array([-1.0, 0.2, 1.5])
    loss, by_score, by_threshold = likelihood(score, grades, thresholds)
    assert loss == pytest.approx(plain(score, grades, thresholds))
    e = 1e-6
    for i in range(40):
        up, down = score.copy(), score.copy()
        up[i] += e
        down[i] -= e
        assert by_score[i] == pytest.approx((plain(up, grades, thresholds) - plain(down, grades, thresholds)) / (2 * e), abs=1e-6)
    for k in range(3):
        up, down = thresholds.copy(), thresholds.copy()
        up[k] += e
        down[k] -= e
        assert by_threshold[k] == pytest.approx((plain(score, grades, up) - plain(score, grades, down)) / (2 * e), abs=1e-6)


def test_fit_step_by_step():
    r = np.random.default_rng(7)
    n, m, levels, steps, l1 = 60, 12, 3, 25, 3e-4
    x = r.random((n, m)) < 0.4
    x[:, 11] = False
    x[:3, 11] = True  # too rare to count
    grades = (x[:, 0].astype(int) + x[:, 1]) % levels
    rows, columns = np.nonzero(x)
    got = fit(rows, columns, grades, levels, least=5, l1=l1, steps=steps)
    use = x.copy()
    use[:, x.sum(axis=0) < 5] = False
    w, sums, t_sums = [0.0] * m, [1e-8] * m, [1e-8] * (levels - 1)
    above = [min(max((grades > g).mean(), 1e-3), 1 - 1e-3) for g in range(levels - 1)]
    t = [-math.log(a / (1 - a)) for a in above]
    t = [max(t[: k + 1][j] + j * 1e-3 for j in range(k + 1)) for k in range(levels - 1)]
    for _ in range(steps):
        score = np.array([sum(w[j] for j in range(m) if use[i, j]) for i in range(n)])
        e = 1e-6
        slope = [(plain([*score[:i], score[i] + e, *score[i + 1 :]], grades, t) - plain([*score[:i], score[i] - e, *score[i + 1 :]], grades, t)) / (2 * e) for i in range(n)]
        g_t = [(plain(score, grades, [*t[:k], t[k] + e, *t[k + 1 :]]) - plain(score, grades, [*t[:k], t[k] - e, *t[k + 1 :]])) / (2 * e) for k in range(levels - 1)]
        for j in range(m):
            g = sum(slope[i] for i in range(n) if use[i, j])
            sums[j] += g * g
            rate = 0.3 / math.sqrt(sums[j])
            w[j] -= rate * g
            w[j] = math.copysign(max(abs(w[j]) - rate * l1, 0), w[j])
        for k in range(levels - 1):
            t_sums[k] += g_t[k] ** 2
            t[k] -= 0.1 / math.sqrt(t_sums[k]) * g_t[k]
        t = [max(t[: k + 1][j] + j * 1e-9 for j in range(k + 1)) for k in range(levels - 1)]
    assert got.weights[:m] == pytest.approx(w, abs=2e-3) and got.thresholds == pytest.approx(t, abs=2e-3)
    assert len(got.weights) == SIZE and got.weights[11] == 0 and got.seen == n
