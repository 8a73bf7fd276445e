"""Series of the held-out bound, and its fitted mixtures."""

from __future__ import annotations

import math

import numpy as np

from toposcope.operators import heldout


def test_series_against_the_standard_library():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.0, 40.0, 1e4])
    assert np.allclose(heldout.log_gamma_np(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)  # series after a shift by 6
    h = 1e-6
    slope = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x[2:]]
    assert np.allclose(heldout.digamma_np(x[2:]), slope, rtol=1e-6, atol=1e-6)
    assert abs(heldout.digamma_np(np.array(1.0)) + 0.5772156649015329) < 1e-9


def test_fitted_mixture_raises_the_bound():
    rng = np.random.default_rng(5)
    lam = rng.gamma(0.5, 20.0, (4, 50)) + 0.1
    elog_beta = heldout.digamma_np(lam) - heldout.digamma_np(lam.sum(axis=1))[:, None]
    counts = rng.integers(0, 4, 50).astype(float)
    fixed, gamma0 = heldout.variational_bound(counts, elog_beta, 0.5, iterations=0)
    # The fixed bound by plain loops.
    k, n = 4, counts.sum()
    g = 0.5 + n / k
    theta = heldout.digamma_np(np.array(g)) - heldout.digamma_np(np.array(k * g))
    plain = sum(c * math.log(sum(math.exp(theta + elog_beta[t, w]) for t in range(k))) for w, c in enumerate(counts))
    plain += k * ((0.5 - g) * theta + math.lgamma(g) - math.lgamma(0.5)) + math.lgamma(k * 0.5) - math.lgamma(k * g)
    assert abs(fixed - plain) < 1e-8 and np.allclose(gamma0, g)
    fitted, gamma = heldout.variational_bound(counts, elog_beta, 0.5, iterations=200)
    assert fitted >= fixed - 1e-9 and abs(gamma.sum() - (k * 0.5 + n)) < 1e-6
