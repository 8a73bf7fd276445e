"""Held-out bound of LDA documents from given topics: the per-document part of the variational bound.

For a document with term counts n_w, topics with Dirichlet parameters λ (k × terms) and a mixture γ (k),

    bound = Σ_w n_w log Σ_k exp(E[log θ_k] + E[log β_kw]) + Σ_k ((α − γ_k) E[log θ_k] + lgamma(γ_k) − lgamma(α))
            + lgamma(kα) − lgamma(Σ_k γ_k),

with E[log θ_k] = ψ(γ_k) − ψ(Σγ) and E[log β_kw] = ψ(λ_kw) − ψ(Σ_w λ_kw). ``variational_bound`` fits γ by the
usual fixed-point steps (in numpy, for a fitted model's topics); ``fixed_mixture_bounds`` is the same bound with
the uniform mixture γ_k = α + N/k, which SQL can state. ψ and lgamma are series after a shift by 6, written as
column expressions, so the tasks compute them without Python and SQL can use the same ones.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposcope.settings import stored

SHIFT = 6


def digamma(x: Column) -> Column:
    """ψ(x) for x > 0: the asymptotic series at x + 6, less 1/x + … + 1/(x + 5)."""
    y = x + SHIFT
    inv = 1 / y
    inv2 = inv * inv
    series = F.log(y) - 0.5 * inv - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return series - sum((1 / (x + i) for i in range(SHIFT)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """log Γ(x) for x > 0: Stirling's series at x + 6, less log x + … + log(x + 5)."""
    y = x + SHIFT
    inv = 1 / y
    inv2 = inv * inv
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    return series - sum((F.log(x + i) for i in range(SHIFT)), F.lit(0.0))


def digamma_np(x: np.ndarray) -> np.ndarray:
    """The same series as ``digamma``, for arrays."""
    x = np.asarray(x, np.float64)
    y = x + SHIFT
    inv2 = 1 / (y * y)
    series = np.log(y) - 0.5 / y - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return series - sum(1 / (x + i) for i in range(SHIFT))


def log_gamma_np(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    y = x + SHIFT
    inv2 = 1 / (y * y)
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / y) * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    return series - sum(np.log(x + i) for i in range(SHIFT))


def variational_bound(counts: np.ndarray, elog_beta: np.ndarray, alpha: float, iterations: int = 100, tol: float = 1e-8) -> tuple[float, np.ndarray]:
    """``(bound, γ)`` of one document: ``counts`` (m), ``elog_beta`` (k × m) of its terms; γ starts uniform."""
    k = elog_beta.shape[0]
    gamma = np.full(k, alpha + counts.sum() / k)
    exp_beta = np.exp(elog_beta)
    for _ in range(iterations):
        exp_theta = np.exp(digamma_np(gamma) - digamma_np(gamma.sum()))
        new = alpha + exp_theta * (exp_beta @ (counts / (exp_theta @ exp_beta)))
        done = np.abs(new - gamma).mean() < tol
        gamma = new
        if done:
            break
    elog_theta = digamma_np(gamma) - digamma_np(gamma.sum())
    top = (elog_theta[:, None] + elog_beta).max(axis=0)
    fit = counts @ (top + np.log(np.exp(elog_theta[:, None] + elog_beta - top).sum(axis=0)))
    rest = ((alpha - gamma) * elog_theta + log_gamma_np(gamma) - log_gamma_np(np.full(k, alpha))).sum()
    return float(fit + rest + log_gamma_np(np.array(k * alpha)) - log_gamma_np(np.array(gamma.sum()))), gamma


def topic_expectations(train: DataFrame, vocab: DataFrame, topics: list, eta: float) -> DataFrame:
    """``(term, lse)``: log Σ_k exp E[log β_kw] for every vocabulary term, λ_kw = η + its count in topic k.

    ``train`` has ``(term, topic, tf)``; ``topics`` names the k topics. One pivot per term, no cross join. The
    parameters are stored: their sums and the terms both read them.
    """
    sums = train.groupBy("term").pivot("topic", topics).agg(F.sum("tf"))
    lam = stored(vocab.select("term").join(sums, "term", "left").select("term", F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0)) + eta for t in topics]).alias("lam")))
    totals = lam.agg(F.array(*[F.sum(F.element_at("lam", i + 1)) for i in range(len(topics))])).scalar()  # k sums, one subquery
    elog = [digamma(F.element_at("lam", i + 1)) - digamma(F.element_at(totals, i + 1)) for i in range(len(topics))]
    return lam.select("term", F.log(sum((F.exp(e) for e in elog), F.lit(0.0))).alias("lse"))


def fixed_mixture_bounds(held: DataFrame, expectations: DataFrame, key: tuple[str, ...], k: int, alpha: float) -> DataFrame:
    """``(key, tokens, bound)`` of held-out rows ``(key, term, tf)`` under the uniform mixture γ_k = α + N/k."""
    per_doc = held.join(expectations, "term").groupBy(*key).agg(F.sum("tf").alias("tokens"), F.sum(F.col("tf") * F.col("lse")).alias("fit"))
    gamma = F.lit(alpha) + F.col("tokens") / k
    elog_theta = digamma(gamma) - digamma(gamma * k)
    bound = F.col("tokens") * elog_theta + F.col("fit") + k * ((F.lit(alpha) - gamma) * elog_theta + log_gamma(gamma) - log_gamma(F.lit(alpha)))
    return per_doc.select(*key, "tokens", (bound + log_gamma(F.lit(k * alpha)) - log_gamma(gamma * k)).alias("bound"))
