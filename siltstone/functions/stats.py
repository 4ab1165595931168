"""Statistics of aggregates, in plain Python: they work on a handful of numbers at the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def normal_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def rbf(a: Sequence[float], b: Sequence[float], scale: float) -> float:
    return math.exp(-sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) / (2 * scale * scale))


def expected_improvement(mean: float, deviation: float, best: float) -> float:
    if deviation <= 0:
        return max(0.0, mean - best)
    z = (mean - best) / deviation
    return (mean - best) * normal_cdf(z) + deviation * normal_pdf(z)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p-value of k of n at 1/2."""
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail / 2**n)


def mcnemar(both: int, only_a: int, only_b: int, neither: int) -> dict[str, float]:
    """Paired outcomes: p-value (exact below 25 discordant pairs, else chi-square with continuity correction), the
    difference of b over a, and its 95 % Wald interval."""
    n, d = both + only_a + only_b + neither, only_a + only_b
    if d < 25:
        p = binomial_two_sided(only_a, d)
    else:
        chi = (abs(only_a - only_b) - 1) ** 2 / d
        p = math.erfc(math.sqrt(chi / 2))
    if n == 0:
        return {"n": 0, "p": 1.0, "delta": 0.0, "low": 0.0, "high": 0.0}
    delta = (only_b - only_a) / n
    half = 1.96 * math.sqrt(max(0.0, d - (only_b - only_a) ** 2 / n)) / n
    return {"n": n, "p": p, "delta": delta, "low": delta - half, "high": delta + half}


def binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in log))


def clopper_pearson_upper(k: int, n: int, alpha: float = 0.05) -> float:
    """One-sided upper bound of a proportion."""
    if n == 0 or k >= n:
        return 1.0
    if k == 0:
        return 1 - alpha ** (1 / n)
    low, high = k / n, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > alpha else (low, mid)
    return (low + high) / 2


def verdict(low: float, high: float, margin: float = 0.02) -> str:
    """Of the interval of a difference: ship it, bail out, or not enough data."""
    return "ship" if low >= -margin else "bail" if high <= -margin else "no_data"


def kappa(yy: int, yn: int, ny: int, nn: int) -> float | None:
    """Cohen's kappa of two raters; with one class only, their agreement."""
    n = yy + yn + ny + nn
    if not n:
        return None
    observed = (yy + nn) / n
    chance = ((yy + yn) * (yy + ny) + (ny + nn) * (yn + nn)) / n**2
    return observed if abs(1 - chance) < 1e-12 else (observed - chance) / (1 - chance)


def trust(evidence: float, prior: float, consistency: float = 1.0, stability: float = 1.0, margin: float = 1.0, weight: float = 1.0) -> float:
    return max(0.0, min(1.0, evidence / (evidence + prior) * consistency * stability * margin * weight)) if evidence + prior > 0 else 0.0


def blend(old: float, new: float, share: float, step: float) -> float:
    """Towards new by a share, by no more than a step."""
    return old + max(-step, min(step, share * (new - old)))


def blend_simplex(old: Sequence[float], new: Sequence[float], share: float, step: float) -> list[float]:
    out = [max(0.0, blend(a, b, share, step)) for a, b in zip(old, new, strict=True)]
    total = sum(out)
    return [x / total for x in out] if total > 0 else list(old)


def nearest_rank(values: Sequence[float], q: float) -> float:
    s = sorted(values)
    return s[max(0, min(len(s) - 1, math.ceil(q * len(s)) - 1))]


def bootstrap_interval(values: Sequence[float], rounds: int = 1000, seed: int = 1, level: float = 0.95) -> tuple[float, float]:
    """Percentile interval of the mean, resampled by a xorshift generator so that it can be repeated anywhere."""
    if not values:
        return 0.0, 0.0
    mask, state, means = (1 << 64) - 1, seed or 1, []
    for _ in range(rounds):
        total = 0.0
        for _ in values:
            state ^= state >> 12
            state = (state ^ (state << 25)) & mask
            state ^= state >> 27
            total += values[((state * 0x2545F4914F6CDD1D) & mask) % len(values)]
        means.append(total / len(values))
    return nearest_rank(means, (1 - level) / 2), nearest_rank(means, 1 - (1 - level) / 2)
