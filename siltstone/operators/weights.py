"""Weights of six ranking features: the search for those under which an event's used rows would have ranked first."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: weights to begin with (lexical, vector, graph, episode, support, diversity), and the search's settings
DEFAULT = (0.45, 0.45, 0.04, 0.03, 0.02, 0.01)
SHARES = (0.25, 0.5, 0.75)
STEPS = 10
PROPOSALS = 16
LENGTH_SCALE = 0.30
NOISE = 0.02
SOFT_RANK = 0.05


def normalized(w: np.ndarray) -> np.ndarray:
    w = np.where(np.isfinite(w) & (w > 0), w, 0.0)
    return w / w.sum() if w.sum() > 2.3e-16 else np.array(DEFAULT)


def distinct(rows: np.ndarray) -> np.ndarray:
    """Rows that differ from all before them by 1e-12 or more somewhere."""
    same = (np.abs(rows[:, None] - rows[None]) < 1e-12).all(2)
    return rows[np.triu(same).argmax(0) == np.arange(len(rows))]


@lru_cache(1)
def _fixed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates that every event has; the grid of the simplex; the kernel between the two."""
    d = len(DEFAULT)
    two = []
    for i, j in combinations(range(d), 2):
        for x in SHARES:
            w = np.zeros(d)
            w[i], w[j] = x, 1 - x
            two.append(w)
    start = distinct(np.array([normalized(np.array(DEFAULT)), *np.eye(d), *two]))
    # all ways to deal STEPS parts to d features: bars among stars, in lexicographic order
    bars = np.array(list(combinations(range(STEPS + d - 1), d - 1)))
    edges = np.hstack([np.full((len(bars), 1), -1), bars, np.full((len(bars), 1), STEPS + d - 1)])
    grid = (np.diff(edges, axis=1) - 1) / STEPS
    return start, grid, kernel(grid, start)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * LENGTH_SCALE**2))


def rewards(scores: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Of each row of scores: the sum of label / rank, where equal scores share the mean of their reciprocal ranks."""
    delta = scores[:, None, :] - scores[:, :, None]
    tied = np.abs(delta) < 1e-12
    above, size = ((delta > 0) & ~tied).sum(2), tied.sum(2)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, scores.shape[1] + 1))])
    return ((harmonic[above + size] - harmonic[above]) / size) @ label


def soft_rewards(scores: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The same for used rows, with the expected number of rows above each, so that it changes with every weight."""
    x = np.clip((scores[:, None, :] - scores[:, :, None]) / SOFT_RANK, -40, 40)
    above = (1 / (1 + np.exp(-x))).sum(2) - 0.5  # without the row itself
    return (1 / (1 + above)) @ used


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, best: float) -> np.ndarray:
    z = (mean - best) / deviation
    cdf = 0.5 * (1 + np.array([math.erf(x) for x in (z / math.sqrt(2)).tolist()]))
    return np.maximum((mean - best) * cdf + deviation * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi), 0.0)


def search(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The mean of the weights with the greatest reward among the candidates, and that reward; None without a used row, with
    equal features in all rows, or if all candidates do equally well.

    Candidates: the default, single features, pairs of features, the mean of the used rows' features, how far these lie
    above those of the others, and the points of a grid that promise the greatest expected improvement of the soft reward,
    by a kernel estimate from the candidates before.
    """
    x = np.where(np.isfinite(x) & (x >= 0), x, 0.0)
    used = (label > 0).astype(float)
    if not used.any() or (np.abs(x - x[0]) <= 1e-12).all():
        return None
    start, grid, known = _fixed()
    own = []
    if (total := x[used > 0].sum(0)).max() > 2.3e-16:
        own.append(normalized(total))
    if (used == 0).any() and (gap := np.maximum(x[used > 0].mean(0) - x[used == 0].mean(0), 0)).max() > 2.3e-16:
        own.append(normalized(gap))
    tried = distinct(np.vstack([start, *own]))
    more = tried[len(start) :]
    near = np.hstack([known, kernel(grid, more)]) if len(more) else known
    seen = soft_rewards(tried @ x.T, used)
    mean = near @ seen / near.sum(1)
    nearest = near.max(1)
    deviation = np.sqrt(np.maximum(max(seen.var(), 1e-6) * np.clip(1 - nearest / (nearest + NOISE), 0, 1), 1e-12))
    gain = expected_improvement(mean, deviation, seen.max())
    order = np.lexsort((-mean, -gain))[: PROPOSALS + len(tried)]  # stable, and the grid is in lexicographic order
    free = (np.abs(grid[order][:, None] - tried[None]) >= 1e-12).any(2).all(1) & (gain[order] > 0)
    order = order[free][:PROPOSALS]
    tried = np.vstack([tried, grid[order]])
    reward = rewards(tried @ x.T, label)
    if reward.max() - reward.min() < 1e-12:
        return None
    return normalized(tried[np.abs(reward - reward.max()) < 1e-12].sum(0)), float(reward.max())


#: Events of one size that are searched at a time.
TOGETHER = 64


@lru_cache(1)
def _known() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the fixed candidates and the grid: the kernel's sums and maxima, and which points of the grid are candidates."""
    start, grid, known = _fixed()
    return known.sum(1), known.max(1), (np.abs(grid[:, None] - start[None]) < 1e-12).all(2).any(1)


def _each_normalized(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that add up to 1, and which of them had something to add up."""
    ok = w.max(1) > 2.3e-16
    return np.where(ok[:, None], w / np.where(ok, w.sum(1), 1.0)[:, None], 0.0), ok


def search_many(x: np.ndarray, label: np.ndarray) -> list[tuple[np.ndarray, float] | None]:
    """`search` of many events with equally many rows: features (event, row, feature) and labels (event, row).

    What every event does on the whole grid is done for all of them at once.  Expected improvements are worked out only where
    a bound of them, the density's part, reaches the least that is wanted.
    """
    out: list[tuple[np.ndarray, float] | None] = [None] * len(x)
    x = np.where(np.isfinite(x) & (x >= 0), x, 0.0)
    at = np.flatnonzero((label > 0).any(1) & ~(np.abs(x - x[:, :1]) <= 1e-12).all((1, 2)))
    if not len(at):
        return out
    start, grid, known = _fixed()
    sums, most, taken = _known()
    x, label = x[at], label[at]
    used = (label > 0).astype(float)
    n_used, n_other = used.sum(1), (1 - used).sum(1)
    total = (x * used[:, :, None]).sum(1)
    own, ok = _each_normalized(total)
    rest = (x * (1 - used)[:, :, None]).sum(1) / np.maximum(n_other, 1)[:, None]
    gap, gap_ok = _each_normalized(np.maximum(total / n_used[:, None] - rest, 0.0))
    gap_ok &= n_other > 0
    new = lambda w: ~(np.abs(w[:, None] - start[None]) < 1e-12).all(2).any(1)
    gap_ok &= new(gap) & ~(ok & (np.abs(own - gap) < 1e-12).all(1))
    ok &= new(own)
    more, has = np.stack([own, gap], 1), np.stack([ok, gap_ok], 1)
    tried = np.concatenate([np.broadcast_to(start, (len(x), *start.shape)), more], 1)
    there = np.hstack([np.ones((len(x), len(start)), bool), has])
    scores = tried @ x.transpose(0, 2, 1)
    apart = np.clip((scores[:, :, None, :] - scores[:, :, :, None]) / SOFT_RANK, -40, 40)
    above = (1 / (1 + np.exp(-apart))).sum(3) - 0.5
    seen = (1 / (1 + above) * used[:, None, :]).sum(2)
    near = np.exp(-((grid**2).sum(1) + (more**2).sum(2)[:, :, None] - 2 * more @ grid.T) / (2 * LENGTH_SCALE**2)) * has[:, :, None]
    mean = (seen[:, : len(start)] @ known.T + (near * seen[:, len(start) :, None]).sum(1)) / (sums + near.sum(1))
    nearest = np.maximum(most, near.max(1))
    count = there.sum(1)
    middle = (seen * there).sum(1) / count
    spread = np.maximum((((seen - middle[:, None]) ** 2) * there).sum(1) / count, 1e-6)
    deviation = np.sqrt(np.maximum(spread[:, None] * np.clip(1 - nearest / (nearest + NOISE), 0, 1), 1e-12))
    best = np.where(there, seen, -np.inf).max(1)
    over = mean - best[:, None]
    bound = (deviation * np.exp(-0.5 * (over / deviation) ** 2) / math.sqrt(2 * math.pi) + np.maximum(over, 0)) * (1 + 1e-9)
    for e, i in enumerate(at.tolist()):
        wanted = PROPOSALS + int(count[e])
        first = np.argpartition(bound[e], -wanted)[-wanted:]
        least = expected_improvement(mean[e, first], deviation[e, first], best[e]).min()
        some = np.flatnonzero(bound[e] >= least)
        gain = expected_improvement(mean[e, some], deviation[e, some], best[e])
        order = np.lexsort((-mean[e, some], -gain))[:wanted]
        gain, order = gain[order], some[order]
        mine = more[e][has[e]]
        free = ~taken[order] & (gain > 0) & (np.abs(grid[order][:, None] - mine[None]) >= 1e-12).any(2).all(1)
        all_tried = np.vstack([start, mine, grid[order[free][:PROPOSALS]]])
        reward = rewards(all_tried @ x[e].T, label[e])
        if reward.max() - reward.min() >= 1e-12:
            out[i] = normalized(all_tried[np.abs(reward - reward.max()) < 1e-12].sum(0)), float(reward.max())
    return out


def best_weights(candidates: DataFrame) -> DataFrame:
    """event, weights, reward of every event with a signal.  candidates: event, id, features (six), label (1 used, -1
    unhelpful, 0 else); a recall returns few candidates, so an event fits into a row."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            n, rows = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64), lists.flatten()
            whole = np.asarray(rows.field("features").flatten(), float)
            labels = np.asarray(rows.field("label").cast(pa.float64()), float)
            whole = whole.reshape(len(labels), -1)
            begins, events = np.cumsum(n) - n, b.column(0)
            found, weights, reward = [], [], []
            for size in np.unique(n[n > 0]).tolist():
                same = np.flatnonzero(n == size)
                step = max(1, min(TOGETHER, 4096 // size**2))
                for some in (same[i : i + step] for i in range(0, len(same), step)):
                    at = begins[some][:, None] + np.arange(size)
                    for e, r in zip(some.tolist(), search_many(whole[at], labels[at]), strict=True):
                        if r:
                            found.append(e)
                            weights.append(r[0].tolist())
                            reward.append(r[1])
            yield pa.record_batch([events.take(pa.array(found, pa.int64())), pa.array(weights, pa.list_(pa.float64())), pa.array(reward, pa.float64())], ["event", "weights", "reward"])

    events = candidates.groupBy(F.col("event").cast("long").alias("event")).agg(F.array_sort(F.collect_list(F.struct("id", "features", "label"))).alias("c"))
    return events.mapInArrow(run, "event long, weights array<double>, reward double")
