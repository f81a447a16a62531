"""K-means with several starts and several k at once.

All models (a k and a start each) are fitted together: every Lloyd iteration is
one pass over the points, in which each partition sums its points per model and
centre, so a job moves models x k rows however many points there are.  Starts
are seeded k-means||: a hash of each point, the start and the round decides if
the point is taken as a candidate, so they depend neither on order nor on
partitions.  What the driver holds is centres and candidates (about
``2 * ROUNDS * k`` a model), whose number follows from the parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of candidates of k-means||, each of about ``2 * k``.
ROUNDS = 2


@dataclass
class Model:
    """Centres (a row each) with the points and the squared distances that fall to them."""

    k: int
    start: int
    centres: np.ndarray
    sizes: np.ndarray
    cost: float = float("inf")


def _points(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("x")
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centre of each point, and its squared distance."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _sums(points: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Per model: number and sum of the points of each centre, and the cost; one pass for all models."""
    width = centres[0].shape[1]
    offsets = np.cumsum([0, *[len(c) for c in centres]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cost = np.zeros(offsets[-1]), np.zeros((offsets[-1], width)), np.zeros(offsets[-1])
        for batch in batches:
            x = _points(batch)
            if not len(x):
                continue
            for first, c in zip(offsets, centres):
                at, far = _nearest(x, c)
                end = first + len(c)
                n[first:end] += np.bincount(at, minlength=len(c))
                cost[first:end] += np.bincount(at, far, len(c))
                for d in range(width):
                    total[first:end, d] += np.bincount(at, x[:, d], len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n), pa.array(cost), *[pa.array(total[:, d]) for d in range(width)]],
                                         ["centre", "n", "cost", *[f"s{d}" for d in range(width)]])

    names = ["n", "cost", *[f"s{d}" for d in range(width)]]
    rows = (points.mapInArrow(partial, "centre long, " + ", ".join(f"{c} double" for c in names))
            .groupBy("centre").agg(*[F.sum(c).alias(c) for c in names]).collect())  # a row per centre
    table = np.zeros((offsets[-1], len(names)))
    for r in rows:
        table[r["centre"]] = [r[c] for c in names]
    parts = [table[a:b] for a, b in zip(offsets, offsets[1:])]
    return [p[:, 0] for p in parts], [p[:, 2:] for p in parts], [float(p[:, 1].sum()) for p in parts]


def _draw(u: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from the points' hashes and a salt."""
    x = u.view(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _candidates(points: DataFrame, held: list[np.ndarray], ks: list[int], costs: list[float], salt: int) -> list[np.ndarray]:
    """Each model's candidates and the points taken in a round: each with probability ``2 k distance / cost``."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, u = _points(batch), batch.column("u").to_numpy()
            models, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for m, (c, k, cost) in enumerate(zip(held, ks, costs)):
                if len(x) and cost > 0:
                    hit = np.flatnonzero(_draw(u, salt + m) < 2 * k * _nearest(x, c)[1] / cost)
                    models.append(np.full(len(hit), m))
                    rows.append(hit)
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(models)), batch.column("x").take(pa.array(at))], ["model", "x"])

    found = points.mapInArrow(taken, "model long, x array<double>").distinct().collect()
    out = []
    for m, c in enumerate(held):
        new = sorted(tuple(r["x"]) for r in found if r["model"] == m)
        out.append(np.vstack([c, *[np.array([p]) for p in new]]))
    return out


def _choose(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates by k-means++; fewer if fewer differ."""
    draw = np.random.default_rng(seed)
    far = np.ones(len(candidates))
    picked: list[int] = []
    while len(picked) < k:
        mass = weights * far
        if mass.sum() <= 0:
            break
        picked.append(int(draw.choice(len(candidates), p=mass / mass.sum())))
        away = ((candidates - candidates[picked[-1]]) ** 2).sum(axis=1)
        far = away if len(picked) == 1 else np.minimum(far, away)
    return candidates[picked]


def fit(df: DataFrame, key: str, vec: str, ks: Sequence[int], starts: int, seed: int,
        max_iter: int = 300, tol: float = 1e-4) -> dict[int, Model]:
    """The model of least cost (ties: first start) for each k, out of ``starts`` starts each.

    A start ends when no centre moves by more than ``tol``, or after ``max_iter``
    iterations; starts that have ended leave the pass.  A centre without points
    stays where it is.  Fewer distinct points than k give as many centres as there
    are; no points raise, and ``vec`` must be whole (no nulls).
    """
    points = df.select(F.transform(vec, lambda v: v.cast("double")).alias("x"), F.xxhash64(key, vec).alias("u")).persist()
    try:
        first = points.agg(*[F.min(F.struct(F.xxhash64("u", F.lit(seed + s)), "x")).alias(f"s{s}") for s in range(starts)]).first()
        if first is None or first[0] is None:
            raise ValueError("there are no units to cluster")
        models = [(k, s) for k in ks for s in range(starts)]
        held = [np.array([first[s]["x"]]) for _, s in models]
        for r in range(ROUNDS):
            costs = _sums(points, held)[2]
            held = _candidates(points, held, [k for k, _ in models], costs, (seed * ROUNDS + r) * len(models))
        weights = _sums(points, held)[0]
        centres = [_choose(c, w, k, seed + s) for c, w, (k, s) in zip(held, weights, models)]
        open_, last = list(range(len(models))), set()
        best: dict[int, Model] = {}
        for step in range(max_iter + 1):
            sizes, sums, costs = _sums(points, [centres[m] for m in open_])
            still = []
            for m, n, total, cost in zip(open_, sizes, sums, costs):
                k, s = models[m]
                if m in last or step == max_iter:
                    if k not in best or (cost, s) < (best[k].cost, best[k].start):
                        best[k] = Model(k, s, centres[m], n, cost)
                    continue
                moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[m])
                if ((moved - centres[m]) ** 2).sum(axis=1).max() <= tol * tol:
                    last.add(m)
                centres[m] = moved
                still.append(m)
            open_ = still
            if not open_:
                break
        return best
    finally:
        points.unpersist()
