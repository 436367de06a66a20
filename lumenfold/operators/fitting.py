"""Models of preference fitted as Spark jobs: a pairwise ranker, the keeper head, direct weights, folds and bootstraps.

Pairs stay where they are.  One pass computes loss, gradient and curvature for *many* models at once, which differ in
how they weigh the pairs: all pairs, all but a fold's, or a resample.  A task adds its pairs up and hands on one
record (models x (1 + d + d x d) numbers, whatever the number of pairs), records are added in a second round of tasks,
and the driver, which sees some tens of them, takes one Newton step for every model.  The pairs are written once and
read in each pass, so a lost executor costs its own part of one pass.

Resamples are Poisson weights from a hash of (pair, replicate), so a pair's weights are the same wherever and whenever
it is read, and 100 replicates take as many passes as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.learning import simplex_box
from lumenfold.sources.tables import checkpointed, workers_import

# --- Fixed values: regularisation, folds, gates, reliability of sources, ties, bounds -----------------------------
STRENGTH, FOLDS, GATE_POINTS, SHRINK = 1.0, 5, 2.0, 50.0
RELIABILITY = {"vote": 1.0, "rating": 0.7, "culling": 0.5}
TIE_SENSITIVITY, RIDGE, MOST, REPLICATES = 0.1, 0.01, 0.6, 100
# --------------------------------------------------------------------------------------------------------------------
PRIME = 2**31 - 1
#: Cumulative probabilities of a Poisson variable of mean 1.
POISSON = tuple(float(x) for x in np.cumsum([exp(-1) / factorial(k) for k in range(10)]))


# ------------------------------------------------------------------------------------------------------------ pairs


def compared(pairs: DataFrame, rows: DataFrame, key: str, features: str, baseline: str | None = None, folds: int = FOLDS) -> DataFrame:
    """Pairs (a, b, y, weight) with both sides' features: d (the difference), scale (both sides), base (difference of
    the baseline score), key (a hash of the pair) and fold (by that hash).

    y is 1 where a won, 0 where b did, 0.5 for a tie; pairs of which a side has no features, or whose sides' have
    different lengths, are left out."""
    score = F.col(baseline) if baseline else F.lit(0.0)
    side = lambda x: rows.select(F.col(key).alias(x), F.col(features).cast("array<double>").alias(f"f{x}"), score.cast("double").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("size(fa) = size(fb) and size(fa) > 0")
    hashed = F.pmod(F.xxhash64("a", "b"), F.lit(PRIME))
    return both.select("a", "b", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"), F.zip_with("fa", "fb", lambda x, y: x - y).alias("d"), "fa", "fb", (F.coalesce("sa", F.lit(0.0)) - F.coalesce("sb", F.lit(0.0))).alias("base"), hashed.alias("key"), F.pmod(hashed, F.lit(folds)).cast("int").alias("fold"))


def _added(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of what ``part`` gives for every task's rows, added by tasks first."""
    workers_import(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(batches).astype(np.float64).tobytes()], pa.binary())], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for s in batch.column("s").to_pylist():
                total += np.frombuffer(s).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    found = rows.mapInArrow(each, "s binary").repartition(16).mapInArrow(add, "s binary").collect()  # 16 records
    return np.sum([np.frombuffer(bytes(r["s"])).reshape(shape) for r in found], axis=0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def spread(pairs: DataFrame, size: int) -> np.ndarray:
    """Standard deviation of each feature over both sides of all pairs (1e-6 at least), in one pass."""

    def part(batches):
        total = np.zeros((3, size))
        for batch in batches:
            for name in ("fa", "fb"):
                x = _matrix(batch, name)
                total += np.stack([np.full(size, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
        return total

    n, first, second = _added(pairs.select("fa", "fb"), part, (3, size))
    n = np.maximum(n, 1)
    return np.maximum(np.sqrt(np.maximum(0.0, second / n - (first / n) ** 2)), 1e-6)


# ----------------------------------------------------------------------------------------------------------- passes


def poisson(key: np.ndarray, replicates: range) -> np.ndarray:
    """Resampling weights (pairs x replicates): a pairwise independent hash of each, as a Poisson variable of mean 1."""
    a, b = (np.array([pow(g, r + 1, PRIME) for r in replicates]) for g in (48271, 16807))
    u = (key[:, None] * a[None, :] + b[None, :]) % PRIME / PRIME
    return np.searchsorted(POISSON, u, side="right").astype(float)


def poisson_column(key: Column, replicate: int) -> Column:
    """The same weight as a column."""
    u = F.pmod(key * pow(48271, replicate + 1, PRIME) + pow(16807, replicate + 1, PRIME), F.lit(PRIME)) / PRIME
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def weigh_folds(folds: int) -> Callable:
    """Model 0 reads all pairs, model k + 1 all but those of fold k."""
    return lambda key, fold: np.concatenate([np.ones((len(fold), 1)), fold[:, None] != np.arange(folds)[None, :]], axis=1).astype(float)


def weigh_replicates(n: int) -> Callable:
    return lambda key, fold: poisson(key, range(n))


def derivatives(pairs: DataFrame, scale: np.ndarray, betas: np.ndarray, weigh: Callable, tie: float | None = None, offset: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss (m), gradient (m, d) and curvature (m, d, d) of m models over all pairs, in one pass.

    Decided pairs cost their logistic loss; ties, where ``tie`` is given, (score / tie) ** 2, else nothing.  ``offset``
    is a column that is added to the score of every model."""
    m, d = betas.shape

    def part(batches):
        total = np.zeros((m, 1 + d + d * d))
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                x, y, w = _matrix(batch, "d") / scale, batch.column("y").to_numpy(), batch.column("weight").to_numpy()
                w = w[:, None] * weigh(batch.column("key").to_numpy(), batch.column("fold").to_numpy())
                z = x @ betas.T + (batch.column("off").to_numpy()[:, None] if offset else 0.0)
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                even = (y == 0.5)[:, None]
                t = (lambda v: v) if tie else (lambda v: 0.0 * v)
                scaled = 2 / (tie or 1.0) ** 2
                loss = np.where(even, t(z * z * scaled / 2), np.logaddexp(0.0, np.where(y[:, None] == 1, -z, z)))
                slope = w * np.where(even, t(z * scaled), p - y[:, None])
                bend = w * np.where(even, t(np.full_like(z, scaled)), p * (1 - p))
                total[:, 0] += (w * loss).sum(axis=0)
                total[:, 1 : 1 + d] += slope.T @ x
                for k in range(m):
                    total[k, 1 + d :] += ((x * bend[:, k : k + 1]).T @ x).ravel()
        return total

    columns = ["d", "y", "weight", "key", "fold"] + ([F.col(offset).alias("off")] if offset else [])
    s = _added(pairs.select(*columns), part, (m, 1 + d + d * d))
    return s[:, 0], s[:, 1 : 1 + d], s[:, 1 + d :].reshape(m, d, d)


def right(pairs: DataFrame, scale: np.ndarray, betas: np.ndarray, folds: int, offset: str | None = None) -> np.ndarray:
    """Decided pairs and right ones: [n, by model 0, by the baseline] and for each fold [n, by the fold's own model]."""

    def part(batches):
        total = np.zeros(3 + 2 * folds)
        for batch in batches:
            x, y, fold = _matrix(batch, "d") / scale, batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            won = ((x @ betas.T + (batch.column("off").to_numpy()[:, None] if offset else 0.0)) > 0) == (y[:, None] == 1)
            decided = y != 0.5
            total[:3] += decided.sum(), (won[:, 0] & decided).sum(), (((batch.column("base").to_numpy() > 0) == (y == 1)) & decided).sum()
            for k in range(folds):
                own = decided & (fold == k)
                total[3 + 2 * k : 5 + 2 * k] += own.sum(), (won[:, k + 1] & own).sum()
        return total

    columns = ["d", "y", "fold", "base"] + ([F.col(offset).alias("off")] if offset else [])
    return _added(pairs.select(*columns), part, (3 + 2 * folds,))


# ----------------------------------------------------------------------------------------------------------- models


@dataclass
class Fit:
    """A fitted model and how it did on pairs that it had not seen."""

    weights: np.ndarray
    scale: np.ndarray
    n_pairs: int = 0
    baseline: float = 0.0
    held_out: float = 0.0
    trained: float = 0.0
    gate: float = GATE_POINTS
    extra: dict = field(default_factory=dict)

    @property
    def improvement(self) -> float:
        return self.held_out - self.baseline

    @property
    def passed(self) -> bool:
        """Whether it beats the baseline on held-out pairs by the gate's points; else nothing is to be written."""
        return self.n_pairs > 0 and self.improvement >= self.gate

    def score(self, features: str) -> Column:
        parts = F.array(*(F.lit(float(w)) for w in self.weights / self.scale))
        return F.aggregate(F.zip_with(F.col(features).cast("array<double>"), parts, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


def _judged(fit: Fit, counts: np.ndarray, folds: int) -> Fit:
    n, own, base = counts[:3]
    held = [counts[4 + 2 * k] / counts[3 + 2 * k] for k in range(folds) if counts[3 + 2 * k]]
    fit.n_pairs, fit.trained, fit.baseline = int(n), float(100 * own / max(n, 1)), float(100 * base / max(n, 1))
    fit.held_out = 100 * float(np.mean(held)) if held else 0.0
    return fit


def ranker(pairs: DataFrame, size: int, strength: float = STRENGTH, folds: int = FOLDS, prior: str | None = None, shrink: float = SHRINK, steps: int = 30) -> Fit:
    """Logistic model of the pairs (no intercept, each pair seen from both sides), its folds' models beside it.

    With ``prior``, a column with a prior's difference of scores, the model learns what to add to it, and the result
    says how much of what was added counts: n / (n + shrink) of it."""
    rows = checkpointed(pairs.where("y <> 0.5"))
    scale = spread(rows, size)
    betas = np.zeros((folds + 1, size))
    for _ in range(steps):
        _, slope, bend = derivatives(rows, scale, betas, weigh_folds(folds), offset=prior)
        slope, bend = 2 * strength * slope + betas, 2 * strength * bend + np.eye(size)
        step = np.stack([np.linalg.solve(h, g) for h, g in zip(bend, slope, strict=True)])
        betas = betas - step * np.minimum(1.0, 10 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    fit = _judged(Fit(betas[0], scale), right(rows, scale, betas, folds, prior), folds)
    fit.extra["share"] = fit.n_pairs / (fit.n_pairs + shrink) if prior else 1.0
    return fit


def _constrained(h: np.ndarray, g: np.ndarray, w: np.ndarray, most: float) -> np.ndarray:
    """The weights in the box and on the simplex that minimise the quadratic model at ``w`` (few numbers: driver)."""
    x, rate = w.copy(), 1 / max(float(np.linalg.eigvalsh(h)[-1]), 1e-12)
    y, t = x, 1.0
    for _ in range(500):
        new = simplex_box(y - rate * (g + h @ (y - w)), most)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, moved = new + (before - 1) / t * (new - x), float(np.abs(new - x).max())
        x = new
        if moved < 1e-12:
            break
    return x


def direct_weights(pairs: DataFrame, start: np.ndarray, weigh: Callable, models: int, ridge: float = RIDGE, tie: float = TIE_SENSITIVITY + 0.1, most: float = MOST, steps: int = 15) -> np.ndarray:
    """Weights (models x d) within [0, most] that sum to 1 and cost least: Bradley-Terry for decided pairs, a square for
    ties, and a ridge towards ``start``.  Each step solves a quadratic model, halved while it does not pay."""
    one = np.ones(len(start))
    w = np.repeat(start[None, :], models, axis=0)
    cost = lambda loss, x: loss + ridge * ((x - start) ** 2).sum(axis=1)
    loss, slope, bend = derivatives(pairs, one, w, weigh, tie)
    for _ in range(steps):
        aim = np.stack([_constrained(h + 2 * ridge * np.eye(len(start)), g + 2 * ridge * (x - start), x, most) for h, g, x in zip(bend, slope, w, strict=True)])
        if np.abs(aim - w).max() < 1e-7:
            break
        for _ in range(6):
            new_loss, new_slope, new_bend = derivatives(pairs, one, aim, weigh, tie)
            worse = cost(new_loss, aim) > cost(loss, w) + 1e-9
            if not worse.any():
                break
            aim = np.where(worse[:, None], (aim + w) / 2, aim)
        w, loss, slope, bend = aim, new_loss, new_slope, new_bend
    return w


def weights_with_folds(pairs: DataFrame, size: int, old: np.ndarray | None = None, folds: int = FOLDS) -> Fit:
    """Direct weights over all pairs, and their accuracy on held-out folds against that of the old weights."""
    rows = checkpointed(pairs)
    start = np.full(size, 1 / size) if old is None else old / old.sum()
    w = direct_weights(rows, start, weigh_folds(folds), folds + 1)
    one = np.ones(size)
    fit = _judged(Fit(w[0], one), right(rows, one, w, folds), folds)
    counts = right(rows, one, np.repeat(start[None, :], folds + 1, axis=0), folds)
    fit.baseline = float(100 * counts[1] / max(counts[0], 1))
    return fit


def weight_intervals(pairs: DataFrame, size: int, replicates: int = REPLICATES) -> np.ndarray:
    """Median, 2.5 and 97.5 percentile of each weight (3 x d) over resamples of the pairs, all fitted at once."""
    w = direct_weights(checkpointed(pairs), np.full(size, 1 / size), weigh_replicates(replicates), replicates, ridge=0.0)
    middle, low, high = np.percentile(w, [50, 2.5, 97.5], axis=0)
    return np.stack([middle / middle.sum(), low, high])


def keeper_probabilities(rows: DataFrame, group: str, key: str, features: str, head: Fit | None) -> DataFrame:
    """(group, key, probability) by a softmax of the head's scores in each group of two or more; no rows without a head.

    Sums combine before they travel, so a hot group is not gathered."""
    size = len(head.weights) if head else -1
    scored = checkpointed(rows.where(F.col(group).isNotNull() & (F.size(features) == size)).select(group, key, (head.score(features) if head else F.lit(0.0)).alias("s")))
    most = scored.groupBy(group).agg(F.max("s").alias("top"), F.count("*").alias("n")).where("n > 1")
    raised = scored.join(most, group).withColumn("e", F.exp(F.col("s") - F.col("top")))
    return raised.join(raised.groupBy(group).agg(F.sum("e").alias("total")), group).select(group, key, (F.col("e") / F.col("total")).alias("probability"))
