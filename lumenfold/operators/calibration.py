"""Calibration of weights against outside ratings: many candidates measured in one pass over the rated photos.

A score is stored with two decimals, so it has ``BINS`` values.  For every candidate a task counts its photos by score
and sums their ranks by rating; the counts of all tasks add up, give each score its mean rank, and with it Spearman's
correlation exactly, ties included.  A pass hands on candidates x BINS x 2 numbers a task, whatever the photos, and no
photo is sorted for any candidate: ranks by rating are the same for all and are made once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.fitting import _added, _matrix
from lumenfold.operators.windows import average_ranks
from lumenfold.sources.tables import checkpointed

BINS = 1001
# --- Fixed values: least number of photos, population of each weight, generations of the search ----------------
LEAST_PHOTOS, POPULATION, GENERATIONS = 50, 15, 12
# -------------------------------------------------------------------------------------------------------------------


def rated(df: DataFrame, features: str, rating: str) -> DataFrame:
    """Rows (x, y, r): metrics from 0 to 10, rating, and mean rank by rating; rows without either are left out."""
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(rating).cast("double").alias("y")).where("y is not null and x is not null and not exists(x, e -> e is null)")
    return average_ranks(rows, "y", [], "r").select("x", "y", F.col("r").cast("double").alias("r"))


def measured(rows: DataFrame, candidates: np.ndarray) -> np.ndarray:
    """Spearman, Pearson and mean absolute error (candidates x 3) of each candidate's weighted scores, in one pass."""
    c = len(candidates)

    def part(batches):
        counts, sums = np.zeros((2, c * BINS)), np.zeros((5, c))
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                x, y, r = np.clip(_matrix(batch, "x"), 0, 10), batch.column("y").to_numpy(), batch.column("r").to_numpy()
                p = np.round(np.clip(x @ candidates.T, 0, 10) * 100 + 1e-9)
                at_bin = (p.astype(np.int64) + np.arange(c)[None, :] * BINS).ravel()
                counts[0] += np.bincount(at_bin, minlength=c * BINS)
                counts[1] += np.bincount(at_bin, np.repeat(r, c), minlength=c * BINS)
                p /= 100
                sums += np.stack([p.sum(axis=0), (p * p).sum(axis=0), (p * y[:, None]).sum(axis=0), np.abs(p - y[:, None]).sum(axis=0), np.full(c, 0.0)])
                sums[4, :3] += (len(y), y.sum(), (y * y).sum()) if c >= 3 else 0
        return np.concatenate([counts.ravel(), sums.ravel()])

    if c < 3:  # the rows' own moments stand beside three candidates at least
        return measured(rows, np.concatenate([candidates, np.repeat(candidates[-1:], 3 - c, axis=0)]))[:c]
    total = _added(rows, part, (2 * c * BINS + 5 * c,))
    n_bin, ranks = total[: 2 * c * BINS].reshape(2, c, BINS)
    p1, p2, py, error, own = total[2 * c * BINS :].reshape(5, c)
    n, y1, y2 = own[:3]
    if n < 2:
        return np.full((c, 3), np.nan)
    mean_rank = np.cumsum(n_bin, axis=1) - n_bin + (n_bin + 1) / 2
    middle = (n + 1) / 2
    up = (n_bin * (mean_rank - middle) ** 2).sum(axis=1)
    both = ((mean_rank - middle) * (ranks - n_bin * middle)).sum(axis=1)
    squares = rows.agg(F.sum((F.col("r") - float(middle)) * (F.col("r") - float(middle)))).first()[0]  # one number
    with np.errstate(invalid="ignore", divide="ignore"):
        pearson = (py - p1 * y1 / n) / np.sqrt((p2 - p1 * p1 / n) * (y2 - y1 * y1 / n))
        return np.stack([both / np.sqrt(up * squares), pearson, error / n], axis=1)


def search(rows: DataFrame, now: Sequence[float], generations: int = GENERATIONS, population: int = POPULATION, seed: int = 42) -> dict:
    """Weights that sum to 1 and rank the photos most like their ratings, by differential evolution.

    A generation, ``population`` candidates for each weight, is one pass.  The weights of today are among the first
    ones, so the result is never worse.  With fewer than ``LEAST_PHOTOS`` photos nothing is suggested."""
    rows = checkpointed(rows)
    n, d = rows.count(), len(now)
    start = np.asarray(now, float) / sum(now)
    if n < LEAST_PHOTOS:
        return {"photos": n, "before": float("nan"), "after": float("nan"), "weights": start}
    rng = np.random.default_rng(seed)
    unit = lambda w: w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    score = lambda w: np.nan_to_num(measured(rows, w)[:, 0], nan=0.0)
    at = np.concatenate([start[None, :], rng.random((population * d - 1, d))])
    value = score(unit(at))
    before = float(value[0])
    for _ in range(generations):
        a, b = (rng.permutation(len(at)) for _ in range(2))
        trial = np.clip(at[value.argmax()] + rng.uniform(0.5, 1.0) * (at[a] - at[b]), 0, 1)
        cross = rng.random(at.shape) < 0.7
        cross[np.arange(len(at)), rng.integers(0, d, len(at))] = True
        trial = np.where(cross, trial, at)
        trial[trial.sum(axis=1) < 1e-9] = start
        found = score(unit(trial))
        better = found > value
        at[better], value[better] = trial[better], found[better]
    best = int(value.argmax())
    return {"photos": n, "before": before, "after": float(value[best]), "weights": unit(at[best : best + 1])[0]}


def confusion(df: DataFrame, truth: str, said: str, default: str = "default") -> DataFrame:
    """(category, true, said, right, precision, recall, f1) of categories against true ones; rows without truth do not
    count, a missing answer is the default."""
    pairs = df.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.coalesce(F.col(said), F.lit(default)).alias("s")).agg(F.count("*").alias("n"))
    either = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("category"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b"), F.when(F.col("t") == F.col("s"), F.col("n")).otherwise(0).alias("c")), F.struct(F.col("s").alias("category"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("c")))).alias("r")).select("r.*")
    sums = either.groupBy("category").agg(F.sum("a").alias("true"), F.sum("b").alias("said"), F.sum("c").alias("right"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide("right", "said")), zero(F.try_divide("right", "true"))
    return sums.select("category", "true", "said", "right", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 6).alias("f1"))
