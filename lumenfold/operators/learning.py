"""Learning from pairwise preferences, and rank statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.windows import average_ranks, row_before


def canonical_votes(votes: DataFrame, a: str, b: str, winner: str, user: str, ts: str) -> DataFrame:
    """One vote for each pair and user: sides in order, the newest wins."""
    swapped = F.col(a) > F.col(b)
    side = F.when(~swapped, F.col(winner)).when(F.col(winner) == "a", "b").when(F.col(winner) == "b", "a").otherwise(F.col(winner))
    rows = votes.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), side.alias("winner"), user, ts)
    return rows.groupBy("a", "b", user).agg(F.max_by("winner", F.struct(ts, "winner")).alias("winner"), F.max(ts).alias(ts))


def culling_pairs(df: DataFrame, group: str, key: str, keep: str, order: list[Column], keeps: int = 2, most: int = 12) -> DataFrame:
    """Each reject against one of the group's first keepers, in turn, at most ``most`` pairs a group."""
    w = Window.partitionBy(group).orderBy(*order)
    best = df.where(F.col(keep)).withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < keeps)
    best = best.withColumn("nk", F.count("*").over(Window.partitionBy(group))).select(group, "k", "nk", F.col(key).alias("winner"))
    lost = df.where(~F.col(keep)).withColumn("r", F.row_number().over(w) - 1).where(F.col("r") < most).select(group, "r", F.col(key).alias("loser"))
    return lost.join(best, group).where("r % nk = k").select(group, "winner", "loser")


def pair_differences(pairs: DataFrame, rows: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Feature differences of both sides of each pair."""
    a = rows.select(F.col(key).alias("winner"), *(F.col(f).alias(f"_a_{f}") for f in features))
    b = rows.select(F.col(key).alias("loser"), *(F.col(f).alias(f"_b_{f}") for f in features))
    return pairs.join(a, "winner").join(b, "loser").select("winner", "loser", *((F.col(f"_a_{f}") - F.col(f"_b_{f}")).alias(f"d_{f}") for f in features))


def coverage(df: DataFrame, score: str, n: str, bins: int = 5) -> DataFrame:
    """Comparisons by score bin and their evenness from 0 to 100."""
    b = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(score) / (10 / bins))).cast("int").alias("bin")).agg(F.sum(n).alias("n"))
    mean = b.agg(F.avg("n").alias("m"))
    return b.crossJoin(F.broadcast(mean)).agg(F.round(F.greatest(F.lit(0.0), 100 - F.avg(F.abs(F.col("n") - F.col("m")) / F.col("m")) * 100), 4).alias("score"), F.count("*").alias("bins"))


def uncertainty_pairs(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """Neighbours by score within a group, closest first."""
    rows = row_before(df.select(group, key, score), group, [score, key], "_before")
    return rows.select(group, F.col(f"_before.{key}").alias("a"), F.col(key).alias("b"), F.round(F.col(score) - F.col(f"_before.{score}"), 6).alias("gap")).where("a is not null").orderBy("gap", "a", "b").limit(k)


def auc(df: DataFrame, label: str, metric: str, groups: list[str]) -> DataFrame:
    """Mann-Whitney AUC with mean ranks for ties."""
    r = average_ranks(df.where(F.col(metric).isNotNull() & F.col(label).isNotNull()), metric, groups, "_r")
    a = r.groupBy(*groups).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("s"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return a.select(*groups, F.round(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), 6).alias("auc"), "p", "q")


def spearman(df: DataFrame, x: str, y: str, groups: list[str], least: int = 10) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = average_ranks(average_ranks(rows, x, groups, "_x"), y, groups, "_y")
    return r.groupBy(*groups).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("rho")).where(F.col("n") >= least).withColumn("rho", F.round("rho", 6))


def rating_pairs(df: DataFrame, group: str, key: str, stars: str, k: int) -> DataFrame:
    """Pairs within a group with a gap in stars, widest first, k in all.

    Counts by group and stars tell which gaps the first k pairs can have.  Of the rows with equal group and stars only
    the k with the smallest keys can stand in them, so no group is joined with itself as a whole."""
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(stars).alias("s")).where("g is not null and s is not null")
    cells = rows.groupBy("g", "s").agg(F.count("*").cast("double").alias("n"))
    w, l = (cells.select("g", F.col("s").alias(f"s_{x}"), F.col("n").alias(f"n_{x}")) for x in "wl")
    meets = w.join(l, "g").where("s_w > s_l").withColumn("gap", F.col("s_w") - F.col("s_l"))
    gaps = meets.groupBy("gap").agg(F.sum(F.col("n_w") * F.col("n_l")).alias("n"))  # one row for each gap
    kept = gaps.withColumn("before", F.sum("n").over(Window.orderBy(F.col("gap").desc())) - F.col("n")).where(F.col("before") < k)
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("g", "s").orderBy("key"))).where(F.col("at") <= k)
    winners, losers = (first.select("g", F.col("s").alias(f"s_{x}"), F.col("key").alias(n)) for x, n in (("w", "winner"), ("l", "loser")))
    found = meets.join(kept.select("gap"), "gap", "left_semi").join(winners, ["g", "s_w"]).join(losers, ["g", "s_l"])
    return found.select("winner", "loser", "gap").orderBy(F.col("gap").desc(), "winner", "loser").limit(k)


def simplex_box(w: np.ndarray, most: float = 0.6) -> np.ndarray:
    """The nearest weights in [0, most] that sum to 1."""
    lo, hi = w.min() - 1, w.max() + 1
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(w - mid, 0, most).sum() > 1 else (lo, mid)
    return np.clip(w - (lo + hi) / 2, 0, most)


def bradley_terry(d: np.ndarray, y: np.ndarray, source: np.ndarray | None = None, ridge: float = 0.01, steps: int = 400, rate: float = 0.2) -> np.ndarray:
    """Weights whose weighted differences explain wins (y: 1 win, 0 loss, 0.5 tie), by projected gradient."""
    w, s = simplex_box(np.full(d.shape[1], 1 / d.shape[1])), np.ones(len(y)) if source is None else source
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w = simplex_box(w - rate * ((s * (p - y)) @ d / max(s.sum(), 1e-9) + ridge * (w - 1 / len(w))))
    return w


def pair_accuracy(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Share of decided pairs that the weights order rightly; equal scores count half a right answer where y is a tie."""
    s = d @ w
    return float(np.mean(np.where(y == 0.5, s == 0, (s > 0) == (y == 1)))) if len(y) else 0.0


def cross_validated(d: np.ndarray, y: np.ndarray, folds: int = 5, seed: int = 0) -> float:
    fold = np.random.default_rng(seed).permutation(len(y)) % folds
    return float(np.mean([pair_accuracy(d[fold == k], y[fold == k], bradley_terry(d[fold != k], y[fold != k])) for k in range(folds) if (fold == k).any()]))


def bootstrap(d: np.ndarray, y: np.ndarray, n: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """2.5 and 97.5 percentiles of each weight over resamples."""
    rng = np.random.default_rng(seed)
    w = np.stack([bradley_terry(d[i], y[i], steps=100) for i in (rng.integers(0, len(y), len(y)) for _ in range(n))])
    return np.percentile(w, 2.5, axis=0), np.percentile(w, 97.5, axis=0)


def pair_logistic(d: np.ndarray, y: np.ndarray, ridge: float = 1.0, prior: np.ndarray | None = None, shrink: float = 50.0, steps: int = 30) -> np.ndarray:
    """Symmetric logistic ranker without an intercept; with few pairs it stays near a prior."""
    x, t = np.vstack([d, -d]), np.concatenate([y, 1 - y])
    w0 = np.zeros(d.shape[1]) if prior is None else prior
    w = w0.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - t) + ridge * (w - w0))
    share = len(y) / (len(y) + shrink)
    return share * w + (1 - share) * w0
