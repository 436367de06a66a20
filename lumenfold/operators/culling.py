"""Culling budgets, reject reasons, diversity selection and themed collections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.windows import group_top_k


def burst_score(aggregate: str, aesthetic: str, sharpness: str, blink: str) -> Column:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return 0.4 * z(aggregate) + 0.25 * z(aesthetic) + 0.2 * z(sharpness) + 0.15 * F.when(F.coalesce(F.col(blink), F.lit(0)) == 1, 0.0).otherwise(10.0)


def keep_split(df: DataFrame, group: str, score: str, tie: str, strictness: float, min_keep: int = 1) -> DataFrame:
    """Keepers: the first ``min_keep`` of each group and all within a margin of its best."""
    margin = (100 - strictness) / 100 * 5
    w = Window.partitionBy(group)
    best, rank = F.max(score).over(w), F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), tie))
    return df.withColumn("keep", (rank <= min_keep) | F.coalesce(F.col(score) >= best - margin, F.lit(False)))


def reject_reasons(df: DataFrame, group: str, score: str, tie: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """For each row but its group's best: the first rule (name, metric, gap) by which it falls behind the best."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_rank", F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), tie)))
    best = rows.where("_rank = 1").select(group, *(F.col(m).alias(f"_best_{m}") for m in {m for _, m, _ in rules}))
    reason = F.lit("near_duplicate")
    for name, metric, gap in reversed(rules):
        reason = F.when(F.col(f"_best_{metric}") - F.col(metric) >= gap, name).otherwise(reason)
    return rows.where("_rank > 1").join(best, group).withColumn("reason", reason).drop("_rank", *(f"_best_{m}" for m in {m for _, m, _ in rules}))


def auto_cull(groups: list[DataFrame], key: str, group: str, score: str, strictness: float, min_keep: int = 1) -> DataFrame:
    """Group kinds are decided in order; a decided row leaves the later kinds before they are split."""
    decided = None
    for df in groups:
        rows = df if decided is None else df.join(decided.select(key), key, "left_anti")
        rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where("_n >= 2").drop("_n")
        split = keep_split(rows, group, score, key, strictness, min_keep).select(key, "keep")
        decided = split if decided is None else decided.unionByName(split)
    return decided


def mmr(df: DataFrame, group: str, key: str, vector: str, score: str, k: int, balance: float = 0.5) -> DataFrame:
    """Greedy selection by quality less similarity to what is chosen already; rows without a vector come last."""

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        has = pdf[vector].map(lambda v: v is not None and len(v) > 0 and np.isfinite(np.asarray(v, float)).all() and np.any(v)).to_numpy(bool)
        q = pdf[score].fillna(0).to_numpy(float)
        q = (q - q.min()) / (q.max() - q.min()) if q.max() > q.min() else np.ones(len(q))
        lengths = pdf[vector][has].map(len)
        has &= pdf[vector].map(lambda v: v is not None and len(lengths) > 0 and len(v) == lengths.mode().min()).to_numpy(bool)  # one dimension
        rows = np.flatnonzero(has)
        out: list[int] = []
        if len(rows):
            v = np.stack([np.asarray(pdf[vector][i], float) for i in rows])
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            near, left = np.zeros(len(rows)), np.ones(len(rows), bool)
            while left.any() and len(out) < k:
                value = np.where(left, balance * q[rows] - (1 - balance) * near, -np.inf)
                at = int(value.argmax())
                out.append(int(rows[at]))
                left[at] = False
                near = np.maximum(near, v @ v[at])
        out += [int(i) for i in np.flatnonzero(~has)][: max(0, k - len(out))]
        return pd.DataFrame({group: pdf[group][out].to_numpy(), key: pdf[key][out].to_numpy(), "rank": np.arange(1, len(out) + 1)})

    kinds = dict(df.dtypes)
    return df.select(group, key, vector, score).groupBy(group).applyInPandas(select, f"{group} {kinds[group]}, {key} {kinds[key]}, rank bigint")


def copresence(faces: DataFrame, item: str, person: str, least: int, most: int | None = None) -> DataFrame:
    """Pairs of people with the number of items that show both."""
    f = faces.select(item, person).distinct()
    pairs = f.select(item, F.col(person).alias("a")).join(f.select(item, F.col(person).alias("b")), item).where("a < b")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return out.where(F.col("n") <= most) if most else out


def dimension_collections(df: DataFrame, dimensions: dict[str, Column], score: str, key: str, k: int, least: int, groups: int = 30) -> DataFrame:
    """For each dimension its largest groups with their best rows in order."""
    parts = []
    for name, value in sorted(dimensions.items()):
        rows = df.select(F.lit(name).alias("dimension"), value.cast("string").alias("value"), key, F.col(score).alias("_score")).where("value is not null")
        top = rows.groupBy("dimension", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "value").limit(groups)
        parts.append(group_top_k(rows.join(F.broadcast(top.select("value")), "value", "left_semi"), ["dimension", "value"], [F.col("_score").desc(), F.col(key)], k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("dimension", "value", key, "rank", "group_size")

