"""Ranks, quantiles, neighbours and pairs that are dealt by range, against plain Python, with ties, nulls and one hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import learning, similarity, stats, windows


@pytest.fixture(autouse=True, params=[windows.FEW, 10])
def few(request, monkeypatch):
    """Both ways: few distinct values, and ranges."""
    monkeypatch.setattr(windows, "FEW", request.param)


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    made = [("hot" if k % 5 else ["a", "b", None][k % 3], k, None if k % 41 == 0 else float(draw.integers(0, 60)) / 4) for k in range(3000)]
    return made, spark.createDataFrame(made, "g string, k long, v double").repartition(5)


def by_group(made):
    groups: dict = {}
    for g, k, v in made:
        groups.setdefault(g, []).append((k, v))
    return groups


def test_quantiles(rows):
    made, df = rows
    found = {r["g"]: r for r in stats.percentiles(df, ["g"], "v").collect()}
    for g, members in by_group(made).items():
        v = np.array([x for _, x in members if x is not None])
        assert found[g]["n"] == len(v)
        assert [found[g][c] for c in ("p25", "median", "p75")] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]), abs=1e-4)


def test_nearest_rank_and_summary(rows):
    made, df = rows
    found = {r["g"]: (r["p50"], r["p95"]) for r in stats.nearest_rank(df, ["g"], "v", [50, 95]).collect()}
    for g, members in by_group(made).items():
        v = sorted(x for _, x in members if x is not None)
        assert found[g] == tuple(v[min(len(v) * p // 100, len(v) - 1)] for p in (50, 95))
    every = [v for _, _, v in made if v is not None]
    assert stats.numeric_summary(df, "v").first()["p95"] == pytest.approx(np.quantile(every, 0.95), abs=1e-4)


def test_mean_ranks_and_best_percent(rows):
    made, df = rows
    found = {r["k"]: r["r"] for r in windows.average_ranks(df.where("v is not null"), "v", ["g"], "r").collect()}
    for members in by_group(made).values():
        v = [(k, x) for k, x in members if x is not None]
        for k, x in v[:40]:
            assert found[k] == sum(y < x for _, y in v) + (sum(y == x for _, y in v) + 1) / 2
    every = sorted((v for _, _, v in made if v is not None), reverse=True)
    bound = every[int(len(every) * 0.1 + 0.5)]
    assert {r["k"] for r in windows.top_percent(df, "v", "k", 10.0, 5000).collect()} == {k for _, k, v in made if v is not None and v >= bound}


def test_top_of_groups(rows):
    made, df = rows
    found = {(r["g"], r["rank"]): (r["k"], r["group_size"]) for r in windows.group_top_k(df, ["g"], [F.col("v").desc_nulls_last(), F.col("k")], 3, 5).collect()}
    for g, members in by_group(made).items():
        best = sorted(members, key=lambda m: (-(m[1] if m[1] is not None else -1), m[0]))[:3]
        assert [found[g, i + 1] for i in range(3)] == [(k, len(members)) for k, _ in best]


def test_row_before(rows):
    made, df = rows
    found = {r["k"]: r["p"] and r["p"]["k"] for r in windows.row_before(df, "g", ["v", "k"], "p").collect()}
    for members in by_group(made).values():
        line = [k for k, _ in sorted(members, key=lambda m: (m[1] is not None, m[1] or 0, m[0]))]
        assert [found[k] for k in line] == [None, *line[:-1]]


@pytest.mark.parametrize("k", [1, 50, 4000, 2_000_000])
def test_rating_pairs(spark, k):
    made = [("x" if i % 3 else "y", i, i * 7 % 6) for i in range(240)] + [(None, 900, 5), ("x", 901, None)]
    df = spark.createDataFrame(made, "g string, key long, s int")
    pairs = [(a - b, w, x) for g, w, a in made for h, x, b in made if g is not None and g == h and a is not None and b is not None and a > b]
    want = sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:k]
    assert [(r["gap"], r["winner"], r["loser"]) for r in learning.rating_pairs(df, "g", "key", "s", k).collect()] == want


def test_given_table_in_slices(spark):
    df, given = spark.range(7).toDF("k"), spark.range(100).selectExpr("id as p")
    assert {tuple(r) for r in similarity.against_all(df, given, "p", 9).collect()} == {(a, b) for a in range(7) for b in range(100)}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k long, v double")
    assert stats.percentiles(df, ["g"], "v").count() == 0 and windows.row_before(df, "g", ["v", "k"], "p").count() == 0
    assert stats.numeric_summary(df, "v").first()["p95"] is None
