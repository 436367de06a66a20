"""Fitted preferences against plain numpy over the same pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import fitting
from lumenfold.operators.learning import simplex_box


def arrays(pairs):
    rows = pairs.orderBy("a", "b").collect()
    return (np.array([r[c] for r in rows], float) for c in ("d", "y", "weight", "fold", "key", "fa", "fb", "base"))


@pytest.fixture(scope="module")
def pairs(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((120, 4)) * [1, 2, 0.5, 3]
    true, rows = np.array([1.0, -0.5, 2.0, 0.0]), []
    for _ in range(600):
        a, b = map(int, r.choice(120, 2, replace=False))
        z = (x[a] - x[b]) @ true
        rows.append((a, b, 0.5 if abs(z) < 0.3 else float(r.random() < 1 / (1 + np.exp(-z))), float(r.choice([1, 0.7, 0.5]))))
    rows = list({(a, b): (a, b, y, w) for a, b, y, w in rows}.values())
    photos = spark.createDataFrame([(k, v.tolist(), float(v[0])) for k, v in enumerate(x)] + [(500, None, 0.0), (501, [1.0], 0.0)], "photo long, f array<double>, agg double")
    votes = spark.createDataFrame([*rows, (1, 500, 1.0, 1.0), (501, 2, 1.0, 1.0)], "a long, b long, y double, weight double")
    return fitting.compared(votes, photos, "photo", "f", "agg").cache()


def newton(d, y, w, strength, offset=0.0):
    beta = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(d @ beta + offset)))
        g = strength * 2 * d.T @ (w * (p - y)) + beta
        h = strength * 2 * (d * (w * p * (1 - p))[:, None]).T @ d + np.eye(d.shape[1])
        beta = beta - np.linalg.solve(h, g)
    return beta


def test_ranker(pairs):
    fit = fitting.ranker(pairs, 4)
    d, y, w, fold, _, fa, fb, base = arrays(pairs)
    own = y != 0.5
    scale = np.concatenate([fa[own], fb[own]]).std(axis=0)
    assert np.allclose(fit.scale, scale)
    d, y, w, fold, base = d[own] / scale, y[own], w[own], fold[own], base[own]
    assert np.allclose(fit.weights, newton(d, y, w, 1.0), atol=1e-7)
    held = [np.mean((d[fold == k] @ newton(d[fold != k], y[fold != k], w[fold != k], 1.0) > 0) == (y[fold == k] == 1)) for k in range(5)]
    assert abs(fit.held_out - 100 * np.mean(held)) < 1e-6 and abs(fit.baseline - 100 * np.mean((base > 0) == (y == 1))) < 1e-6
    assert fit.n_pairs == len(y) and fit.passed == (fit.held_out - fit.baseline >= 2.0) and fit.passed


def test_ranker_with_a_prior(pairs):
    fit = fitting.ranker(pairs, 4, prior="base")
    d, y, w, _, _, fa, fb, base = arrays(pairs)
    own = y != 0.5
    scale = np.concatenate([fa[own], fb[own]]).std(axis=0)
    assert np.allclose(fit.weights, newton(d[own] / scale, y[own], w[own], 1.0, base[own]), atol=1e-7)
    assert fit.extra["share"] == own.sum() / (own.sum() + 50)


def test_nothing_is_written_without_a_gain(spark):
    photos = spark.createDataFrame([(k, [float(k % 7)], float(k)) for k in range(60)], "photo long, f array<double>, agg double")
    votes = spark.createDataFrame([(k, k - 1, 1.0, 1.0) for k in range(1, 60)], "a long, b long, y double, weight double")
    assert not fitting.ranker(fitting.compared(votes, photos, "photo", "f", "agg"), 1).passed  # the baseline is always right
    nothing = fitting.ranker(fitting.compared(votes.limit(0), photos, "photo", "f", "agg"), 1)
    assert nothing.n_pairs == 0 and not nothing.passed and nothing.weights.tolist() == [0.0]


def cost(w, d, y, weight, ridge, start):
    z = d @ w
    loss = np.where(y == 0.5, (z / 0.2) ** 2, np.logaddexp(0, np.where(y == 1, -z, z)))
    return float((weight * loss).sum() + ridge * ((w - start) ** 2).sum())


def test_direct_weights_cost_least(pairs):
    rows = pairs.where("y is not null")
    w = fitting.direct_weights(rows, np.full(4, 0.25), fitting.weigh_folds(5), 6)
    d, y, weight, fold, *_ = arrays(rows)
    r, start = np.random.default_rng(1), np.full(4, 0.25)
    for k in range(6):
        own = np.ones(len(y), bool) if k == 0 else fold != k - 1
        assert abs(w[k].sum() - 1) < 1e-6 and (w[k] >= -1e-9).all() and (w[k] <= 0.6 + 1e-6).all()
        least = cost(w[k], d[own], y[own], weight[own], 0.01, start)
        for size in (0.3, 0.03, 0.003):
            assert all(cost(simplex_box(w[k] + size * r.standard_normal(4)), d[own], y[own], weight[own], 0.01, start) >= least - 1e-6 for _ in range(60))
    fit = fitting.weights_with_folds(rows, 4)
    assert np.allclose(fit.weights, w[0], atol=1e-6)
    own = y != 0.5
    held = [np.mean(((d[own & (fold == k)] @ w[k + 1]) > 0) == (y[own & (fold == k)] == 1)) for k in range(5)]
    assert abs(fit.held_out - 100 * np.mean(held)) < 1e-6
    assert abs(fit.baseline - 100 * np.mean(((d[own] @ start) > 0) == (y[own] == 1))) < 1e-6


def test_resamples(spark, pairs):
    key = np.arange(1, 20_000, dtype=np.int64) * 7919 % fitting.PRIME
    drawn = fitting.poisson(key, range(3))
    assert abs(drawn.mean() - 1) < 0.03 and abs(drawn.var() - 1) < 0.06 and abs(np.corrcoef(drawn.T)[0, 1]) < 0.03
    got = spark.createDataFrame([(int(k),) for k in key[:500]], "k long").select(*(fitting.poisson_column(F.col("k"), r).alias(f"r{r}") for r in range(3))).collect()
    assert [list(map(float, r)) for r in got] == drawn[:500].tolist()
    d, y, weight, _, k, *_ = arrays(pairs)
    w = fitting.direct_weights(pairs, np.full(4, 0.25), fitting.weigh_replicates(20), 20, ridge=0.0)
    counts, r = fitting.poisson(k.astype(np.int64), range(20)), np.random.default_rng(3)
    for i in range(20):
        least = cost(w[i], d, y, weight * counts[:, i], 0.0, 0.0)
        for size in (0.3, 0.03, 0.003):
            assert all(cost(simplex_box(w[i] + size * r.standard_normal(4)), d, y, weight * counts[:, i], 0.0, 0.0) >= least - 1e-5 for _ in range(40))
    middle, low, high = fitting.weight_intervals(pairs, 4, 20)
    assert np.allclose(np.percentile(w, [2.5, 97.5], axis=0), [low, high], atol=1e-6) and abs(middle.sum() - 1) < 1e-9
    assert (high - low).max() > 0.01


def test_keeper_probabilities(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 2.0]), (1, 2, [3.0, 1.0]), (1, 3, [700.0, 9.0]), (2, 4, [1.0, 1.0]), (3, 5, [0.0, 0.0]), (3, 6, [0.0, 0.0]), (3, 7, None), (3, 8, [1.0]), (None, 9, [1.0, 1.0]), (None, 10, [1.0, 1.0])], "g long, photo long, f array<double>")
    head = fitting.Fit(np.array([2.0, -1.0]), np.array([1.0, 2.0]))
    got = {r["photo"]: r["probability"] for r in fitting.keeper_probabilities(rows, "g", "photo", "f", head).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6] and got[3] == 1.0 and got[5] == got[6] == 0.5 and abs(got[1] + got[2] + got[3] - 1) < 1e-12
    assert fitting.keeper_probabilities(rows, "g", "photo", "f", None).collect() == []


def test_registered(spark, data):
    from lumenfold.plans.registry import QUERIES

    gate = QUERIES["ranker_gate"](spark, data).collect()[0]
    assert gate["passed"] and gate["held_out"] > gate["baseline"] + 2
    weights = {r["feature"]: r["weight"] for r in QUERIES["ranker_coefficients"](spark, data).collect()}
    assert max(weights, key=weights.get) == "sharpness"
    sums = QUERIES["keeper_probabilities"](spark, data).groupBy("burst").agg(F.sum("probability").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 1) < 1e-5 and r["n"] > 1 for r in sums)
    found = QUERIES["suggested_weights"](spark, data).collect()
    assert abs(sum(r["weight"] for r in found) - 1) < 1e-4 and all(r["low"] <= r["median"] + 0.02 and r["median"] <= r["high"] + 0.02 for r in found)
