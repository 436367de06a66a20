"""Whole scoring, moments and calibration against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import images
from lumenfold.operators import calibration, moments, scoring


def one(spark, columns, **values):
    names = sorted(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} double" for n in names))
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns({n: F.col(n) for n in names})))).first()


@pytest.mark.parametrize(
    ("values", "metric", "want"),
    [
        ({"tech_sharpness": 6.0, "iso": 3200.0}, "tech_sharpness", 7.0), ({"tech_sharpness": 9.8, "iso": 12800.0}, "tech_sharpness", 10.0), ({"tech_sharpness": 6.0, "iso": 800.0}, "tech_sharpness", 6.0),
        ({"isolation_bonus": 1.4, "f_stop": 1.8}, "isolation", 5.5), ({"isolation_bonus": 1.4, "f_stop": 2.8}, "isolation", 4.1), ({"isolation_bonus": 2.5, "f_stop": 1.4}, "isolation", 10.0), ({"isolation_bonus": 1.4, "f_stop": 4.0}, "isolation", 2.0),
        ({"isolation_bonus": None}, "isolation", 0.0), ({"color_score": 9.0, "is_monochrome": 1.0}, "color", 5.0), ({"color_score": 9.0, "is_monochrome": None}, "color", 9.0),
        ({"comp_score": 6.0, "leading_lines_score": 4.0}, "composition", 6 + 0.3 * 7.08), ({"comp_score": 9.5, "leading_lines_score": 9.0}, "composition", 10.0), ({"histogram_spread": 48.0}, "dynamic_range", 8.0),
        ({"noise_sigma": 5.0}, "noise", 6.5), ({"noise_sigma": 90.0}, "noise", 0.0), ({"mean_saturation": None}, "saturation", 5.0), ({"aesthetic": float("nan")}, "aesthetic", 5.0), ({"aesthetic": 7.0}, "aesthetic", 7.0),
    ],
)
def test_metric_vector(spark, values, metric, want):
    got = one(spark, lambda c: [scoring.measured_vector(c, "default", {})[metric]], **values)[0]
    assert math.isclose(got, want, abs_tol=1e-9)


def test_portraits_and_quality(spark):
    got = one(spark, lambda c: [scoring.measured_vector(c, "portrait", {"aesthetic": 0.5, "quality": 0.2})[m] for m in ("composition", "aesthetic")], comp_score=6.0, leading_lines_score=9.0, aesthetic=5.0)
    assert got[0] == 6.0 and math.isclose(got[1], 5.4)


def test_category_scores(spark):
    v = {"aesthetic": 8.0, "noise_sigma": 6.0, "mean_saturation": 0.95, "histogram_bimodality": 3.0, "shadow_clipped": 1.0, "highlight_clipped": 1.0, "is_blink": 1.0, "is_silhouette": 0.0}
    kinds = ("default", "portrait", "night", "silhouette")
    got = one(spark, lambda c: [scoring.category_score(c, k, {"aesthetic": 1.0}) for k in kinds], **v)
    want = (8 - 1.5 * 1.5 - 0.6 - 0.5 - 0.5, 4 - 1.5 - 0.6 - 0.5 - 0.5, 8 - 1.5 - 0.6 - 0.5, 8 - 0.6 - 0.5 - 0.5)
    assert np.allclose(list(got), want)
    assert one(spark, lambda c: [scoring.category_score(c, "night", {"aesthetic": 1.0}, {"bonus": 9.0, "noise_tolerance": 0.0})], **v)[0] == 10.0


def test_exposure_from_a_histogram(spark):
    r = np.random.default_rng(0)
    luma = [r.integers(0, 50, 256).astype(float).tolist(), [0.0] * 256, None]
    df = spark.createDataFrame([(h, s) for h in luma for s in (True, False)], "h array<double>, s boolean")
    got = [x[0] for x in df.select(images.exposure_score("h", F.lit(1.5), F.col("s"), F.lit(4.25))).collect()]
    p = np.array(luma[0]) / sum(luma[0])
    i = np.arange(256)
    mean = (p * i).sum() / 255
    base = 7 - abs(mean - 0.5) * 8 + min(4, math.sqrt((p * (i / 255 - mean) ** 2).sum()) * 255 / 20) - 0.3
    assert np.allclose(got[:2], [min(10, base), min(10, base - p[:30].sum() * 4 - p[225:].sum() * 5)]) and got[2:] == [4.25] * 4


def test_moments(spark):
    words = ["beach", "party", "snow"]
    sims = {1: ("image", [0.30, 0.29, 0.1]), 2: ("image", [0.30, 0.295, 0.1]), 3: ("image", [0.1, 0.12, 0.05]), 4: ("image", [0.3, 0.28, 0.1]), 5: ("image", [0.3, 0.28, 0.1]), 6: ("image", [0.25, 0.25, 0.25])}
    rows = [(k, s, w, x) for k, (s, v) in sims.items() for w, x in zip(words, v, strict=True)] + [(5, "caption", w, x) for w, x in zip(words, [0.5, 0.47, 0.1], strict=True)] + [(1, "image", "elsewhere", 0.9), (7, "image", "beach", 0.9)]
    scored = spark.createDataFrame(rows, "id long, signal string, label string, score double")
    photos = spark.createDataFrame([(k, k >= 4) for k in range(1, 8)], "id long, crowd boolean")
    prior = [moments.Prior(F.col("crowd"), {"party": 0.1, "nowhere": 3.0}, tag=True)]
    gates = {"image": (0.15, 0.01), "caption": (0.4, 0.02)}
    got = {r["id"]: r for r in moments.classified(scored, photos, "id", words, prior, 0.5, gates, 0.05, 0.2).collect()}
    assert {k: r["moment"] for k, r in got.items()} == {1: "beach", 2: "other", 3: "other", 4: "party", 5: "beach", 6: "other"}
    assert got[4]["confidence"] == 0.28 and got[5]["signal"] == "caption" and got[5]["confidence"] == 0.5 and got[2]["confidence"] == 0.30
    for k, gain in ((1, 0), (4, 0.05)):
        a = np.array(sims[k][1]) + [0, gain, 0]
        e = np.exp((a - a.max()) / 0.05)
        assert np.allclose(got[k]["chances"], e / e.sum())


def test_names_of_groups(spark):
    rows = [("a", "Snow snow the hill"), ("a", "snow the ski"), ("b", "the beach, THE sea"), ("b", None), (None, "snow"), ("c", "")]
    got = {r["g"]: r["terms"] for r in moments.cluster_names(spark.createDataFrame(rows, "g string, t string"), "g", "t", 2).collect()}
    assert got == {"a": ["snow", "the"], "b": ["the", "beach"]}


def spearman(p, y):
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    return np.corrcoef(rank(p), rank(y))[0, 1]


def test_calibration(spark):
    r = np.random.default_rng(5)
    x = np.round(r.uniform(0, 10, (400, 3)), 1)
    y = np.round(0.7 * x[:, 0] + 0.3 * x[:, 2] + r.normal(0, 0.5, 400), 1)
    df = spark.createDataFrame([*((a.tolist(), float(b)) for a, b in zip(x, y, strict=True)), (None, 1.0), ([1.0, None, 2.0], 3.0), ([1.0, 2.0, 3.0], None)], "m array<double>, mos double")
    rows = calibration.rated(df, "m", "mos").cache()
    for c in (np.array([[1, 0, 0], [0.2, 0.3, 0.5], [0, 1, 0], [0.7, 0, 0.3]]), np.array([[0.5, 0.5, 0.0]])):
        p = np.round(x @ c.T, 2)
        want = [(spearman(p[:, k], y), np.corrcoef(p[:, k], y)[0, 1], np.abs(p[:, k] - y).mean()) for k in range(len(c))]
        assert np.allclose(calibration.measured(rows, c), want, atol=1e-9)
    found = calibration.search(rows, [1.0, 1.0, 1.0], generations=8)
    grid = [(a, b, 1 - a - b) for a in np.arange(0, 1.01, 0.05) for b in np.arange(0, 1.01 - a, 0.05)]
    best = max(spearman(np.round(x @ np.array(g), 2), y) for g in grid)
    assert found["after"] >= best - 0.002 and found["after"] > found["before"] and abs(found["weights"].sum() - 1) < 1e-9
    few = calibration.search(rows.limit(10), [1.0, 2.0, 1.0])
    assert few["photos"] == 10 and few["weights"].tolist() == [0.25, 0.5, 0.25]
