"""Pixel kernels, colour difference and histograms on small known inputs."""

import numpy as np
import pytest

from lumenfold.functions import images


def test_kernels():
    flat, noisy = np.full((40, 40, 3), 128, np.uint8), np.random.default_rng(0).integers(0, 255, (40, 40, 3), np.uint8)
    assert images.sharpness(flat) == 0 < images.sharpness(noisy)
    assert images.noise(flat) == 0 < images.noise(noisy)
    assert images.is_monochrome(flat) and not images.is_monochrome(noisy)
    assert images.symmetry(flat) == 1
    red = np.zeros((8, 8, 3), np.uint8)
    red[..., 0] = 255
    assert images.modal_hue(red) == 5 and images.colour_entropy(red) == 0


def test_colour_difference_reference_pairs():
    a = np.asarray([[50.0, 2.6772, -79.7751], [50.0, 0.0, 0.0], [50.0, 2.5, 0.0]])
    b = np.asarray([[50.0, 0.0, -82.7485], [50.0, -1.0, 2.0], [73.0, 25.0, -18.0]])
    assert images.ciede2000(a, b) == pytest.approx([2.0425, 2.3669, 27.1492], abs=1e-4)
    assert images.lab(np.asarray([255, 255, 255])) == pytest.approx([100, 0, 0], abs=0.02)


def test_broken_files_have_null_measures(spark):
    df = spark.createDataFrame([("a", bytearray(4 * 4 * 3)), ("b", bytearray(b"x"))], "path string, content binary")
    rows = {r["path"]: r["sharpness"] for r in images.measured(df, "path", lambda c: np.frombuffer(c, np.uint8).reshape(4, 4, 3), ("sharpness", "contrast")).collect()}
    assert rows == {"a": 0.0, "b": None}


def test_clipping(spark):
    h = [0.0] * 256
    r, g = list(h), list(h)
    r[0], r[100], g[255], g[9] = 1.0, 3.0, 1.0, 1.0
    x = spark.createDataFrame([(r, g, r)], "r array<double>, g array<double>, b array<double>").select(images.worst_clipping("r", "g", "b").alias("c"), images.tonal_curve("r", "g").alias("t"), images.exposure_parts("r").alias("e")).first()
    assert (x["c"]["shadow"], x["c"]["highlight"]) == (25.0, 50.0)
    assert x["t"][0][100] == 1.0 and x["t"][0][0] == 0.0 and x["t"][1][9] == 0.3333
    assert x["e"]["mean"] == 75.0 and x["e"]["shadow"] == 0.25
