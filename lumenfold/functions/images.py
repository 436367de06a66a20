"""Histogram expressions over stored bins, and pixel kernels over decoded images.

Histograms stay arrays and are handled by array functions.  Pixel kernels take images as decoded by a pluggable
reader (an array of height x width x 3 in 0..255) and run as one pass over batches of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 256


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(bins: Column | str) -> Column:
    return F.aggregate(_col(bins), F.lit(0.0), lambda s, x: s + x)


def downsampled(bins: Column | str, n: int) -> Column:
    """Neighbouring bins summed up to n buckets."""
    width = BINS // n
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: total(F.slice(_col(bins), k * width + 1, F.lit(width))))


def share(bins: Column | str, first: int, last: int) -> Column:
    """Share of the pixels in bins first..last; 0 for an empty histogram."""
    return F.coalesce(F.try_divide(total(F.slice(_col(bins), first + 1, last - first + 1)), total(bins)), F.lit(0.0))


def worst_clipping(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Percent of pixels in the lowest and the highest bin, of the worst channel; null where channels are unknown."""
    known = _col(r).isNotNull() & _col(g).isNotNull() & _col(b).isNotNull()
    low, high = (F.greatest(*(F.round(share(c, k, k) * 100, 4) for c in (r, g, b))) for k in (0, BINS - 1))
    return F.when(known, F.struct(low.alias("shadow"), high.alias("highlight")))


def tonal_curve(*channels: Column | str) -> Column:
    """Channels over their inner bins, all divided by the largest inner bin of any."""
    inner = [F.transform(_col(c), lambda x, i: F.when((i == 0) | (i == BINS - 1), 0.0).otherwise(x.cast("double"))) for c in channels]
    peak = F.greatest(*(F.array_max(c) for c in inner)) if len(inner) > 1 else F.array_max(inner[0])
    return F.array(*(F.transform(c, lambda x: F.round(F.coalesce(F.try_divide(x, peak), F.lit(0.0)), 4)) for c in inner))


def mean_level(bins: Column | str) -> Column:
    weighted = F.aggregate(F.transform(_col(bins), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(weighted, total(bins))


def exposure_parts(luma: Column | str) -> Column:
    """Mean, spread, and the mass of shadows and highlights."""
    m = mean_level(luma)
    square = F.try_divide(F.aggregate(F.transform(_col(luma), lambda x, i: x * i * i), F.lit(0.0), lambda s, x: s + x), total(luma))
    return F.struct(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - m * m)).alias("spread"), share(luma, 0, 29).alias("shadow"), share(luma, 225, 255).alias("highlight"))


def exposure_score(luma: Column | str, bimodality: Column, silhouette: Column, stored: Column) -> Column:
    """Exposure from 0 to 10 out of a luma histogram: less for a mean off the middle, two humps and clipped ends (not in
    silhouettes), more for spread; the stored score where there is no histogram or an empty one."""
    p = exposure_parts(luma)
    clipped = F.when(silhouette, 0.0).otherwise(p["shadow"] * 4.0 + p["highlight"] * 5.0)
    score = 7.0 - F.abs(p["mean"] / 255 - 0.5) * 8 + F.when(p["spread"] < 80, p["spread"] / 20.0).otherwise(4.0) - F.greatest(F.lit(0.0), F.coalesce(bimodality, F.lit(0.0)) - 1.0) * 0.6 - clipped
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))).otherwise(stored)


# ------------------------------------------------------------------------------------------ pixel kernels


def grey(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(float) @ np.asarray([0.299, 0.587, 0.114]) if image.ndim == 3 else image.astype(float)


def sharpness(image: np.ndarray) -> float:
    """Variance of the Laplacian."""
    g = grey(image)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    return float(lap.var()) if lap.size else 0.0


def noise(image: np.ndarray) -> float:
    """Noise from the response to a mask that cancels edges."""
    g = grey(image)
    if min(g.shape) < 3:
        return 0.0
    mask = ((1, -2, 1), (-2, 4, -2), (1, -2, 1))
    h, w = g.shape
    r = sum(mask[i][j] * g[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3))
    return float(np.sqrt(np.pi / 2) * np.abs(r).sum() / (6 * (h - 2) * (w - 2)))


def hue_saturation(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rgb = image[..., :3].astype(float) / 255
    top, low = rgb.max(-1), rgb.min(-1)
    d = np.where(top > low, top - low, 1)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(top == r, (g - b) / d % 6, np.where(top == g, (b - r) / d + 2, (r - g) / d + 4)) * 60
    return np.where(top > low, hue, 0.0), np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0.0)


def colour_entropy(image: np.ndarray, bins: tuple[int, int] = (180, 256)) -> float:
    """Bits of the joint histogram of hue (half degrees of a turn) and saturation."""
    hue, sat = hue_saturation(image)
    n = np.histogram2d(np.floor(hue / 2).ravel(), np.rint(sat * 255).ravel(), bins, ((0, bins[0]), (0, bins[1])))[0]
    p = n[n > 0] / max(n.sum(), 1e-9)
    return float(-(p * np.log2(p)).sum()) + 0.0


def modal_hue(image: np.ndarray) -> float:
    hue, sat = hue_saturation(image)
    return float(np.histogram(hue, 36, (0, 360), weights=sat)[0].argmax() * 10 + 5)


def is_monochrome(image: np.ndarray, most: float = 0.1) -> bool:
    return bool(hue_saturation(image)[1].mean() < most)


def contrast(image: np.ndarray) -> float:
    """0 to 10: five times the spread between the 5th and 95th percentile and twenty times the standard deviation."""
    g = grey(image)
    return float(min(10.0, (np.percentile(g, 95) - np.percentile(g, 5)) / 255 * 5 + g.std() / 255 * 20))


def dynamic_range(image: np.ndarray) -> float:
    """Stops between the 2nd and the 98th percentile, neither below 1."""
    lo, hi = np.percentile(grey(image), [2, 98])
    return float(np.log2(max(hi, 1) / max(lo, 1)))


def symmetry(image: np.ndarray) -> float:
    g = grey(image)
    return float(1 - np.abs(g - g[:, ::-1]).mean() / 255)


def power_points(image: np.ndarray) -> float:
    """Share of the gradient near the crossings of the thirds."""
    g = grey(image)
    gy, gx = np.gradient(g)
    e = np.hypot(gx, gy)
    h, w = g.shape
    y, x = np.mgrid[0:h, 0:w]
    near = np.zeros_like(e, bool)
    for py in (1 / 3, 2 / 3):
        for px in (1 / 3, 2 / 3):
            near |= np.hypot((y / h - py), (x / w - px)) < 0.12
    return float(e[near].sum() / max(e.sum(), 1e-9))


KERNELS: dict[str, Callable[[np.ndarray], float]] = {
    "sharpness": sharpness, "noise": noise, "colour_entropy": colour_entropy, "modal_hue": modal_hue, "contrast": contrast,
    "dynamic_range": dynamic_range, "symmetry": symmetry, "power_points": power_points, "is_monochrome": lambda x: float(is_monochrome(x)),
}


def measured(files: DataFrame, key: str, read: Callable[[bytes], np.ndarray | None], kernels: tuple[str, ...] = tuple(KERNELS)) -> DataFrame:
    """Kernels over files (``key``, content).  A file that cannot be read has null measures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for content in pdf["content"]:
                try:
                    image = read(content)
                except Exception:  # noqa: BLE001  any broken file
                    image = None
                rows.append([None if image is None else float(KERNELS[k](image)) for k in kernels])
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=list(kernels), dtype=float)], axis=1)

    kind = dict(files.dtypes)[key]
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{k} double" for k in kernels))


def lab(rgb: np.ndarray) -> np.ndarray:
    """sRGB in 0..255 to CIELAB under D65."""
    c = np.asarray(rgb, float) / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.asarray([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.asarray([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def ciede2000(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Colour difference by the 2005 formulation, for arrays of Lab colours."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(np.asarray(a, float), -1, 0), np.moveaxis(np.asarray(b, float), -1, 0)
    mean = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(mean**7 / (mean**7 + 25.0**7)))
    a1, a2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    dh = (h2 - h1 + 180) % 360 - 180
    dh = np.where(c1 * c2 == 0, 0, dh)
    dl, dc, dhh = l2 - l1, c2 - c1, 2 * np.sqrt(c1 * c2) * np.sin(np.radians(dh / 2))
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    hm = np.where(c1 * c2 == 0, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, np.where(h1 + h2 < 360, (h1 + h2 + 360) / 2, (h1 + h2 - 360) / 2)))
    t = 1 - 0.17 * np.cos(np.radians(hm - 30)) + 0.24 * np.cos(np.radians(2 * hm)) + 0.32 * np.cos(np.radians(3 * hm + 6)) - 0.20 * np.cos(np.radians(4 * hm - 63))
    sl, sc, sh = 1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2), 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rt = -2 * np.sqrt(cm**7 / (cm**7 + 25.0**7)) * np.sin(np.radians(60 * np.exp(-(((hm - 275) / 25) ** 2))))
    return np.sqrt((dl / sl) ** 2 + (dc / sc) ** 2 + (dhh / sh) ** 2 + rt * (dc / sc) * (dhh / sh))
