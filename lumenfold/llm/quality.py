"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target texts and one of raw texts, give every document
a log importance weight: the log ratio of its probabilities under them.  Documents are then sampled without
replacement in proportion to their weights, by Gumbel top-k: the k largest values of log weight plus
``temperature`` times Gumbel noise (1: exact importance resampling).

n-grams are words, pairs of words and pairs of word shapes; a word repeated at once counts as a mark of its
own, whatever the word is.  Raw counts cover all documents.  The target model is fitted on at most
``per_class`` labelled documents of good quality (a documented bound, drawn by a hash of doc_id).  k is a number, a
share of the rows, or by default the expected number of good documents: the sum over all rows of the probability of
good quality at their log weight, by a logistic curve through as many labelled documents of each class.

Defined results: null, empty and wordless texts have a log weight of 0; without labels of both kinds all rows
stay; noise is drawn from doc_id alone, so equal rows share their fate, rows without doc_id share their noise, and
results do not depend on partitioning; rows that tie with the k-th are selected as well.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import Bounded, binary, carried, map_batches, mix64, prepare, restored, schema_of, stage, table

BUCKETS = 1 << 14
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")
_REPEAT = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: bytes) -> bytes:
    text = token.decode("utf-8", "replace")
    if text.isalpha():
        return b"U" if text.isupper() and len(text) > 1 else b"T" if text[0].isupper() else b"l"
    return b"9" if text.isdigit() else b"a" if text.isalnum() else token[:4]


def _piece(raw: bytes) -> bytes:
    """Hashes of the words and of their shapes in a text without white space, interleaved."""
    out = []
    for token in _TOKEN.findall(raw):
        out += [zlib.crc32(token.lower()), zlib.crc32(_shape(token), 77)]
    return np.asarray(out, np.uint32).tobytes()


def features(raw: bytes, cache: dict) -> np.ndarray:
    """Hash buckets of a text's n-grams, with repetitions."""
    both = np.frombuffer(b"".join(map(cache.__getitem__, raw.split())), np.uint32).reshape(-1, 2).astype(np.uint64)
    if not len(both):
        return np.zeros(0, np.int64)
    w, s = both[:, 0], both[:, 1]
    with np.errstate(over="ignore"):
        pair = np.where(w[1:] == w[:-1], _REPEAT, (w[:-1] << np.uint64(32)) | w[1:])
        shapes = ((s[:-1] << np.uint64(32)) | s[1:]) ^ np.uint64(0x5851F42D4C957F2D)
    return (mix64(np.concatenate([w, pair, shapes, s ^ np.uint64(1 << 40)])) >> np.uint64(50)).astype(np.int64)


def counts(texts: DataFrame) -> np.ndarray:
    """Bucket counts over all texts: one row a bucket and task is shuffled, ``BUCKETS`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = Bounded(_piece), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in binary(batch.column("text")):
                total += np.bincount(features(raw, cache), minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


class Importance:
    """The log ratio of the two models in each bucket, and the probability of good quality at a log weight."""

    def __init__(self, target: np.ndarray, raw: np.ndarray, smooth: float = 1.0):
        p = (target + smooth) / (target.sum() + smooth * BUCKETS)
        q = (raw + smooth) / (raw.sum() + smooth * BUCKETS)
        self.ratio, self.curve = np.log(p) - np.log(q), None

    def score(self, raw: bytes, cache: dict) -> tuple[float, int]:
        """A text's total log ratio and number of n-grams."""
        f = features(raw, cache)
        return float(self.ratio[f].sum()), len(f)

    def good(self, weight: Column) -> Column:
        """Probability of good quality at a log weight; 1 where the labels tell nothing."""
        if self.curve is None:
            return F.lit(1.0)
        return 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -(F.lit(self.curve[0]) * F.asinh(weight) + F.lit(self.curve[1]))))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve through values x and classes y."""
    w, weight = np.zeros(2), weight / weight.sum()
    design = np.stack([x, np.ones(len(x))], 1)

    def loss(w):
        return (weight * np.logaddexp(0, (1 - 2 * y) * (design @ w))).sum() + ridge / 2 * w[0] ** 2

    for _ in range(60):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, design.T @ (weight * (p - y)) + np.asarray([ridge * w[0], 0]))
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step /= 2
        w = w - step
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> Importance:
    """Both models and the curve.  Labels of documents that ``docs`` no longer holds are left out; of rows with equal
    doc_id the one with the smallest text is taken."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    quality = quality.join(docs.select("doc_id"), "doc_id", "left_semi")
    quality = stage(quality, "quality-labels")
    sizes = dict(quality.groupBy("quality").count().toPandas().itertuples(index=False, name=None))
    drawn = [quality.where(F.col("quality") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for k in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    found = found.toPandas().sort_values("doc_id")
    cache = Bounded(_piece)
    bags = [(q, features((t or "").encode(), cache)) for q, t in zip(found["quality"], found["text"], strict=True)]
    target = np.zeros(BUCKETS)
    for q, f in bags:
        if q == 1:
            target += np.bincount(f, minlength=BUCKETS)
    model = Importance(target, counts(docs))
    y = np.asarray([q for q, _ in bags], float)
    if len(set(y.tolist())) == 2:
        weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
        model.curve = logistic(np.arcsinh([model.ratio[f].sum() for _, f in bags]), y, weight)
    return model


def weigh(docs: DataFrame, model: Importance, keys: list[str]) -> DataFrame:
    """Per row: ``keys``, log_ratio, n_grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, cache = shared.value, Bounded(_piece)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [own.score(raw, cache) for raw in binary(batch.column("text"))]
            total, n = pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), total, n], names=[*keys, "log_ratio", "n_grams"])

        return each

    return map_batches(docs.select(*dict.fromkeys([*keys, "text"])), make, schema_of(docs, keys, "log_ratio double, n_grams bigint"))


def gumbel_key(weight: Column, key: Column, seed: str | Column = "gumbel", temperature: float = 1.0) -> Column:
    """Log weight plus Gumbel noise that a hash of ``seed`` and ``key`` draws, in steps of 2^-20."""
    seed = F.lit(seed) if isinstance(seed, str) else seed
    u = (F.pmod(F.xxhash64(seed, key.cast("string")), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    held = F.greatest(F.lit(-(2.0**24)), F.least(F.lit(2.0**24), weight))
    return F.round((held - F.lit(temperature) * F.log(-F.log(u))) * F.lit(2.0**20)) / F.lit(2.0**20)


def top_k_bound(keys: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a column of multiples of 2^-20, exactly: a radix selection over three histograms.

    Each round counts one 16-bit digit of the values that still qualify, so at most 65,536 counts reach
    the driver and no values are sorted or gathered."""
    fixed = keys.select(F.round(F.col(column) * F.lit(2.0**20)).cast("long").alias("v"))
    fixed = fixed.select((F.col("v") + F.lit(1 << 46)).alias("v"))  # non-negative, below 2^48
    prefix = 0
    for shift in (32, 16, 0):
        inside = fixed.where(F.shiftright("v", shift + 16) == F.lit(prefix)) if shift < 32 else fixed
        digits = inside.groupBy(F.shiftright("v", shift).alias("d")).count().toPandas().sort_values("d", ascending=False)
        for d, n in zip(digits["d"].tolist(), digits["count"].tolist(), strict=True):
            prefix = d
            if n >= k:
                break
            k -= n
    return (prefix - (1 << 46)) / 2.0**20


def resample(docs: DataFrame, labels: DataFrame, per_class: int = 3000, keep: float | None = None, temperature: float = 1.0, seed: str = "gumbel") -> DataFrame:
    """All rows of ``docs`` (doc_id, text, all else in __rest) with log_ratio, mean_ratio, gumbel_key and selected.

    ``keep`` sets k: a number of rows if 1 or more, a share of them below, None for the expected number of good ones."""
    model = fit(docs, labels, per_class)
    rows = weigh(carried(docs, ["doc_id", "text"]), model, ["doc_id", "text", "__rest"])
    rows = rows.withColumn("mean_ratio", F.col("log_ratio") / F.greatest(F.lit(1), F.col("n_grams")))
    rows = stage(rows.withColumn("gumbel_key", gumbel_key(F.col("log_ratio"), F.col("doc_id"), seed, temperature)), "quality")
    n, good = rows.agg(F.count("*"), F.sum(model.good(F.col("log_ratio")))).first()
    k = round(good or 0) if keep is None else round(keep * n) if keep < 1 else min(n, int(keep))
    bound = top_k_bound(rows, "gumbel_key", k) if k else float("inf")
    return rows.withColumn("selected", F.col("gumbel_key") >= F.lit(bound))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the resampling selects."""
    return restored(resample(docs, labels).where("selected"), docs, {})


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return resample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "log_ratio", "mean_ratio", "gumbel_key", "selected")
