"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams and itself, hashed into a fixed number of embedding
rows, so misspellings that training never saw share most of their vectors with the words they resemble.
A window of words is the average of its bag; a linear softmax on the average gives its probability.
Long texts would drown a few toxic words in one average, so a text's score is that of its worst window;
windows overlap by half and cover the whole text.

Training takes at most ``per_class`` labelled documents of each class (a documented bound, drawn by a
hash of doc_id) and every window of each: a document's windows are dealt over the epochs, so that short documents
are seen in all of them and each window of a long one at least once.  Scoring reads every whole text.

Defined results: null, empty and wordless texts get the score of an empty average (the softmax's bias);
without any labels, or with one class only, every score is that class's share or 0.5; documents with
several or conflicting labels count as toxic if any of them says so; a null doc_id is never learnt from and
not held out; of rows with equal doc_id, the one with the smallest text is learnt from, and all are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import Bounded, binary, map_batches, prepare, table

ROWS, DIM, WIDTH = 1 << 18, 8, 32
#: Bytes that separate words: everything ASCII but letters; letters become lower case.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    """Lower-case words; a word said many times in a row counts once."""
    w = raw.translate(_FOLD).split()
    return [a for a, b in zip(w, [None, *w], strict=False) if a != b]


def grams(word: bytes) -> list[int]:
    """Embedding rows of a word: its character 3- to 5-grams between boundary marks, and the word."""
    text = f"<{word.decode('utf-8', 'ignore')}>"
    parts = {text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}
    parts.add(text)
    return [zlib.crc32(p.encode()) & (ROWS - 1) for p in sorted(parts)]  # sums in one order in every process


class Toxicity:
    """Jointly trained embeddings and softmax weights; ``margins`` folds them into one number a row."""

    def __init__(self, embeddings: np.ndarray, weights: np.ndarray, bias: float):
        self.embeddings, self.weights, self.bias, self.scale, self.offset = embeddings, weights, bias, 1.0, 0.0
        self.margins = (embeddings @ (weights[1] - weights[0])).astype(np.float64)

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], windows: int = 8, epochs: int = 6, rate: float = 0.15, seed: int = 7) -> Toxicity:
        """Adagrad over windows that carry their document's label: in each epoch ``windows`` of a document, or more
        where it takes more for all of them to have their turn.  After a third of the epochs, windows of toxic
        documents that the model itself finds clean stop counting as toxic.  Rows that fewer than one in a thousand
        documents use (two at least) stay zero.  A fifth of the documents is kept back to fit the scale and offset
        that turn a document's largest margin into a probability."""
        rng = np.random.default_rng(seed)
        embeddings = rng.uniform(-1 / DIM, 1 / DIM, (ROWS, DIM)).astype(np.float32)
        weights = rng.uniform(-0.5, 0.5, (2, DIM)).astype(np.float32)
        if len(set(labels)) < 2:
            share = float(np.clip(np.mean(labels), 0.01, 0.99)) if labels else 0.5
            return cls(embeddings * 0, weights, float(np.log(share / (1 - share))))
        number: dict[bytes, int] = {}
        docs = [(np.asarray([number.setdefault(x, len(number)) for x in words(raw)], np.int64), label) for k, (raw, label) in enumerate(zip(texts, labels, strict=True)) if k % 5 != 4]
        docs = [(w, label) for w, label in docs if len(w)]
        if len({label for _, label in docs}) < 2:
            return cls(embeddings * 0, weights, 0.0)
        rows = [np.asarray(grams(x), np.int32) for x in number]
        flat, count = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        first = np.cumsum(count) - count
        users = np.zeros(ROWS, np.int32)
        for w, _ in docs:
            users[np.unique(flat[_spread(first[u := np.unique(w)], count[u])])] += 1
        used = users >= max(2, len(docs) // 1000)
        embeddings[~used] = 0
        text = np.concatenate([w for w, _ in docs])
        begin = np.cumsum([0, *(len(w) for w, _ in docs)])
        turns = [rng.permutation(np.arange(0, max(1, len(w) - WIDTH // 2), WIDTH // 2)) for w, _ in docs]
        share = [max(min(len(t), windows), -(-len(t) // epochs)) for t in turns]
        past_e, past_w, past_b, bias = np.full(ROWS, 1e-8), np.full((2, DIM), 1e-8), 1e-8, 0.0
        for epoch in range(epochs):
            own = [t[(epoch * q + np.arange(q)) % len(t)] for t, q in zip(turns, share, strict=True)]
            doc = np.repeat(np.arange(len(docs)), share)
            start = np.concatenate(own) + begin[doc]
            stop = np.minimum(start + WIDTH, begin[doc + 1])
            y = np.asarray([label for _, label in docs], np.float32)[doc]
            gain = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
            order, size_of = rng.permutation(len(y)), int(np.clip(len(y) // 40, 16, 256))
            for at in range(0, len(order), size_of):
                part = order[at : at + size_of]
                w = text[_spread(start[part], stop[part] - start[part])]
                ids = flat[_spread(first[w], count[w])]
                size = np.add.reduceat(count[w], np.concatenate([[0], np.cumsum(stop[part] - start[part])[:-1]]))
                mean = np.add.reduceat(embeddings[ids], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]
                u = weights[1] - weights[0]
                p = 1 / (1 + np.exp(-np.clip(mean @ u + bias, -30, 30)))
                g = (p - y[part]) * gain[part]
                if epoch > epochs // 3:
                    g[(y[part] == 1) & (p <= 0.25)] = 0
                # the gradient of an embedding row is a multiple of the weights' difference
                pull = np.bincount(ids, weights=np.repeat(g / size, size), minlength=ROWS)
                hit = np.flatnonzero((pull != 0) & used)
                past_e[hit] += pull[hit] ** 2
                embeddings[hit] -= (rate * pull[hit] / np.sqrt(past_e[hit]))[:, None].astype(np.float32) * u[None, :]
                dw = (g[:, None] * mean).mean(0)
                past_w += dw**2
                weights -= (0.1 * np.stack([-dw, dw]) / np.sqrt(past_w)).astype(np.float32)
                db = float(g.mean())
                past_b += db * db
                bias -= 0.1 * db / past_b**0.5
        model = cls(embeddings, weights, bias)
        cache = model.cache()
        x = np.asarray([model.margin(words(raw), cache) for raw in texts[4::5]])
        model.scale, model.offset = calibrated(x, np.asarray(labels[4::5], float))
        return model

    def margin(self, w: list[bytes], cache: dict) -> float:
        """The worst window's margin."""
        packed = np.frombuffer(b"".join(map(cache.__getitem__, w)), np.float64).reshape(-1, 2)
        total = np.concatenate([[(0.0, 0.0)], np.cumsum(packed, axis=0)])
        starts = np.arange(0, max(1, len(w) - WIDTH // 2), WIDTH // 2)
        part = total[np.minimum(starts + WIDTH, len(w))] - total[starts]
        return float((part[:, 0] / np.maximum(part[:, 1], 1)).max()) + self.bias

    def score(self, w: list[bytes], cache: dict) -> float:
        """The worst window's probability."""
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.margin(w, cache) + self.offset, -40, 40))))

    def cache(self, size: int = 250_000) -> Bounded:
        margins = self.margins.tolist()

        def fill(word: bytes) -> bytes:
            rows = grams(word)
            return np.asarray([sum(map(margins.__getitem__, rows)), len(rows)], np.float64).tobytes()

        return Bounded(fill, size)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[k], ..., first[k] + count[k] - 1 for all k, in order."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def calibrated(x: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic curve through margins x and labels t, both classes weighing the same.

    A ridge that weighs as much as two documents draws them to 1 and 0, where there is little to go by."""
    if len(set(t.tolist())) < 2:
        return 1.0, 0.0
    centre, spread = float(np.median(x)), float(np.std(x)) + 1e-9
    z, gain, ridge = (x - centre) / spread, np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum()), 2 / len(t) ** 1.5
    own = np.asarray([spread, centre])  # scale 1 and offset 0 in terms of z

    def loss(w):
        return (gain * np.logaddexp(0, (1 - 2 * t) * (w[0] * z + w[1]))).sum() + ridge / 2 * ((w - own) ** 2).sum()

    w = np.zeros(2)
    for _ in range(60):  # Newton steps, halved until they help
        p = 1 / (1 + np.exp(-np.clip(w[0] * z + w[1], -30, 30)))
        g, h = gain * (p - t), gain * p * (1 - p)
        grad = np.asarray([(g * z).sum(), g.sum()]) + ridge * (w - own)
        step = np.linalg.solve(np.asarray([[(h * z * z).sum() + ridge, (h * z).sum()], [(h * z).sum(), h.sum() + ridge]]), grad)
        while np.abs(step).max() > 1e-9 and loss(w - step) > loss(w):
            step /= 2
        w = w - step
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def train(docs: DataFrame, labels: DataFrame, where, per_class: int = 3000) -> Toxicity:
    """Fit on at most ``per_class`` documents of each class for which ``where`` holds."""
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(where)
    drawn = [toxic.where(F.col("toxic") == k).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(per_class) for k in (0, 1)]
    ids = drawn[0].union(drawn[1])
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = found.select("text", "toxic", F.xxhash64("doc_id").alias("at")).toPandas().sort_values(["at", "text"], kind="stable", na_position="first")
    return Toxicity.fit([(t or "").encode() for t in found["text"]], [int(x) for x in found["toxic"]])


def score_documents(docs: DataFrame, model: Toxicity) -> DataFrame:
    """Per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        cache = own.cache()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            scores = [own.score(words(raw), cache) for raw in binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5, F.lit(1))
    model = train(docs, labels, fold != 0)
    return score_documents(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
