"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Word n-grams of orders 2 to ``WORDS`` (an end token closes each text) are counted over all training text.  A
count c is quantised to level 1 + floor(log_b c), and the filter holds the pairs (n-gram, 1), ..., (n-gram, level).
A count is read back by probing level after level until one is missing.  The filter grows with the corpus:
it is cut into shards by the n-grams' hashes, each sized from the number of pairs that it really holds
(``PAIR_BITS`` bits each), and is never broadcast; the n-grams that a batch meets travel to their
shards, and the levels read there come back.

Every order is smoothed by the one below, with counts never above their context's,

    p(w | h) = (c(h w) + SMOOTH * p(w | h')) / (c(h) + SMOOTH),
    p(w) = c(w) / (N + U) for a seen word, U / (N + U) / S for an unseen one,

where U, the mass that unseen words share, is the number of words seen once, and S estimates how many words are
unseen from the numbers of those seen once and twice, U (U - 1) / (2 (T + 1)), at least 1 (a published lower bound).

Exact word counts do not fit a broadcast.  Texts are packed in batches; each batch sends its distinct words'
hashes to buckets once, and gets counts back in the same order.  A frequent word costs one entry a batch.

Defined results: null, empty and wordless texts are one end token; a null doc_id is learnt from and not held out;
without training texts all counts are 0 and the formulas still hold; repeated rows all count.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import binary, map_batches, mix64, parts_for, prepare, stage, table, unstage

PROBES = 2
BASE = 2**0.5
#: Orders of word n-grams, the weight of the order below, and bits of the filter for each pair.
WORDS, SMOOTH, PAIR_BITS = 3, 4.0, 16
#: Ids that are probed at a time.
_SLICE = 1 << 17
_END = np.uint64(0x7F4A7C159E3779B9)
#: Bytes of text in one batch.
BATCH = 4 << 20
_U = np.uint64


def with_ends(n: np.ndarray, values: np.ndarray, end) -> np.ndarray:
    """The values of the words of consecutive texts with n words each, and ``end`` after each text."""
    out = np.full(len(values) + len(n), end, values.dtype)
    word = np.ones(len(out), bool)
    word[np.cumsum(n + 1) - 1] = False
    out[word] = values
    return out


def word_grams(n: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For orders 2 to ``WORDS``: where n-grams end among ``tokens`` (hashes with ends), and their 48-bit hashes."""
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    h = tokens
    with np.errstate(over="ignore"):
        for order in range(2, WORDS + 1):
            longer = np.zeros_like(h)
            longer[1:] = mix64(h[:-1] + _U(0x9E3779B97F4A7C15)) ^ tokens[1:]
            h = longer
            at = np.flatnonzero(place >= order - 1)
            yield at, mix64(h[at] + _U(order)) >> _U(16)


class LogBloom:
    """The filter; ``bits`` is a packed array of bits, a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(ids: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix64(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(level))
            step = (x >> _U(32)) | _U(1)
            return np.stack([((x + step * _U(k)) & _U(size - 1)).astype(np.int64) for k in range(PROBES)])

    @classmethod
    def of(cls, ids: np.ndarray, count: np.ndarray, pair_bits: int = PAIR_BITS) -> LogBloom:
        """A filter of ids with counts of 1 or more, of ``pair_bits`` or more for each pair of id and level."""
        levels = 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(int)
        size = 1 << max(10, int(levels.sum() * pair_bits - 1).bit_length())
        bits = np.zeros(size // 8, np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            held = ids[levels >= level]
            for a in range(0, len(held), _SLICE):
                at = cls._places(held[a : a + _SLICE], level, size).ravel()
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(bits)

    def read(self, ids: np.ndarray) -> np.ndarray:
        """Counts by repeated membership probes."""
        return counts_of(self.levels(ids))

    def levels(self, ids: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        out = np.zeros(len(ids), int)
        for a in range(0, len(ids), _SLICE):
            part = ids[a : a + _SLICE]
            level, left, k = out[a : a + _SLICE], np.arange(len(part)), 0
            while len(left):
                k += 1
                at = self._places(part[left], k, 8 * len(self.bits))
                left = left[((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)]
                level[left] = k
        return out


def counts_of(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, np.round(BASE ** (level - 1.0)), 0.0)


def _pack(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds, by bucket: -1 a batch's texts as numbers of its distinct words, others a batch's distinct
    words of that bucket with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def packed(ids, known, learn, texts):
            words, n = [], np.zeros(len(texts), np.int64)
            for k, raw in enumerate(texts):
                own = raw.lower().split()
                n[k] = len(own)
                words += own
            h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(_U)
            hashes, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            trained = np.bincount(inverse, weights=np.repeat(learn, n).astype(np.float64), minlength=len(hashes))
            distinct = [words[k] for k in first.tolist()]
            words.clear()
            to = (hashes >> _U(64 - 20)).astype(np.int64) * buckets >> 20  # ascending, so cells follow the order of hashes
            cuts = np.searchsorted(to, np.arange(buckets + 1))
            name = uuid.uuid4().hex
            about = np.stack([ids, n, learn.astype(np.int64), known.astype(np.int64)])
            out = [(name, -1, about.tobytes(), squeeze.compress(inverse.astype(np.uint32).tobytes()), squeeze.compress(b" ".join(distinct)))]
            out += [(name, b, hashes[x:y].tobytes(), trained[x:y].astype(np.uint32).tobytes(), b"") for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "bucket", "a", "b", "c"])

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            known = ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            texts, at, size = binary(batch.column("text")), 0, 0
            for k, raw in enumerate(texts):
                size += len(raw)
                if size >= BATCH or k == len(texts) - 1:
                    yield packed(ids[at : k + 1], known[at : k + 1], learn[at : k + 1], texts[at : k + 1])
                    at, size = k + 1, 0

    return docs.select("doc_id", "text", "learn").mapInArrow(run, "batch string, bucket int, a binary, b binary, c binary")


def _count(packed: DataFrame, partitions: int) -> DataFrame:
    """Training counts of each batch's distinct words, in the order in which they were sent; and for each task one
    row with batch null: (sum of counts, distinct words, words seen once, words seen twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, buckets, hashes, trained = [], [], [], []
        for batch in batches:
            names += batch.column("batch").to_pylist()
            buckets += batch.column("bucket").to_pylist()
            hashes += [np.frombuffer(x, _U) for x in batch.column("a").to_pylist()]
            trained += [np.frombuffer(x, np.uint32) for x in batch.column("b").to_pylist()]
        if not names:
            return
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(trained), minlength=len(distinct))
        cuts = np.cumsum([0, *map(len, hashes)]).tolist()
        every = total[inverse].astype(np.int64)
        for k in range(0, len(names), 64):
            rows = range(k, min(k + 64, len(names)))
            yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in rows]), pa.array([buckets[r] for r in rows], pa.int32()), pa.array([every[cuts[r] : cuts[r + 1]].astype(np.uint64).tobytes() for r in rows], pa.binary())], names=["batch", "bucket", "counts"])
        about = np.asarray([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([-1], pa.int32()), pa.array([about.tobytes()], pa.binary())], names=["batch", "bucket", "counts"])

    return packed.where("bucket >= 0").repartition(partitions, "bucket").mapInArrow(run, "batch string, bucket int, counts binary")


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(_U)


def _texts(a: bytes, b: bytes, c: bytes, expand) -> tuple[np.ndarray, ...]:
    """Of a packed batch: doc_ids, words in each text, learn, known, numbers of the words, and the distinct words."""
    inverse = np.frombuffer(expand.decompress(b), np.uint32)
    return *np.frombuffer(a, np.int64).reshape(4, -1), inverse, expand.decompress(c).split(b" ") if len(inverse) else []


def _met(texts: DataFrame, buckets: int) -> DataFrame:
    """The distinct word n-grams of each batch with their training counts, by bucket: ascending, in two parts."""

    def make():
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def met(name: str, *row: bytes) -> list[tuple]:
            _, n, learn, _, inverse, words = _texts(*row, expand)
            tokens = with_ends(n, _word_hashes(words)[inverse] if words else np.zeros(0, _U), _END)
            learnt, grams, weight = np.repeat(learn > 0, n + 1), [], []
            for at, h in word_grams(n, tokens):
                grams.append(h)
                weight.append(learnt[at])
            del tokens, learnt, inverse, words, at, h
            every, weight = np.concatenate(grams), np.concatenate(weight)
            grams.clear()
            h, inverse = np.unique(every, return_inverse=True)
            del every
            trained = np.bincount(inverse[weight], minlength=len(h)).astype(np.uint32)
            del weight, inverse
            to = (h >> _U(28)).astype(np.int64) * buckets >> 20
            cuts = np.searchsorted(to, np.arange(buckets + 1)).tolist()
            return [(name, k, squeeze.compress((h[x:y] >> _U(32)).astype(np.uint16).tobytes()), (h[x:y] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), squeeze.compress(trained[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in range(batch.num_rows):
                out = met(*(batch.column(x)[r].as_py() for x in ("batch", "a", "b", "c")))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "bucket", "a", "b", "c"])

        return each

    return map_batches(texts.select("batch", "a", "b", "c"), make, "batch string, bucket int, a binary, b binary, c binary")


def _levels(met: DataFrame, partitions: int, pair_bits: int) -> DataFrame:
    """Each task fills its shard of the filter and reads it for all n-grams that were sent there, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        names, buckets, hashes, trained = [], [], [], []
        for batch in batches:
            names += batch.column("batch").to_pylist()
            buckets += batch.column("bucket").to_pylist()
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "c")), strict=True):
                hashes.append(np.frombuffer(expand.decompress(a), np.uint16).astype(_U) << _U(32) | np.frombuffer(b, np.uint32).astype(_U))
                trained.append(np.frombuffer(expand.decompress(c), np.uint32))
        if not names:
            return
        cuts = np.cumsum([0, *map(len, hashes)]).tolist()
        every = np.concatenate(hashes)
        hashes.clear()
        distinct, inverse = np.unique(every, return_inverse=True)
        del every
        total = np.bincount(inverse, weights=np.concatenate(trained), minlength=len(distinct))
        trained.clear()
        shard = LogBloom.of(distinct[total > 0], total[total > 0], pair_bits=pair_bits)
        every = shard.levels(distinct).astype(np.uint8)[inverse]
        for k in range(0, len(names), 64):
            rows = range(k, min(k + 64, len(names)))
            yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in rows]), pa.array([buckets[r] for r in rows], pa.int32()), pa.array([squeeze.compress(every[cuts[r] : cuts[r + 1]].tobytes()) for r in rows], pa.binary())], names=["batch", "bucket", "levels"])

    return met.repartition(partitions, "bucket").mapInArrow(run, "batch string, bucket int, levels binary")


def score_documents(docs: DataFrame, pair_bits: int = PAIR_BITS, smooth: float = SMOOTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, learn): doc_id, learn, n_tokens, n_known, train_tokens, base_score, score.

    ``smooth`` is the weight of the order below; with a very large one the word n-grams of the filter tell nothing.
    Words and n-grams are dealt into as many parts as the session asks for, and more if parts of 64 MB of stored text
    take more, up to 16,384: beyond that parts grow with the corpus, since a batch's row for a part would hold next to nothing."""
    spark = docs.sparkSession
    partitions = min(16_384, parts_for(docs, 64 << 20))
    packed = stage(_pack(docs, 4 * partitions), "packed", "none")
    counted = stage(_count(packed, partitions), "counted")
    ends = docs.where("learn").count()
    about = [np.frombuffer(r[0], np.int64) for r in counted.where("batch is null").select("counts").toLocalIterator()]
    total, distinct, once, twice = (int(sum(a[k] for a in about)) for k in range(4))
    total, distinct = total + ends, distinct + (ends > 0)
    found = stage(counted.where("batch is not null").groupBy("batch").agg(F.collect_list(F.struct("bucket", "counts")).alias("found")), "found")
    texts = stage(packed.where("bucket = -1"), "texts", "none")
    unstage(counted, packed)  # with the words that were shuffled
    levels = stage(_levels(_met(texts, 2 * partitions), 2 * partitions, pair_bits), "levels", "none")
    read = stage(levels.groupBy("batch").agg(F.collect_list(F.struct("bucket", "levels")).alias("read")), "read", "none")
    unstage(levels)  # with the n-grams that were shuffled
    unknown, unseen = -np.log10(total + distinct + 1), max(1.0, once)
    each_unseen = unseen / (total + unseen) / max(1.0, once * (once - 1) / (2 * (twice + 1)))

    def make():
        expand = zstandard.ZstdDecompressor()

        def scored(a: bytes, b: bytes, c: bytes, found: list, read: list) -> pa.RecordBatch:
            ids, n, learn, known, inverse, words = _texts(a, b, c, expand)
            seen = np.concatenate([np.frombuffer(x["counts"], np.uint64) for x in sorted(found or [], key=lambda x: x["bucket"])]).astype(np.float64) if words else np.zeros(0)
            own = np.where(seen > 0, seen / (total + unseen), each_unseen)
            p = with_ends(n, own[inverse], ends / (total + unseen) if ends else each_unseen)
            context = with_ends(n, seen[inverse], float(ends))
            grams = list(word_grams(n, with_ends(n, _word_hashes(words)[inverse] if words else np.zeros(0, _U), _END)))
            place = np.unique(np.concatenate([h for _, h in grams]), return_inverse=True)[1].astype(np.int32)
            grams = [(at.astype(np.int32), len(h)) for at, h in grams]
            level, start = np.frombuffer(b"".join(expand.decompress(x["levels"]) for x in sorted(read or [], key=lambda x: x["bucket"])), np.uint8), 0
            for at, size in grams:
                here = np.zeros(len(p))
                here[at] = counts_of(level[place[start : start + size]])
                start += size
                of = context[at - 1]
                p[at] = (np.minimum(here[at], of) + smooth * p[at]) / (of + smooth)
                context = here
            edge, first = np.concatenate([[0], np.cumsum(n)]), np.cumsum(n + 1) - (n + 1)

            def summed(per_word):
                s = np.concatenate([[0.0], np.cumsum(per_word[inverse], dtype=np.longdouble)])
                return (s[edge[1:]] - s[edge[:-1]]).astype(np.float64)

            out = {
                "doc_id": pa.array(ids, mask=known == 0),
                "learn": pa.array(learn.astype(bool)),
                "n_tokens": pa.array(n + 1),
                "n_known": pa.array(summed((seen > 0).astype(float)).round().astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
                "base_score": pa.array(summed(np.log10(seen + 1) + unknown) + np.log10(ends + 1) + unknown),
                "score": pa.array(np.add.reduceat(np.log10(p), first)),
            }
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for k in range(batch.num_rows):  # a row's arrays are gone before the next row's come
                yield scored(*(batch.column(x)[k].as_py() for x in ("a", "b", "c", "found", "read")))

        return each

    rows = texts.select("batch", "a", "b", "c").join(found, "batch", "left").join(read, "batch", "left")
    return map_batches(rows.select("a", "b", "c", "found", "read"), make, "doc_id bigint, learn boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("learn")))
    return rows.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
