"""Removal of repeated byte strings by minimisers (winnowing), refined in three levels.

Every string of ``length`` bytes that starts at two places is found, exactly, over all documents.  Instead of
sorting all suffixes at once, buckets are refined where they are still undecided:

1. Initial buckets are q-grams.  A string's bucket pointer is the smallest hashed q-gram inside it (leftmost
   among equals): equal strings have equal pointers at equal offsets, so consecutive strings with one pointer
   form one record.  Records are sorted by (q-gram, whole text that the record spans).
2. Undecided records are refined to blocks of ``BLOCK`` strings at
   aligned offsets from the pointer, sorted by (text common to the block, whole text of the block).
3. What is left is refined to single strings.

At each level, equal whole texts decide all strings of a record (all repeated) and a unique common text decides
them the other way (none is); only the rest goes on, together with one witness of each decided class that
shares a bucket with undecided ones.  Sorting happens on pairs of 64-bit keys; on the first two levels both come from
one hash, so equality there rests on 64 bits, and on the last level on two independent ones of 64 bits each.

Within an Arrow batch equal keys are merged before they travel, and a bucket with many different records in
one batch is declared undecided on the spot, so no task gathers more than a few entries of a bucket and batch.

Defined results: null and empty texts keep nothing and lose nothing; rows that are equal in doc_id and text
are copies of each other; texts shorter than ``length`` stay whole; in ``deduplicate`` a character that
loses some of its bytes goes altogether.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import binary, carried, map_batches, mix64, prepare, schema_of, stage, table, unstage, with_text

LENGTH, GRAM, BLOCK = 200, 32, 8
#: Different records of one bucket in a batch from which it is undecided on the spot.
CROWD = 8
#: Bytes of text that are hashed together.
CHUNK = 1 << 20
_U = np.uint64


class Hasher:
    """Hashes of any substrings of a chunk, from prefix sums of a polynomial modulo 2^64 over random byte values."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        base = (int(rng.integers(1, 1 << 60)) << 3) | 5  # odd, and of full order
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, base % (1 << 64), _U)]))
            self.inverse = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size, pow(base, -1, 1 << 64), _U)]))

    def prefix(self, text: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, _U), np.cumsum(self.values[text] * self.powers[: len(text)])])

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))


@functools.lru_cache(4)
def hasher(seed: int, size: int) -> Hasher:
    return Hasher(seed, size)


def _salt(*parts: np.ndarray) -> np.ndarray:
    """One number out of small ones."""
    out = np.zeros(1, _U)
    with np.errstate(over="ignore"):
        for p in parts:
            out = out * _U(1_000_003) + p.astype(_U)
    return mix64(out + _U(0x51ED270B))


def pointers(prefix: np.ndarray, size: int, h: Hasher, length: int, gram: int, bits: int = 24) -> np.ndarray:
    """For each start of a ``length``-byte string: where its smallest q-gram is.

    Positions stand in the low ``bits`` of the hashes, counted from the start of a piece, so that equal strings
    compare the same bits of their q-grams wherever they are in a text of any size."""
    w, starts = length - gram + 1, size - length + 1
    piece = (1 << bits) - w + 1
    low = _U((1 << bits) - 1)
    out = []
    for a in range(0, starts, piece):
        here = min(piece, starts - a)
        grams = here + w - 1
        at = np.arange(grams)
        value = (h.of(prefix, at + a, at + a + gram) & ~low) | at.astype(_U)
        rows = -(-grams // w)
        padded = np.full(rows * w, ~_U(0))
        padded[:grams] = value
        table = padded.reshape(rows, w)
        ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(table, axis=1).ravel()
        own = np.arange(here)
        out.append((np.minimum(ahead[own], behind[own + w - 1]) & low).astype(np.int64) + a)
    return np.concatenate(out)


def code(low: np.ndarray, high: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A range of string starts [low, high] in a document and the pointer's offset from the last of them."""
    return (low.astype(_U) << _U(32)) | ((high - low).astype(_U) << _U(16)) | offset.astype(_U)


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and pointer of each range."""
    low, span, offset = (codes >> _U(32)).astype(np.int64), ((codes >> _U(16)) & _U(0xFFFF)).astype(np.int64), (codes & _U(0xFFFF)).astype(np.int64)
    return low, low + span, low + span + offset


class Refiner:
    """The keys of records, blocks and single strings."""

    def __init__(self, length: int = LENGTH, gram: int | None = None, block: int = BLOCK, chunk: int = CHUNK):
        self.length, self.block, self.chunk = length, block, chunk
        self.gram = gram or max(1, min(GRAM, length // 4))

    def records(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Level 1: document number, common key, whole key and range of every record."""
        out, group, size = [], [], 0
        for k, raw in enumerate(texts):
            if len(raw) < self.length:
                continue
            if group and size + len(raw) > self.chunk:
                out.append(self._records(texts, group))
                group, size = [], 0
            group.append(k)
            size += len(raw)
        if group:
            out.append(self._records(texts, group))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, _U))

    def _records(self, texts: list[bytes], group: list[int]) -> tuple[np.ndarray, ...]:
        text = np.frombuffer(b"".join(texts[k] for k in group), np.uint8)
        sizes = np.asarray([len(texts[k]) for k in group])
        begin = np.cumsum(sizes) - sizes
        h = self._hasher(0, len(text))
        prefix = h.prefix(text)
        own = pointers(prefix, len(text), h, self.length, self.gram)
        inside = np.ones(len(text), bool)
        for b, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            inside[b + n - self.length + 1 : b + n] = False
        starts = np.flatnonzero(inside[: len(own)])
        own = own[starts]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        low, at = starts[first], own[first]
        high = starts[np.append(first[1:], len(starts)) - 1]
        common = h.of(prefix, at, at + self.gram)
        whole = h.of(prefix, low, high + self.length) ^ _salt(at - low, at - high)
        doc = np.searchsorted(begin, low, "right") - 1
        base = begin[doc]
        return np.asarray(group)[doc], common, whole, code(low - base, high - base, at - high)

    def _hasher(self, seed: int, size: int) -> Hasher:
        return hasher(seed, max(self.chunk, 1 << (size - 1).bit_length()))

    def blocks(self, raw: bytes, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Level 2: keys and ranges of the aligned blocks of undecided records."""
        low, high, at = decode(codes)
        b1, b2 = (at - high) // self.block, (at - low) // self.block
        count = b2 - b1 + 1
        r = np.repeat(np.arange(len(codes)), count)
        b = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + b1[r]
        at = at[r]
        o1, o2 = b * self.block, b * self.block + self.block - 1
        h = self._hasher(0, len(raw))
        prefix = h.prefix(np.frombuffer(raw, np.uint8))
        # all strings of the block hold what stands from its latest start to its earliest end
        common = h.of(prefix, at - o1, at - o2 + self.length) ^ _salt(o1)
        first, last = np.maximum(at - o2, 0), np.minimum(at - o1, len(raw) - self.length)
        whole = h.of(prefix, first, last + self.length) ^ _salt(at - first, at - last)
        lo, hi = np.maximum(at - o2, low[r]), np.minimum(at - o1, high[r])
        return common, whole, code(lo, hi, at - hi)

    def strings(self, raw: bytes, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Level 3: two independent hashes and the range of each single string of undecided blocks."""
        low, high, _ = decode(codes)
        count = high - low + 1
        start = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        text, keys = np.frombuffer(raw, np.uint8), []
        for seed in (0, 1):
            h = self._hasher(seed, len(raw))
            keys.append(h.of(h.prefix(text), start, start + self.length))
        return keys[0], keys[1], code(start, start, np.zeros_like(start))


#: Answers: strings of a range are all repeated, undecided, or all repeated and wanted as a witness.
ALL, OPEN, WITNESS = 1, 2, 3
_HOT = (1 << 64) - 1


def judge(common: np.ndarray, whole: np.ndarray, weight: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, answers in that order, and the number of different whole texts in each entry's bucket.

    ``weight``: 1 for one range, 2 for several, 0 for the mark of a crowded bucket."""
    order = np.lexsort((whole, common))
    c, w, n = common[order], whole[order], weight[order]
    first_c = np.concatenate([[True], c[1:] != c[:-1]])
    first = first_c | np.concatenate([[True], w[1:] != w[:-1]])
    of_c, of = np.cumsum(first_c) - 1, np.cumsum(first) - 1
    total = np.bincount(of, weights=n)[of]
    crowded = np.bincount(of_c, weights=n == 0)[of_c] > 0
    variety = np.bincount(of_c, weights=first)[of_c]
    answer = np.where(total >= 2, ALL, np.where((variety > 1) | crowded, OPEN, 0)).astype(np.uint8)
    if last:
        answer[answer == OPEN] = 0
    else:
        undecided = np.bincount(of_c, weights=answer == OPEN)[of_c] > 0
        answer[(answer == ALL) & first & (undecided | crowded)] = WITNESS
    return order, answer, variety


def _level(rows: DataFrame, keys, buckets: int, last: bool) -> DataFrame:
    """Packed rows (bucket, handle, common, whole, code, weight) of one level.

    Bucket -1 holds answers that the batch could give alone: ``weight`` then holds the answers."""

    def make():
        give = keys()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            handle, common, whole, codes = give(batch)
            if not len(codes):
                return
            order, answer, variety = judge(common, whole, np.ones(len(codes), np.int64), last)
            handle, common, whole, codes = handle[order], common[order], whole[order], codes[order]
            first = np.concatenate([[True], (common[1:] != common[:-1]) | (whole[1:] != whole[:-1])])
            group = np.cumsum(first) - 1
            several = np.bincount(group)[group] >= 2
            crowd = (variety >= CROWD) & (not last)
            told = np.where(crowd, np.where(several, np.where(first, WITNESS, ALL), OPEN), np.where(several & ~first, ALL, 0)).astype(np.uint8)
            sent = np.flatnonzero(first & ~crowd)
            mark = np.flatnonzero(crowd & np.concatenate([[True], common[1:] != common[:-1]]))
            rows = []
            at = np.flatnonzero(told)
            if len(at):
                rows.append((-1, handle[at].tobytes(), b"", b"", codes[at].tobytes(), told[at].tobytes()))
            c = np.concatenate([common[sent], common[mark]])
            parts = (np.concatenate([handle[sent], np.zeros(len(mark), np.int64)]), c, np.concatenate([whole[sent], np.full(len(mark), _HOT, _U)]), np.concatenate([codes[sent], np.full(len(mark), _HOT, _U)]), np.concatenate([np.where(several[sent], 2, 1), np.zeros(len(mark), np.int64)]).astype(np.uint8))
            to = (c >> _U(33)).astype(np.int64) % buckets
            by = np.argsort(to, kind="stable")
            parts, cuts = [p[by] for p in parts], np.searchsorted(to[by], np.arange(buckets + 1))
            rows += [(b, *(p[x:y].tobytes() for p in parts)) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], names=["bucket", "handle", "common", "whole", "code", "weight"])

        return each

    return map_batches(rows, make, "bucket int, handle binary, common binary, whole binary, code binary, weight binary")


def _dealt(handle: np.ndarray, codes: np.ndarray, answer: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Answers, packed by parts of the handles."""
    to = (handle.view(_U) >> _U(40)).astype(np.int64) % parts
    by = np.argsort(to, kind="stable")
    columns, cuts = [c[by] for c in (handle, codes, answer)], np.searchsorted(to[by], np.arange(parts + 1)).tolist()
    rows = [(k, *(c[x:y].tobytes() for c in columns)) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["part", "handle", "code", "answer"])


_ANSWERS = "part int, handle binary, code binary, answer binary"


def _answers(level: DataFrame, partitions: int, last: bool) -> DataFrame:
    """Packed rows (part, handles, ranges, answers) of what is not decided as unique."""
    parts = partitions

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, w in zip(*(batch.column(k).to_pylist() for k in ("handle", "code", "weight")), strict=True):
                yield from _dealt(np.frombuffer(h, np.int64), np.frombuffer(c, _U), np.frombuffer(w, np.uint8), parts)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        kinds = (np.int64, _U, _U, _U, np.uint8)
        for batch in batches:
            for to, name, kind in zip(held, ("handle", "common", "whole", "code", "weight"), kinds, strict=True):
                to += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
        if not held[0]:
            return
        handle, common, whole, codes, weight = (np.concatenate(x) for x in held)
        held.clear()
        order, answer, _ = judge(common, whole, weight.astype(np.int64), last)
        keep = (answer > 0) & (weight[order] > 0)
        yield from _dealt(handle[order][keep], codes[order][keep], answer[keep], parts)

    local = level.where("bucket = -1").select("handle", "code", "weight").mapInArrow(told, _ANSWERS)
    return level.where("bucket >= 0").repartition(partitions, "bucket").mapInArrow(met, _ANSWERS).union(local)


def _merged(answers: DataFrame, partitions: int, wanted: tuple[int, ...]) -> DataFrame:
    """One row for each handle: its packed ranges with the wanted answers, sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for h, c, a in zip(*(batch.column(k).to_pylist() for k in ("handle", "code", "answer")), strict=True):
                hit = np.isin(np.frombuffer(a, np.uint8), wanted)
                held.append((np.frombuffer(h, np.int64)[hit], np.frombuffer(c, _U)[hit]))
        if not held:
            return
        handle, codes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(handle):
            return
        order = np.lexsort((codes, handle))
        handle, codes = handle[order], codes[order]
        new = np.concatenate([[True], (handle[1:] != handle[:-1]) | (codes[1:] != codes[:-1])])
        handle, codes = handle[new], codes[new]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], handle[1:] != handle[:-1]])), len(handle)).tolist()
        for k in range(0, len(cuts) - 1, 4096):
            part = list(zip(cuts[k : k + 4096], cuts[k + 1 : k + 4097], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(handle[[x for x, _ in part]]), pa.array([codes[x:y].tobytes() for x, y in part], pa.binary())], names=["handle", "codes"])

    return answers.repartition(partitions, "part").mapInArrow(run, "handle bigint, codes binary")


def _with_texts(docs: DataFrame, ranges: DataFrame, how: str = "inner") -> DataFrame:
    """Texts joined to packed ranges.  Both sides are shuffled at every size: nothing bounds the ranges, and copies of
    one text, which share a handle, are split by adaptive execution."""
    return docs.join(ranges.hint("merge"), "handle", how)


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows (handle, codes): packed ranges of starts of repeated strings, for the documents that have any.

    ``docs`` has columns handle and text."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * partitions

    def first():
        refiner = Refiner(length)

        def give(batch: pa.RecordBatch):
            doc, common, whole, codes = refiner.records(binary(batch.column("text")))
            return batch.column("handle").to_numpy()[doc], common, whole, codes

        return give

    def later(name: str):
        def keys():
            refiner = Refiner(length)

            def give(batch: pa.RecordBatch):
                out = []
                for h, raw, codes in zip(batch.column("handle").to_pylist(), binary(batch.column("text")), batch.column("codes").to_pylist(), strict=True):
                    common, whole, c = getattr(refiner, name)(raw, np.frombuffer(codes, _U))
                    out.append((np.full(len(c), h, np.int64), common, whole, c))
                return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), *(np.zeros(0, _U) for _ in range(3)))

            return give

        return keys

    decided, rows, keys, ranges = [], docs, first, None
    for number, step in enumerate(("blocks", "strings", None)):
        level = stage(_level(rows, keys, buckets, step is None), f"level{number}", "none")
        rows = None
        decided.append(stage(_answers(level, partitions, step is None), f"answers{number}"))
        unstage(level, *([ranges] if ranges else []))  # with the texts that were shuffled for this level
        if step:
            ranges = stage(_merged(decided[-1], partitions, (OPEN, WITNESS)), f"open{number}")
            keys, rows = later(step), _with_texts(docs, ranges)
    found = decided[0].union(decided[1]).union(decided[2])
    out = stage(_merged(found, partitions, (ALL, WITNESS)), "repeated")
    unstage(*decided)
    return out


def covered(size: int, codes: bytes | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs [from, to) of bytes inside repeated strings."""
    if not codes:
        return []
    low, high, _ = decode(np.frombuffer(codes, _U))
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high + length, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(step[:-1]) > 0).view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def kept_pieces(raw: bytes, runs: list[tuple[int, int]]) -> list[bytes]:
    ends = [0, *(x for run in runs for x in run), len(raw)]
    return [raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(kept_pieces(raw, runs))


def kept_text(raw: bytes, runs: list[tuple[int, int]]) -> str:
    """What is left as text.  A character of which a byte goes, goes altogether: pieces are read one by one, so the first
    byte of one cut character never meets the last of another."""
    return "".join(piece.decode("utf-8", "ignore") for piece in kept_pieces(raw, runs))


def _handled(docs: DataFrame) -> DataFrame:
    return docs.withColumn("handle", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.length("text")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _handled(docs.select("doc_id", "text"))
    found = repeated(rows.select("handle", "text"), length)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out = []
            for raw, codes in zip(binary(batch.column("text")), batch.column("codes").to_pylist(), strict=True):
                runs = covered(len(raw), codes, length)
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(raw, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c)) for c in zip(*out, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return each

    joined = _with_texts(rows, found, "left").select("doc_id", "text", "codes")
    return map_batches(joined, make, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes gone from their texts; a column n_chars follows the new text."""
    rows = _handled(carried(docs, ["doc_id", "text"]))
    found, names = repeated(rows.select("handle", "text"), length), ["doc_id", "text", "__rest"]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = []
            for raw, codes in zip(binary(batch.column("text")), batch.column("codes").to_pylist(), strict=True):
                texts.append(kept_text(raw, covered(len(raw), codes, length)) if codes else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "cut_text"])

        return each

    joined = _with_texts(rows, found, "left").select(*names, "codes")
    return with_text(map_batches(joined, make, schema_of(joined, names, "cut_text string")), docs, "cut_text")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))
