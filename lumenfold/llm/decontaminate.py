"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Training words stream through an automaton built over all items; it keeps the length of the longest item
substring that ends at each word.  A word is hit when it lies inside an occurrence of a window: ``WINDOW``
consecutive words of an item, or a whole item that has fewer.

Only test items are held in memory.  They are packed into automata of at most ``shard_words`` words (or one item),
each built and broadcast on its own.  With more test data there are more automata; a task then holds one of them
at a time, for a batch of documents, so its memory does not follow the size of the benchmark.

Defined results: null, empty and wordless documents have no words and are clean; null and wordless items
have no windows; items with equal texts all count, equal item_ids count once; items with a null item_id make
hits and coverage like others, but n_items and items_sha256 leave them out; extra columns pass by
``decontaminate`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import binary, carried, map_batches, prepare, schema_of, table, with_text

WINDOW = 13
#: Words are runs of digits, letters and all bytes beyond ASCII; A-Z count as a-z.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normalise(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class ItemAutomaton:
    """A suffix automaton over the word sequences of several items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str | None] = []
        sequences: list[list[int]] = []
        for name, raw in items:
            w = [self.words.setdefault(x, len(self.words)) for x in normalise(raw)]
            if w:
                self.names.append(name)
                sequences.append(w)
        #: The shortest run of known words that can hold an occurrence.
        self.least = min((min(len(w), window) for w in sequences), default=0)
        for w in sequences:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self._mark(sequences)

    def _extend(self, last: int, c: int) -> int:
        """Append a word to the item that ends in state ``last``."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        """Split off the shorter strings of state ``q``."""
        new = self._state(self.length[p] + 1)
        self.next[new], self.link[new] = dict(self.next[q]), self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _mark(self, sequences: list[list[int]]) -> None:
        """For the states that hold windows: the window's length and the items that it occurs in; for each state,
        the nearest one on its chain of suffixes, itself included, that holds any."""
        self.found: list[dict[int, set[int]]] = [{} for _ in self.link]
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        top = list(range(len(self.link)))  # the state whose strings include the last ``window`` words
        for s in by_length:
            if self.length[self.link[s]] >= self.window:
                top[s] = top[self.link[s]]
        for item, w in enumerate(sequences):
            state = size = 0
            short = len(w) if len(w) < self.window else 0
            for c in w:
                state, size = self.step(state, size, c)
                if not short and size >= self.window:
                    self.found[top[state]].setdefault(self.window, set()).add(item)
            if short:
                s = top[state]
                while self.length[self.link[s]] >= short:
                    s = self.link[s]
                self.found[s].setdefault(short, set()).add(item)
        self.marked = [0] * len(self.link)
        for s in by_length:
            self.marked[s] = s if self.found[s] else self.marked[self.link[s]]

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """One more word: the state and length of the longest item substring that ends with it."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, size + 1)

    def match(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs [from, to) of hit words, and the names of items with occurring windows, if they have one.

        Runs of known words too short for any window are passed over without a step."""
        if not self.least or len(w) < self.least:
            return [], set()
        ids = np.fromiter((self.words.get(x, -1) for x in w), np.int32, len(w))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).view(np.int8), [0]])))
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        met: set[tuple[int, int]] = set()  # states and lengths whose items are in
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = size = 0
            for at in range(a, b):
                state, size = self.step(state, size, int(ids[at]))
                s = self.marked[state]
                while s:  # at most ``window`` states: one for each length of window
                    for n, of in self.found[s].items():
                        if n <= size:
                            if (s, n) not in met:
                                met.add((s, n))
                                items |= of
                            start = at + 1 - n
                            while runs and runs[-1][1] >= start:
                                start = min(start, runs.pop()[0])
                            runs.append((start, at + 1))
                    s = self.marked[self.link[s]]
        return runs, {self.names[k] for k in items} - {None}


def automata(benchmark: DataFrame, window: int = WINDOW, shard_words: int = 500_000) -> list:
    """The items, packed into broadcast automata of at most ``shard_words`` words (or one item)."""
    spark = benchmark.sparkSession
    out, pack, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        raw = row["text"].encode()
        n = len(normalise(raw))
        if pack and size + n > shard_words:
            out.append(spark.sparkContext.broadcast(ItemAutomaton(pack, window)))
            pack, size = [], 0
        pack.append((row["item_id"], raw))
        size += n
    if pack:
        out.append(spark.sparkContext.broadcast(ItemAutomaton(pack, window)))
    return out


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of word runs, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    """A text without the words of ``runs`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]])


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut: bool = False, keys: list[str] | None = None, shard_words: int = 500_000) -> DataFrame:
    """Per row of ``docs``: its ``keys``, n_words, n_hit, n_items, items_sha256, contaminated, and with
    ``cut`` the text without its hit spans (null if nothing was hit)."""
    keys = keys or ["doc_id"]
    shared = automata(benchmark, window, shard_words)

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raws = binary(batch.column("text"))
            runs: list[list[tuple[int, int]]] = [[] for _ in raws]
            names: list[set[str]] = [set() for _ in raws]
            sizes = [0] * len(raws)
            for one in shared:
                for k, raw in enumerate(raws):
                    w = normalise(raw)
                    sizes[k] = len(w)
                    r, of = one.value.match(w)
                    runs[k] += r
                    names[k] |= of
                if len(shared) > 1:
                    one.__dict__.pop("_value", None)  # loaded again from the executor's disk for the next batch
            if not shared:
                sizes = [len(normalise(raw)) for raw in raws]
            rows, texts = [], []
            for raw, n, r, of in zip(raws, sizes, map(joined, runs), names, strict=True):
                hit = sum(b - a for a, b in r)
                rows.append((n, hit, len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
                texts.append(without(raw, r).decode() if cut and r else None)
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns, *([pa.array(texts, pa.string())] if cut else [])], names=[*keys, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(["cut_text"] if cut else [])])

        return each

    schema = schema_of(docs, keys, "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean" + ", cut_text string" * cut)
    return map_batches(docs.select(*dict.fromkeys([*keys, "text"])), make, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents over the coverage limit go; the hit spans, which exceed the length limit, are cut from the
    others.  Columns stay as they are; a column n_chars follows the new text."""
    found = scan(carried(docs, ["text"]), benchmark, cut=True, keys=["text", "__rest"])
    return with_text(found.where(~F.col("contaminated")), docs, "cut_text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
