"""BPE encoding and decoding with forced boundaries.

A merge can only ever make a vocabulary token, so two neighbouring symbols that stand next to each other
inside no token of the vocabulary are never merged: a certain cut.  Words are cut at all such pairs,
the fragments are encoded on their own (each distinct one once) and the results are concatenated.

Defined results: a null text is empty, has no ids and decodes to the empty text; white space alone does
as well; special tokens written out in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.common import Bounded, binary, map_batches, prepare, table


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class WordBPE:
    """Encoder and decoder for a word-ended, lower-casing BPE vocabulary file.

    A word is held as a string of one character for each starting symbol: the byte's printable stand-in,
    and for the last one the same character moved up by ``END``.
    """

    END = 0x1000
    #: Fragments of more symbols than this are merged with a heap.
    LONG = 48
    #: Words of Latin-1 letters with plain marks behind them: normalisation changes their case alone.
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,!?;:|#%&*$()\\-]*)")

    def __init__(self, path: str, cache: int = 250_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.texts = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.inside = frozenset(w[k : k + 2] for t in self.vocab for w in [self._symbols(t)] for k in range(len(w) - 1))
        self.library = Tokenizer.from_file(path)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.fragment = Bounded(self._merge, cache // 4)
        self.piece = Bounded(self._piece, cache)

    def _symbols(self, token: str) -> str:
        """A token as its starting symbols."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + self.END)
        return token

    def fragments(self, word: str) -> list[str]:
        """Cut where no token can span."""
        out, at, inside = [], 0, self.inside
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def _merge(self, fragment: str) -> bytes:
        """Merge by rank, lowest first and leftmost among equals, until nothing more can merge."""
        parts = [c if ord(c) < self.END else chr(ord(c) - self.END) + self.suffix for c in fragment]
        parts = self._merge_long(parts) if len(parts) > self.LONG else self._merge_short(parts)
        return np.asarray([self.vocab[p] for p in parts if p in self.vocab], np.uint32).tobytes()

    def _merge_short(self, parts: list[str]) -> list[str]:
        rank, never = self.ranks.get, 1 << 30
        ranks = [rank(p, never) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), never)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), never)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same over a linked list with a heap of pairs: n log n for a fragment of n symbols."""
        rank, n = self.ranks.get, len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if not parts[k] or j < 0 or rank((parts[k], parts[j])) != r:
                continue  # one of the pair has merged since
            parts[k], parts[j] = parts[k] + parts[j], ""
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (new := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (new, x))
        return [p for p in parts if p]

    def _piece(self, raw: bytes) -> bytes:
        """Ids of a text without ASCII white space."""
        text = raw.decode("utf-8")
        if plain := self.PLAIN.fullmatch(text):
            words = [w.encode().decode("latin-1").translate(self.alphabet) for w in (plain[1].lower(), plain[2]) if w]
        elif self.split_special and len(parts := self.split_special.split(text)) > 1:
            return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else self._piece(p.encode()) for p in parts if p)
        else:  # the library's own normalisation and pre-tokenisation; its words are in the byte alphabet
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        fragment = self.fragment
        return b"".join([fragment[f] for w in words for f in self.fragments(w[:-1] + chr(ord(w[-1]) + self.END))])

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text, packed as little-endian unsigned 32-bit integers.

        No word or special token holds white space, so texts are first cut there."""
        return b"".join(map(self.piece.__getitem__, raw.split()))

    def decode(self, ids: np.ndarray) -> str:
        """Without a decoder in the vocabulary file, tokens are joined by single spaces."""
        return " ".join(map(self.texts.__getitem__, ids.tolist()))


@functools.lru_cache(2)  # a worker that is used again keeps what it has learnt
def _bpe(path: str) -> WordBPE:
    return WordBPE(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids and decoded."""

    def make():
        bpe = _bpe(path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = []
            for raw in binary(batch.column("text")):
                packed = bpe.encode(raw)
                ids = np.frombuffer(packed, "<u4")
                text = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), *([ids.astype(np.int32)] if keep_ids else []), *([text] if keep_text else [])))
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=[x.split()[0] for x in schema.split(", ")])

        return each

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return map_batches(docs.select("doc_id", "text"), make, schema)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary())
