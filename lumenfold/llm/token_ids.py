"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` encodes whole texts with a public byte-level BPE and writes ORC files in ascending
doc_id order; ``read_tokens`` reads them back stripe by stripe and prunes stripes and row groups from
metadata when ids are asked for.

Defined results: a null text is empty and holds the end id alone; equal doc_ids stand in the order of
their texts, in the files and by ``start``; a null doc_id comes first; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.llm.bpe import byte_alphabet
from lumenfold.llm.common import Bounded, list_column, map_batches, parts_for, prepare, stage_path, table

END_ID = 2
_SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, row bigint"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts that go to the library whole: white space other than single spaces and one or two line ends between two characters.
_ODD = r"\A[ \n]| \z|  | \n|\n |\n\n\n|\n\n\z|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Latin letters, behind a line end or else a space, and plain marks behind them.
_WORD = r"\A(?P<stem>\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:|#%&*$()\-]*)\z"
#: Longer pieces, in bytes, are encoded each time they come.
_LONG = 64


def _packed(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of ``ids`` as binary values."""
    offsets = np.ascontiguousarray(offsets, np.int64) * ids.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


class _Encoder:
    """Encodes columns of texts and remembers up to ``cache`` pieces of them.

    A single space between two characters that are not white space always starts a new pre-token of this
    family of tokenizers, and a line end before such a character is a pre-token of its own, so texts are cut before both.
    Arrow cuts and numbers the pieces of a column and puts their ids in the places of the pieces; only distinct ones that are
    not remembered are encoded.  A mark that follows a letter starts a pre-token too: a piece of Latin letters
    with plain marks behind is made of the ids of both.  The letters are one pre-token, so they go to the library's model
    directly; other pieces go through the whole library.  Both go many in one call: only the first token of a piece begins
    with a space or a line end.  Texts with white space of any other form go to the library one by one.
    """

    def __init__(self, path: str, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library, self.cache, self.turn = Tokenizer.from_file(path), cache, 0
        self.kind = np.uint16 if self.library.get_vocab_size() <= 65_536 else np.uint32
        self.odd = "|".join([_ODD, *(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values())])
        # byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on
        self.alphabet = "".join(byte_alphabet())
        space, line = self.alphabet[32], self.alphabet[10]
        self.letters = Tokenizer(self.library.model)
        self.letters.pre_tokenizer = pre_tokenizers.Split(Regex(f"{line}|{space}?[^{space}{line}]+"), "isolated")
        tokens = self.library.get_vocab()
        self.begins = np.zeros(max(tokens.values()) + 1, bool)
        self.begins[[i for t, i in tokens.items() if t[0] in (space, line)]] = True
        self.marks, self.line = Bounded(self._whole, 50_000), self._whole("\n")
        self.words, self.ids, self.used = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, pieces: pa.Array, plain: bool) -> pa.Array:
        """Packed ids of distinct pieces; ``plain`` ones are letters alone."""
        behind = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(" ", pieces, ""))
        ids = [np.zeros(0, self.kind)]
        for k in range(0, len(behind), 512):
            joined = "".join(behind[k : k + 512].to_pylist())
            if plain:
                joined = codecs.charmap_decode(joined.encode(), "strict", self.alphabet)[0]
            ids.append(np.asarray((self.letters if plain else self.library).encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind))
        flat = np.concatenate(ids)
        starts = np.flatnonzero(self.begins[flat])
        if len(starts) != len(behind):
            raise ValueError(f"{len(behind)} pieces, but {len(starts)} beginnings of pieces")
        return _packed(flat, np.append(starts, len(flat)))

    def _stems(self, stems: pa.Array, plain: pa.Array) -> pa.Array:
        """Packed ids of pieces without marks: remembered ones come first in one dictionary with them, others are learnt."""
        self.turn += 1
        found = pa.concat_arrays([self.words, stems]).dictionary_encode()
        codes = found.indices[len(self.words) :].to_numpy()
        words, kinds = found.dictionary, np.zeros(len(found.dictionary), bool)
        kinds[codes] = plain.to_numpy(zero_copy_only=False)
        new = np.arange(len(self.words), len(words))
        new = np.concatenate([letters := new[kinds[new]], others := new[~kinds[new]]])
        known = pa.concat_arrays([self.ids, self._learn(words.take(pa.array(letters)), True), self._learn(words.take(pa.array(others)), False)])
        place = np.arange(len(words))
        place[new] = np.arange(len(self.words), len(words))
        out = known.take(pa.array(place[codes]))

        used = np.append(self.used, np.zeros(len(new), np.int64))
        used[codes] = self.turn
        keep = np.flatnonzero(pc.binary_length(words).to_numpy() <= _LONG)
        if len(keep) > self.cache:  # the half that came last stays
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[: self.cache // 2]])
        self.words, self.ids, self.used = words.take(pa.array(keep)), known.take(pa.array(place[keep])), used[keep]
        return out

    def _pieces(self, pieces: pa.Array, end: bytes) -> pa.Array:
        """Packed ids of distinct pieces; the empty one stands for the end of a text."""
        parts = pc.extract_regex(pieces, _WORD)
        plain = parts.is_valid()
        marks = pc.if_else(plain, pc.struct_field(parts, "marks"), "").dictionary_encode()
        behind = pa.array([self.marks[m] for m in marks.dictionary.to_pylist()], pa.large_binary()).take(marks.indices)
        empty = pc.equal(pieces, "")
        stems = self._stems(pc.if_else(empty, "\n", pc.if_else(plain, pc.struct_field(parts, "stem"), pieces)), plain)
        none = pa.scalar(b"", pa.large_binary())
        return pc.if_else(empty, pa.scalar(end, pa.large_binary()), pc.binary_join_element_wise(stems, behind, none))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the places in them where texts begin and the last one ends."""
        width, last = self.kind().itemsize, np.asarray([end], self.kind)
        odd = pc.match_substring_regex(texts, self.odd)
        # a line end before every text: an empty piece and one that holds the text's first
        lists = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\n", pc.if_else(odd, "", texts), ""), "\n", " \n"), " ")
        starts = lists.offsets.to_numpy()
        pieces = lists.flatten().dictionary_encode()
        codes, values = pieces.indices.to_numpy().copy(), self._pieces(pieces.dictionary, last.tobytes())
        first = [v[len(self.line) :] for v in values.take(pa.array(codes[starts[:-1] + 1])).to_pylist()]
        for k in pc.indices_nonzero(odd).to_pylist():
            first[k] = self._whole(texts[k].as_py())
        codes[starts[:-1] + 1] = len(values) + np.arange(len(first))
        _, offsets, data = pa.concat_arrays([values, pa.array(first, pa.large_binary())]).take(pa.array(codes)).buffers()
        begin = np.frombuffer(offsets, np.int64)[starts] // width
        return np.append(np.frombuffer(data, self.kind, begin[-1])[1:], last), begin


@functools.lru_cache(2)  # a worker that is used again keeps what it has learnt
def _encoder(path: str, cache: int) -> _Encoder:
    return _Encoder(path, cache)


def _chunks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows that begin within the same ``size`` bytes of text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(ends)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def write_tokens(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = END_ID, partition_bytes: int = 8 << 20, cache: int = 700_000, chunk_bytes: int = 8 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files whose rows ascend by doc_id over the files' order.

    The range partitioning comes before the encoding, so that sampling its bounds reads texts but encodes
    none.  Columns ``part`` (the file's place) and ``row`` (the document's place in it) let readers add up offsets from metadata-sized columns.
    """
    vocab = vocab or vocabulary()

    def make():
        encode = _encoder(vocab, cache).encode
        row = 0

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal row
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            for a, b in _chunks(texts, chunk_bytes):
                packed, offsets = encode(texts[a:b], end_id)
                place = np.arange(row, row := row + b - a)
                ids = list_column(packed.astype(np.int32), offsets, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(offsets)), ids, pa.array(place)], names=["doc_id", "n_tokens", "ids", "row"])
                pa.default_memory_pool().release_unused()  # tables of pieces come and go with each chunk

        return each

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = docs.repartitionByRange(parts_for(docs, partition_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    out = map_batches(ranged, make, _SCHEMA).withColumn("part", F.spark_partition_id())
    out.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, row, part).  With ``doc_ids``, ORC's indexes and Bloom filters skip the rest."""
    out = spark.read.schema(f"{_SCHEMA}, part int").orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def layout(tokens: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    Totals of each file come from two narrow columns; one row per file is summed up in order, and
    documents are ordered only within their file.
    """

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column("ids")
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("row")], names=["part", "doc_id", "n_tokens", "ids_crc32", "row"])

        return each

    rows = map_batches(tokens.select("part", "doc_id", "n_tokens", "ids", "row"), make, "part int, doc_id bigint, n_tokens bigint, ids_crc32 bigint, row bigint")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(before, "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = stage_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return layout(read_tokens(spark, path))
