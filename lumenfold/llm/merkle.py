"""Merkle manifest of a dataset: distributed block reduction, a small top tree, proofs and folds for every row.

Rows are leaves; the leaves of a source, in order, form a tree of arity three whose root is the subroot of that
source, and the subroots, in order of their sources, form the tree of the root.

1. Leaves are hashed where the texts are; only digests travel from then on.  A range sort deals them by
   (source, doc_id) over the cluster, so a source that holds a third of all rows is many partitions, and positions
   follow from the sizes of the partitions before (one record for each partition reaches the driver).
2. Consecutive leaves of a source form blocks of a power of three.  A task reduces a block to its root.
3. While more than ``top`` roots are left they are reduced in blocks again, within their sources and then over the
   sources.  The driver builds the tree of what remains, at most ``top`` nodes, and broadcasts for each of them the
   *suffix path*: the siblings from there to the root, ``top`` * 128 * log3(``top``) bytes at most.
4. Tasks build each block's lower levels again, put the suffix path behind each leaf's own siblings, and fold each
   row's leaf as found now up to a root.

Defined cases: null fields hash as ``-``; a null source is a source of its own and comes first; a null doc_id comes
first in its source; rows of one doc_id are in order of their leaves, and rows that are equal throughout take
neighbouring places, each with its own proof; an empty table has no rows and no root; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import drop_path, map_batches, parts_for, prepare, schema_of, stage, table

ARITY = 3
#: Levels that one task reduces at once: a block holds 3 ** 8 = 6,561 nodes.
HEIGHT = 8
#: Nodes that the driver's tree may have as leaves: 26 MB of suffix paths at most.
TOP = 20_000
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# --------------------------------------------------------------------------- trees of hex digests


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def levels(nodes: list[bytes], height: int | None = None) -> list[list[bytes]]:
    """All levels from ``nodes`` up: ``height`` of them, or as many as leave one node."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        low = out[-1]
        out.append([digest(b"".join(low[i : i + ARITY])) for i in range(0, len(low), ARITY)])
    return out


def paths(tree: list[list[bytes]], suffix: tuple[bytes, bytes] = (b"", b"")) -> list[tuple[bytes, bytes]]:
    """For each leaf of a tree: its siblings, level by level and left to right, and its place among them.

    Places are two digits a level: the position in the run, and the run's length.  ``suffix`` goes behind."""
    above = [suffix] * len(tree[-1])
    for level in reversed(tree[:-1]):
        here = []
        for i in range(len(level)):
            k = i % ARITY
            run = level[i - k : i - k + ARITY]
            proof, places = above[i // ARITY]
            here.append((b"".join(run[:k]) + b"".join(run[k + 1 :]) + proof, b"%d%d" % (k, len(run)) + places))
        above = here
    return above


def fold(leaf: bytes, proof: bytes, places: bytes) -> bytes:
    """The root that a leaf and the siblings of its proof give."""
    at = 0
    for k in range(0, len(places), 2):
        before, size = 64 * (places[k] - 48), 64 * (places[k + 1] - 49)
        leaf = digest(proof[at : at + before] + leaf + proof[at + before : at + size])
        at += size
    return leaf


# --------------------------------------------------------------------------- positions and blocks


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of a row, as 32 bytes; ``columns`` replace fields of the row."""
    parts = []
    for name in FIELDS:
        value = columns.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def positioned(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place ``pos`` among those of their ``source``, by doc_id, hash and tie (staged)."""
    order = ["source", "doc_id", "hash", "tie"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, n, last = TaskContext.get().partitionId(), -1, 0, ()
        for batch in batches:
            runs, places = [], []
            for source in batch.column("source").to_pylist():
                if source != last:
                    run, n, last = run + 1, 0, source
                runs.append(run)
                places.append(n)
                n += 1
            more = {"part": pa.array([part] * len(runs), pa.int32()), "run": pa.array(runs, pa.int64()), "n": pa.array(places, pa.int64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    dealt = rows.repartitionByRange(parts_for(rows, 32 << 20), *order).sortWithinPartitions(*order)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = stage(dealt.mapInArrow(number, f"{fields}, part int, run long, n long"), name)
    ends = placed.groupBy("part").agg(F.min_by("source", "run").alias("first"), F.max(F.struct("run", "n", "source")).alias("end"))
    starts, carry, last = [], 0, ()
    for part, first, end in sorted(ends.collect(), key=lambda r: r["part"]):  # one record for each partition
        start = carry if first == last else 0
        starts.append((part, start))
        carry, last = end["n"] + 1 + (start if end["run"] == 0 else 0), end["source"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start long"))
    out = placed.join(offsets, "part").withColumn("pos", F.col("n") + F.when(F.col("run") == 0, F.col("start")).otherwise(0)).drop("part", "run", "n", "start")
    out._staged = placed
    return out


def blocks(nodes: DataFrame, parts: int, carried: list[str], height: int, name: str) -> DataFrame:
    """Blocks (over, source, block, members, root) of nodes (over, source, pos, hash and ``carried``), staged.

    A first block that is not full holds all nodes of its tree and is reduced until one is left; others by ``height``."""
    size = ARITY**height
    members = F.sort_array(F.collect_list(F.struct("pos", "hash", *carried))).alias("members")
    keys = ["over", "source", F.expr(f"pos div {size}").alias("block")]
    packed = nodes.repartition(parts, *keys).groupBy(*keys).agg(members)

    def reduce():
        def each(batch):
            roots = []
            for block, hashes in zip(batch.column("block").to_pylist(), batch.column("members"), strict=True):
                leaves = [h.hex().encode() for h in pa.array(hashes.values).field("hash").to_pylist()]
                roots.append(bytes.fromhex(levels(leaves, None if block == 0 and len(leaves) < size else height)[-1][0].decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

        return each

    schema = schema_of(packed, packed.columns, "root binary")
    return stage(map_batches(packed, reduce, schema), name)


def top_tree(roots: list, over: bool) -> tuple[list[tuple], bytes]:
    """The driver's tree: the suffix path of each node (source, block, hash), and the root."""
    if over:
        tree = levels([r["root"].hex().encode() for r in sorted(roots, key=lambda r: r["block"])])
        return [(True, None, k, p.decode(), q.decode(), None) for k, (p, q) in enumerate(paths(tree))], tree[-1][0]
    if not roots:
        return [], b""
    sources: dict[str | None, list] = {}
    for r in sorted(roots, key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["block"])):
        sources.setdefault(r["source"], []).append(r["root"].hex().encode())
    trees = {source: levels(found) for source, found in sources.items()}
    tree, out = levels([t[-1][0] for t in trees.values()]), []
    for (source, own), suffix in zip(trees.items(), paths(tree), strict=True):
        out += [(False, source, k, p.decode(), q.decode(), own[-1][0].decode()) for k, (p, q) in enumerate(paths(own, suffix))]
    return out, tree[-1][0]


SUFFIX = "over boolean, source string, block long, proof string, places string, subroot string"


def with_suffix(layer: DataFrame, suffix: DataFrame) -> DataFrame:
    here = suffix.withColumnRenamed("over", "over_").withColumnRenamed("source", "source_").withColumnRenamed("block", "block_")
    same = (F.col("over") == F.col("over_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("block") == F.col("block_"))
    return layer.join(here, same).drop("over_", "source_", "block_")


def lower_suffixes(layer: DataFrame, height: int) -> DataFrame:
    """Suffix paths of the members of a layer's blocks, for the layer below (rows as in ``SUFFIX``)."""

    def extend():
        def each(batch):
            for row in batch.to_pylist():
                hashes = [m["hash"].hex().encode() for m in row["members"]]
                sole = row["block"] == 0 and len(hashes) < ARITY**height
                found = paths(levels(hashes, None if sole else height), (row["proof"].encode(), row["places"].encode()))
                below = [(m["from_over"], m["from_source"], m["from_block"], p.decode(), q.decode(), row["subroot"] or (h.decode() if row["over"] and not m["from_over"] else None)) for m, h, (p, q) in zip(row["members"], hashes, found, strict=True)]
                names = [f.split()[0] for f in SUFFIX.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, b, strict=True)) for b in below], schema=_SUFFIX_ARROW)

        return each

    return map_batches(layer, extend, SUFFIX)


_SUFFIX_ARROW = pa.schema([("over", pa.bool_()), ("source", pa.string()), ("block", pa.int64()), ("proof", pa.string()), ("places", pa.string()), ("subroot", pa.string())])
PROVED = "doc_id long, leaf string, subroot string, root string, proof string, places string, folded_root string, verified boolean"


def proved(layer: DataFrame, height: int, root: bytes) -> DataFrame:
    """A row for every leaf: its proof, and the root that its leaf as found now folds to."""
    whole = root.decode()

    def finish():
        def each(batch):
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                block, proof, places, subroot = (one.column(c)[0].as_py() for c in ("block", "proof", "places", "subroot"))
                members = pa.array(one.column("members")[0].values)
                leaves = [h.hex().encode() for h in members.field("hash").to_pylist()]
                now = [h if x is None else x.hex().encode() for h, x in zip(leaves, members.field("found").to_pylist(), strict=True)]
                sole = block == 0 and len(leaves) < ARITY**height
                found = paths(levels(leaves, None if sole else height), (proof.encode(), places.encode()))
                folded = [fold(h, p, q).decode() for h, (p, q) in zip(now, found, strict=True)]
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        members.field("doc_id"), pa.array([h.decode() for h in leaves]), pa.array([subroot] * n, pa.string()), pa.array([whole] * n),
                        pa.array([p.decode() for p, _ in found]), pa.array([q.decode() for _, q in found]), pa.array(folded), pa.array([f == whole for f in folded]),
                    ],
                    [f.split()[0] for f in PROVED.split(", ")],
                )

        return each

    return map_batches(layer, finish, PROVED)


def manifest(docs: DataFrame, text_now: Column | None = None, height: int = HEIGHT, top: int = TOP) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and whether the row as found now still folds to the root.

    ``text_now`` is the text as found later (null where it is as it was); without it each row's own leaf is folded.
    Columns: doc_id, leaf, subroot, root, proof (hex digests of the siblings), places (two digits a level: position
    in the run and its length), folded_root, verified."""
    prepare(docs.sparkSession)
    now = leaf_of({"text": text_now}) if text_now is not None else F.lit(None).cast("binary")
    changed = F.when(text_now.isNotNull(), now) if text_now is not None else now
    leaves = stage(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of({}).alias("hash"), changed.alias("found"), F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    nodes = positioned(leaves, "merkle-places")
    layers, over = [blocks(nodes.withColumn("over", F.lit(False)), parts_for(leaves, 32 << 20), ["doc_id", "found"], height, "merkle-blocks")], False
    for spent in (leaves, nodes._staged):
        drop_path(spent.sparkSession, spent._staged_path)
    while layers[-1].select("block").limit(top + 1).count() > top:
        below = layers[-1].select("over", "source", F.col("block").alias("pos"), F.col("root").alias("hash"), F.col("over").alias("from_over"), F.col("source").alias("from_source"), F.col("block").alias("from_block"))
        if not over and below.where("pos > 0").isEmpty():  # every source is one node: the tree over the sources begins
            over = True
            ranked = below.select(F.lit("").alias("source"), F.col("from_source").alias("doc_id"), "hash", F.lit(0).alias("tie"), "from_over", "from_source", "from_block")
            below = positioned(ranked, "merkle-sources").withColumn("over", F.lit(True)).withColumn("source", F.lit(None).cast("string"))
        layers.append(blocks(below, parts_for(layers[-1], 1 << 30), ["from_over", "from_source", "from_block"], height, "merkle-roots"))
    found, root = top_tree(layers[-1].select("source", "block", "root").collect(), over)
    suffix = F.broadcast(docs.sparkSession.createDataFrame(found, SUFFIX))
    for layer in reversed(layers[1:]):
        suffix = stage(lower_suffixes(with_suffix(layer, suffix), height), "merkle-suffixes")
    return proved(with_suffix(layers[0], suffix), height, root)


# --------------------------------------------------------------------------- query


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``, held against copies of which every second one lost its line feeds."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    rows = manifest(docs, tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
