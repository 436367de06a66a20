"""Embedding near-duplicates by randomised-rotation binary codes.

Unit vectors are rotated by one random orthogonal matrix.  A stored vector o is reduced to the signs of its components,
packed, and one correction factor f, the cosine between o and its code c.  A query q is reduced to ``PLANES`` bit
planes of its rotated components, so <c, q> comes from population counts of packed words:

    <c, q'> = (2 (low |c| + step sum_k 2^k popcount(c & plane_k)) - sum q') / sqrt(D),   |<c, q> - <c, q'>| <= |q - q'|.

<c, q> / f is an unbiased estimate of <o, q>.  Its confidence interval follows from geometry and holds with certainty:
the angle between o and q differs from that between c and q by at most the angle between o and c.  Pairs whose upper
bound stays below the threshold are settled by their codes; the others are computed again exactly, in double precision.
For a high threshold this interval is as tight as a statistical one, and no link is lost.

Every pair is decided, as the task is defined.  A tile is a resident block of about ``BLOCK_BYTES`` of vectors, met by
the vectors of one of a few parts, which stream past in Arrow batches; only tiles on or above the diagonal exist.
So a task's memory is bounded, a vector travels (blocks / 2 + parts) times as its own floats, and work grows with
the square of the distinct vectors.  Equal vectors are one class.  A task returns counts of links and the edges
of spanning forests, never pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths never link; rows with equal vec_id, or none, each count as vectors of their own; ids of
components are the smallest vec_ids that are not null, and null where a component has none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import components, map_batches, prepare, stage, table, unstage

#: Bits of a rotated query component, and vectors' bytes (as doubles) in a resident block.
PLANES, BLOCK_BYTES = 3, 16 << 20
#: Pairs that a task may decide before the streamed side is dealt into more parts.
TASK_PAIRS = 1 << 33
#: Pairs below which more parts, for more tasks at once, are not worth their copies of the residents.
FEW_PAIRS = 1 << 25


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of packed 64-bit words."""
    packed = np.packbits(bits, axis=1)
    out = np.zeros((len(bits), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


class Codes:
    """Sign codes of unit vectors with their correction factors."""

    def __init__(self, unit: np.ndarray):
        turned = unit @ rotation(unit.shape[1]).T
        self.dim = unit.shape[1]
        self.words = _words(turned >= 0)
        self.ones = (turned >= 0).sum(1)
        self.factor = np.abs(turned).sum(1) / np.sqrt(self.dim)  # cosine between vector and code

    def least(self, threshold: float) -> np.ndarray:
        """The smallest <c, q> at which <o, q> can reach ``threshold``."""
        return np.cos(np.minimum(np.pi, np.arccos(np.clip(self.factor, -1, 1)) + np.arccos(np.clip(threshold, -1, 1)))) - 1e-6


class Planes:
    """Unit queries as bit planes of their rotated components."""

    def __init__(self, unit: np.ndarray):
        turned = unit @ rotation(unit.shape[1]).T
        top = (1 << PLANES) - 1
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / top, 1e-6)
        grid = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, top).astype(np.uint8)
        near = self.low[:, None] + self.step[:, None] * grid
        self.sum, self.off = near.sum(1), np.sqrt(((turned - near) ** 2).sum(1)) + 1e-9
        self.words = [_words((grid >> k) & 1 == 1) for k in range(PLANES)]

    def counts(self, codes: Codes, rows: slice) -> np.ndarray:
        """Sum of the grid values of each query over the ones of each code, highest plane first."""
        out = None
        for plane in reversed(self.words):
            if out is not None:
                out = out.astype(np.uint16 if codes.dim << PLANES < 1 << 16 else np.uint32) if codes.dim << PLANES >= 256 else out
                out <<= 1
            for w in range(plane.shape[1]):
                ones = np.bitwise_count(codes.words[rows, w, None] & plane[None, :, w])
                if out is None:
                    out = ones if codes.dim < 256 else ones.astype(np.uint16 if codes.dim << PLANES < 1 << 16 else np.uint32)
                else:
                    out += ones
        return out


def estimates(codes: Codes, planes: Planes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbiased estimates of all inner products, and their certain lower and upper bounds."""
    n = planes.counts(codes, slice(None))
    c = (2 * (planes.low * codes.ones[:, None] + planes.step * n) - planes.sum) / np.sqrt(codes.dim)
    own = np.arccos(np.clip(codes.factor, -1, 1))[:, None]
    least, most = (np.arccos(np.clip(c + d * planes.off, -1, 1)) for d in (1, -1))
    return c / codes.factor[:, None], np.cos(np.minimum(np.pi, most + own)), np.cos(np.maximum(0, least - own))


def links(codes: Codes, a: np.ndarray, b: np.ndarray, threshold: float, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions (i, j) with cosine of at least ``threshold`` between unit rows of ``a`` (coded) and ``b``, and the
    number of pairs whose bound made an exact computation necessary."""
    planes, found, tried = Planes(b), [], 0
    # the bound as a smallest count: (2 (low ones + step n) - sum) / sqrt(D) + off >= least, as one small product
    scale = 1 / (2 * planes.step)
    of_codes = np.stack([codes.least(threshold) * np.sqrt(codes.dim), np.ones(len(a)), codes.ones], 1).astype(np.float32)
    of_planes = np.stack([scale, (planes.sum - planes.off * np.sqrt(codes.dim)) * scale, -planes.low / planes.step]).astype(np.float32)
    of_planes[1] -= np.float32(1e-5) * np.abs(of_planes).max(0)  # single precision: the bound only gets looser
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(planes.counts(codes, slice(at, at + step)) >= of_codes[at : at + step] @ of_planes)
        tried += len(i)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            found.append((x[hit], y[hit]))
    none = np.zeros(0, int)
    return (np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)]), tried)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of n positions: labels fall along links until they rest."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Packed vectors of one length as unit rows of doubles."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _tiles(threshold: float, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tile, own: -1 for residents, else whether a streamed vector is of the resident block, node, size, raw), by
    tile, residents first -> (node, least, n): counts of links and forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = codes = None
        rest: list[tuple] = []
        resident = np.zeros((0, 0))
        nodes = sizes = label = count = np.zeros(0, np.int64)

        def rows(node, least, n):
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least), pa.array(n.astype(np.int64))], names=["node", "least", "n"])

        def met(own: np.ndarray, node: np.ndarray, size: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal label
            i, j, _ = links(codes, resident, vectors, threshold)
            off = nodes[i] != node[j]
            i, j = i[off], j[off]
            if not len(i):
                return
            np.add(count, np.bincount(i, weights=size[j], minlength=len(nodes)).astype(np.int64), out=count)
            other = own[j] == 0  # within a block each of a pair is streamed to the other; else it meets once
            n = np.bincount(j[other], weights=sizes[i[other]], minlength=len(node))
            every = _forest(len(nodes) + len(node), np.concatenate([i, np.arange(len(nodes))]), np.concatenate([len(nodes) + j, label]))
            label = every[: len(nodes)]
            hit = np.unique(j)
            yield rows(node[hit], nodes[every[len(nodes) + hit]], n[hit])

        def done() -> Iterator[pa.RecordBatch]:
            """What the residents of a tile have met: one row each, however many met them."""
            hit = np.flatnonzero(count)
            if codes is not None and len(hit):
                yield rows(nodes[hit], nodes[label[hit]], count[hit])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "own", "node", "size")]
            raw = batch.column("raw").to_pylist()
            edge = np.flatnonzero(np.diff(columns[0])) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), len(raw)], strict=True):
                if columns[0][x] != tile:
                    yield from done()
                    tile, codes, rest = columns[0][x], None, []
                own = columns[1][x:y]
                cut = x + int(np.searchsorted(own, 0))  # residents first
                if cut > x:
                    rest.append((columns[2][x:cut], columns[3][x:cut], raw[x:cut]))
                if cut < y and rest:
                    if codes is None:
                        nodes, sizes = (np.concatenate([r[k] for r in rest]) for k in (0, 1))
                        resident = _unit([v for r in rest for v in r[2]], kind)
                        codes, label, count = Codes(resident), np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
                    yield from met(own[cut - x :], columns[2][cut:y], columns[3][cut:y], _unit(raw[cut:y], kind))
        yield from done()

    return run


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """Classes of equal vectors (node, size, embedding) -> node, size, dim and the vector, packed as it is."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            raw = [np.asarray(x, kind).tobytes() for x in batch.column("embedding").to_pylist()]
            dims = [len(x) // np.dtype(kind).itemsize for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("size"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["node", "size", "dim", "raw"])

        return each

    return map_batches(rows.select("node", "size", "embedding"), make, "node bigint, size bigint, dim int, raw binary")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block: int | None = None) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.  ``block``: vectors in a resident
    block, by default what ``BLOCK_BYTES`` hold."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(good, F.lit(False))
    rows = rows.select("vec_id", F.when(usable, F.xxhash64("embedding")).alias("key"), F.when(usable, F.col("embedding")).alias("embedding"))
    # two keys of equal vectors differ only for -0.0, which is another exact pair to find
    grouped = rows.where("key is not null").groupBy("key", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = stage(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    units = stage(_packed(classes, kind), "vectors")
    about = units.agg(F.count("*"), F.max("dim")).first()
    block = block or max(256, BLOCK_BYTES // (8 * max(1, about[1] or 1)))
    blocks = max(1, -(-about[0] // block))
    pairs = about[0] * min(block, about[0])
    parts = max(1, -(-pairs // TASK_PAIRS), min(-(-2 * partitions // blocks), -(-pairs // FEW_PAIRS)))
    own = units.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("long")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("long"))
    span = lambda a, b: F.sequence(F.lit(a).cast("long"), b if not isinstance(b, int) else F.lit(b).cast("long"))
    settled = F.transform(span(0, parts - 1), lambda p: F.struct(F.col("block").alias("x"), p.alias("y"), F.lit(-1).alias("own")))
    streamed = F.transform(span(0, F.col("block")), lambda x: F.struct(x.alias("x"), F.col("part").alias("y"), (x == F.col("block")).cast("int").alias("own")))
    tiles = own.withColumn("to", F.explode(F.concat(settled, streamed))).select(((F.col("dim") * F.lit(blocks) + F.col("to.x")) * F.lit(parts) + F.col("to.y")).alias("tile"), "to.own", "node", "size", "raw")
    met = tiles.repartition(max(partitions, blocks * parts), "tile").sortWithinPartitions("tile", "own").mapInArrow(_tiles(threshold, kind), "node bigint, least bigint, n bigint")
    found = stage(met, "vector-links")
    near = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), "vectors")
    named = classes.select("node", "rep").join(near, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    every = named.join(least, "component").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
    linked = classes.select("node", "key", F.col("embedding").alias("own"), "size").join(every.select("node", "least", "n"), "node")
    linked = stage(linked.select("key", "own", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "least"), "vector-classes-linked")
    unstage(units, found, classes)
    out = rows.withColumn("own", F.col("embedding")).drop("embedding").join(linked, ["key", "own"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "embeddings"))
