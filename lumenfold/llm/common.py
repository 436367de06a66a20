"""Shared pieces: staged tables, block layout, packed exchanges, connected components, bounded caches.

Every operator follows the same layout rules:

* a *staged table* is a Parquet table in the shared folder named by ``spark.checkpoint.dir``; it cuts
  lineage, survives lost executors and makes both sides of later joins plain exchanges that adaptive
  execution can split when a key is hot;
* Python runs over Arrow batches (``mapInArrow`` / ``applyInArrow``), with numpy inside;
* caches inside Python workers are bounded by entry counts, never by luck.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package when the driver was not started from the repository."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, paths) if p)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and all is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = tempfile.mkdtemp(prefix="lumenfold-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_STAGED: list[tuple[SparkSession, str]] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/lumenfold/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table (no error when it is gone already)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _STAGED:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Free staged tables that no later plan reads, and shuffle files that nothing refers to any more."""
    for df in staged:
        drop_path(df.sparkSession, df._staged_path)
    gc.collect()
    staged[0].sparkSession.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = 400_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` (narrow) rows; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(df: DataFrame, bytes_per_part: int, scale: float = 1.0) -> int:
    """Partitions so that each holds about ``bytes_per_part`` of the input as stored, by the optimizer's size.

    Where the optimizer does not know (rows that come from no file), the session's number of shuffle partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 62:
        return least
    return max(least, min(200_000, int(size * scale / bytes_per_part)))


# --------------------------------------------------------------------------- Arrow batches


def binary(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def int_column(values, kind=pa.int64()) -> pa.Array:
    return pa.array(values, type=kind)


def list_column(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of one flat numpy array and its offsets, without Python lists."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))


def carried(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, and all others as one struct ``__rest``, so that no name can clash on the way."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, F.struct(*(rest or [F.lit(0).alias("none")])).alias("__rest"))


def restored(df: DataFrame, docs: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` in their order and types: from ``new``, from ``df`` or from its ``__rest``."""
    held = set(df.columns)
    pick = lambda f: new.get(f.name, F.col(f.name) if f.name in held and f.name in ("doc_id", "text") else F.col("__rest").getField(f.name))
    return df.select(*(pick(f).cast(f.dataType).alias(f.name) for f in docs.schema.fields))


def with_text(df: DataFrame, docs: DataFrame, cut: str) -> DataFrame:
    """``docs`` again, with the new text of column ``cut`` where that is not null; n_chars follows the text."""
    new = {"text": F.coalesce(cut, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(cut).isNotNull(), F.length(cut)).otherwise(F.col("__rest").getField("n_chars"))
    return restored(df, docs, new)


def schema_of(df: DataFrame, keys: list[str], more: str) -> StructType:
    """The fields ``keys`` of ``df`` and those that ``more`` declares."""
    return StructType([*(df.schema[k] for k in keys), *StructType.fromDDL(more).fields])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with state per task: ``make()`` runs once in each task and returns the batch function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


class Bounded(dict):
    """A dict that computes missing entries and keeps between ``size`` and twice as many of the latest.

    ``fill`` gets the missing key.  When the young generation is full it becomes the old one, whose
    entries move back on use, so that frequent keys stay and memory stays bounded.
    """

    __slots__ = ("fill", "old", "size")

    def __init__(self, fill: Callable, size: int = 200_000):
        super().__init__()
        self.fill, self.size, self.old = fill, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


# --------------------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x


# --------------------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable id of every node: rows (node, component) for the nodes of ``edges`` (a, b).

    Labels start at the smallest neighbour and then, in each round, every node takes the smallest label
    among its neighbours and the label of its label (pointer jumping), until nothing changes.  Both
    sides of every join are staged tables, so a hub's edges can be split over tasks; minima are
    aggregated before they are shuffled.  Only one counter per round reaches the driver.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = stage(both.union(both.select(F.col("v"), F.col("u"))).where("u <> v").distinct(), f"{name}-edges")
    labels = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "node"), f"{name}-labels")
    k, done = 0, False
    while not done:
        k += 1
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = labels.join(near, "node").join(hop, "label")
        new = stage(new.select("node", F.least("label", "near", "hop").alias("label"), (F.least("near", "hop") < F.col("label")).alias("moved")), f"{name}-labels{k}")
        done = new.where("moved").isEmpty()
        drop_path(labels.sparkSession, labels._staged_path)
        labels = new.select("node", "label")
        labels._staged_path = new._staged_path
    unstage(both)
    return labels.select("node", F.col("label").alias("component"))
