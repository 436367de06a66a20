"""Tables, checkpoints and the readers and writers of the engine."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGE_SUFFIXES = ("jpg", "jpeg", "heic", "heif", "png", "cr2", "cr3", "nef", "arw", "raf", "dng", "orf", "rw2")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver was not started from its folder."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only where none is set and all is local."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage, survives lost executors, and has a known size.

    Unlike a checkpointed RDD, a table hands no constraints on, which multiply from round to round of a loop."""
    path = f"{shared_folder(df.sparkSession)}/lumenfold-tables/{uuid.uuid4().hex}"
    _WRITTEN.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one when the driver ends."""
    _WRITTEN.append((spark, path))


@atexit.register
def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def walk(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Image files below a folder (path, modificationTime, length, content is read only if asked for); hidden
    folders are left out and paths are distinct."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*suffixes, *(s.upper() for s in suffixes)]) + "}").load(folder)
    return found.where(~F.col("path").rlike(r"/\.[^/]+/")).dropDuplicates(["path"])


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known.select("path"), "path", "left_anti")


def rescan(photos: DataFrame, ts: str, before: str) -> DataFrame:
    """Rows scanned before a date, or never."""
    return photos.where(F.col(ts).isNull() | (F.col(ts) < F.lit(before).cast("timestamp")))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows replace the listed columns of old ones and leave all others (a user's own) alone."""
    n = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = old.join(n, key, "full")
    return out.select(key, *(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns if c != key))


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")


def export_delta(new: DataFrame, exported: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Keys to add to an export and keys to delete from it."""
    return new.select(key).subtract(exported.select(key)), exported.select(key).subtract(new.select(key))


def merged_export(source: DataFrame, exported: DataFrame, key: str, stripped: list[str], cached: list[str], rated: list[str]) -> DataFrame:
    """An export brought up to date, with ``change``: added, deleted, updated or same.

    Each column has its rule: ``stripped`` ones are kept as exported (null in new rows), ``cached`` ones come from the
    source unless that is null, ``rated`` ones keep what the viewer set (neither null nor 0), all others come from the
    source.  Columns that only one side has are left out.  Deleted rows come with what they held, so that a delta can be
    sent; keys are unique."""
    columns = [c for c in source.columns if c in exported.columns and c != key]
    new = source.select(key, F.struct(*columns).alias("_s"))
    old = exported.select(key, F.struct(*columns).alias("_e"))
    both = new.join(old, key, "full")
    s, e = (lambda c: F.col("_s").getField(c)), (lambda c: F.col("_e").getField(c))

    def rule(c: str):
        if c in stripped:
            return e(c)
        if c in cached:
            return F.coalesce(s(c), e(c))
        if c in rated:
            return F.when(F.coalesce(e(c) != 0, F.lit(False)), e(c)).otherwise(s(c))
        return s(c)

    gone, fresh = F.col("_s").isNull(), F.col("_e").isNull()
    after = F.struct(*(rule(c).alias(c) for c in columns))
    out = both.select(key, F.when(gone, F.col("_e")).otherwise(after).alias("_a"), "_e", gone.alias("_gone"), fresh.alias("_fresh"))
    change = F.when(F.col("_gone"), "deleted").when(F.col("_fresh"), "added").when(F.col("_a").eqNullSafe(F.col("_e")), "same").otherwise("updated")
    return out.select(key, "_a.*", change.alias("change"))



def tag_rows(photos: DataFrame, key: str, tags: str) -> DataFrame:
    """(key, tag), once each."""
    from lumenfold.functions import exprs

    return photos.select(key, F.explode(exprs.tags(tags)).alias("tag")).dropDuplicates([key, "tag"])


def sidecars(photos: DataFrame, key: str, score: str, tags: str) -> DataFrame:
    """One XML text for each photo: stars from the score, and its tags."""
    from lumenfold.functions import exprs

    items = F.concat_ws("", F.transform(F.col(tags), lambda t: F.concat(F.lit("<rdf:li>"), F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</rdf:li>"))))
    return photos.select(key, F.format_string('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:Description xmp:Rating="%d"><dc:subject><rdf:Bag>%s</rdf:Bag></dc:subject></rdf:Description></x:xmpmeta>', exprs.stars(score), items).alias("xml"))


def read_sidecars(files: DataFrame) -> DataFrame:
    """Rating and tags from sidecar texts (path, xml)."""
    return files.select("path", F.regexp_extract("xml", 'xmp:Rating="(-?[0-9]+)"', 1).try_cast("int").alias("rating"), F.regexp_extract_all("xml", F.lit("<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1)).alias("tags"))


def benchmark_labels(spark: SparkSession, path: str) -> DataFrame:
    """Mean opinion scores from space-separated vote counts: index, id, ten counts, two tags."""
    raw = spark.read.csv(path, sep=" ")
    votes = [F.col(f"_c{k}").cast("double") for k in range(2, 12)]
    total = sum(votes[1:], votes[0])
    return raw.select(F.col("_c1").alias("id"), (sum((v * (k + 1) for k, v in enumerate(votes[1:], 1)), votes[0]) / total).alias("mos"), F.array("_c12", "_c13").alias("tags"))
