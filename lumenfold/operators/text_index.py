"""A stored full-text index: postings in segments, dealt by term, that a search reads only where its terms are.

The index is a folder.  A segment holds the postings (term, key, tf, size) of the texts that one update brought, in
partitions by a hash of the term and sorted by term, so Parquet's partition folders and row-group bounds leave a search
with the rows of its terms.  ``texts`` (key, size, segment) says which segment a text's newest postings are in and how
many terms it has; a removed text is one without postings.  Updates append a segment and write the small ``texts`` table
anew; nothing of older segments is rewritten until ``compact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.similarity import tokens

BUCKETS = 64


class TextIndex:
    """An index below ``folder`` (shared) of texts named by ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _texts_path(self, segment: int) -> str:
        return f"{self.folder}/texts-{segment}"

    def _last(self) -> int:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("texts-") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n[6:]) for n in done), default=0)

    def texts(self) -> DataFrame:
        """(key, size, segment) of every text that is in the index."""
        return self.spark.read.parquet(self._texts_path(self._last()))

    def update(self, changed: DataFrame, text: str, removed: DataFrame | None = None) -> None:
        """Put new and changed texts in, and take ``removed`` keys out; readers see all of it or nothing."""
        last = self._last()
        segment = last + 1
        split = changed.select(self.key, tokens(text).alias("terms"))
        words = split.select(self.key, F.size("terms").cast("long").alias("size"), F.explode("terms").alias("term"))
        rows = words.groupBy("term", self.key, "size").agg(F.count("*").alias("tf")).withColumn("bucket", self._bucket("term"))
        # a bucket's rows in parts of one range of terms each
        dealt = rows.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        own = split.select(self.key, F.size("terms").cast("long").alias("size"), F.lit(segment).alias("segment"))
        if last:
            gone = own.select(self.key) if removed is None else own.select(self.key).union(removed.select(self.key))
            own = self.texts().join(gone, self.key, "left_anti").unionByName(own)
        own.write.mode("overwrite").parquet(self._texts_path(segment))

    def postings(self, terms: list[str]) -> DataFrame:
        """Live postings of the terms; folders of other buckets and row groups of other terms are not read."""
        wanted = sorted(set(terms))
        at = [r[0] for r in self.spark.createDataFrame([(t,) for t in wanted], "term string").select(self._bucket("term")).distinct().collect()]
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("bucket").isin(at) & F.col("term").isin(wanted)).drop("bucket", "size")
        return rows.join(self.texts(), [self.key, "segment"])

    def search(self, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) by BM25 of the texts that hold any of the terms; equal to a scan of all texts."""
        found = self.postings(terms)
        tf = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        rows = found.groupBy(self.key, "size").agg(*tf)
        whole = self.texts().agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))  # one row
        about = found.agg(*(F.count_if(F.col("term") == t).alias(f"df{i}") for i, t in enumerate(terms)))
        rows = rows.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(about), F.lit(True))
        parts = []
        for i in range(len(terms)):
            n, d = F.col(f"tf{i}"), F.col(f"df{i}")
            parts.append(F.ln(1 + (F.col("docs") - d + 0.5) / (d + 0.5)) * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("size") / F.col("mean"))))
        return rows.select(self.key, reduce(lambda x, y: x + y, parts).alias("score"))

    def compact(self) -> None:
        """All live postings as one segment, for indexes of many small updates."""
        last, segment = self._last(), self._last() + 1
        live = self.texts()
        rows = self.spark.read.parquet(f"{self.folder}/postings").where(F.col("segment") <= last).drop("size").join(live, [self.key, "segment"]).drop("segment")
        rows.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("parquet.block.size", 1 << 20).partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        live.withColumn("segment", F.lit(segment)).write.mode("overwrite").parquet(self._texts_path(segment))
