"""Scan runs: an append-only log, what to scan again, and measures that are only taken again where members are new.

The log is a folder of Parquet files: a record is an event of a run (``started``, ``progress``, ``failed``, ``finished``)
and never changes, so writers do not wait for each other and a run that died leaves what it had said.  A run's row is an
aggregate over its events.  Measures are kept in generations in the same way: a pass appends the runs that it measured,
and the newest generation of a run is its measure.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run long, at timestamp, event string, mode string, settings string, total long, processed long, path string, stage string, error string, status string"
STALE_SECONDS = 120
ERROR_LENGTH = 500


class RunLog:
    """Events of scan runs below ``folder`` (shared)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, rows: DataFrame) -> None:
        rows.select(*(F.col(f.split()[0]) if f.split()[0] in rows.columns else F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in LOG.split(", "))).write.mode("append").parquet(self.folder)

    def _say(self, **values) -> None:
        names = [f for f in LOG.split(", ") if f.split()[0] in values]
        self._append(self.spark.createDataFrame([tuple(values[f.split()[0]] for f in names)], ", ".join(names)).coalesce(1))

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.folder)
        except Exception as e:  # nothing was ever written
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def start(self, mode: str, settings: dict, total: int, at: datetime) -> int:
        run = (self.events().agg(F.max("run")).first()[0] or 0) + 1
        self._say(run=run, at=at, event="started", mode=mode, settings=json.dumps(settings, sort_keys=True), total=total)
        return run

    def progress(self, run: int, processed: int, at: datetime) -> None:
        self._say(run=run, at=at, event="progress", processed=processed)

    def failures(self, run: int, failed: DataFrame, at: datetime) -> None:
        """Failures (path, stage, error) of a run; errors are cut to 500 characters."""
        self._append(failed.select("path", "stage", F.substring("error", 1, ERROR_LENGTH).alias("error"), F.lit(run).cast("long").alias("run"), F.lit(at).cast("timestamp").alias("at"), F.lit("failed").alias("event")))

    def finish(self, run: int, status: str, at: datetime) -> None:
        self._say(run=run, at=at, event="finished", status=status)

    def runs(self) -> DataFrame:
        return run_rows(self.events())


def run_rows(events: DataFrame) -> DataFrame:
    """One row for each run; a run without an end is ``running``, its heartbeat the newest of its events."""
    is_ = lambda e: F.col("event") == e
    rows = events.groupBy("run").agg(
        F.min(F.when(is_("started"), F.col("at"))).alias("started"), F.max("at").alias("heartbeat"), F.max(F.when(is_("finished"), F.col("at"))).alias("finished"),
        F.max("mode").alias("mode"), F.max("settings").alias("settings"), F.max("total").alias("total"), F.max("processed").alias("processed"),
        F.count_distinct(F.when(is_("failed"), F.struct("path", "stage"))).alias("failed"), F.max_by("status", F.when(is_("finished"), F.col("at"))).alias("_status"),
    )
    return rows.withColumn("status", F.coalesce("_status", F.lit("running"))).drop("_status")


def resumable(runs: DataFrame, now: datetime, stale: int = STALE_SECONDS) -> DataFrame:
    """The newest run that was interrupted, failed, or is said to run and has not been heard of for a while."""
    lost = (F.col("status") == "running") & (F.coalesce("heartbeat", "started") < F.lit(now - timedelta(seconds=stale)))
    return runs.where(F.col("status").isin("interrupted", "failed") | lost).orderBy(F.col("run").desc()).limit(1)


def in_progress(runs: DataFrame, now: datetime, stale: int = STALE_SECONDS) -> DataFrame:
    """Runs that look alive; none may be resumed over them."""
    return runs.where((F.col("status") == "running") & (F.coalesce("heartbeat", "started") > F.lit(now - timedelta(seconds=stale))))


def failed_paths(events: DataFrame, scope: str | int = "last") -> DataFrame:
    """Paths that failed: of the newest run that had failures, of ``all`` runs, or of one."""
    rows = events.where("event = 'failed'")
    if scope == "last":
        rows = rows.join(F.broadcast(rows.agg(F.max("run").alias("run"))), "run", "left_semi")  # one number
    elif scope != "all":
        rows = rows.where(F.col("run") == int(scope))
    return rows.select("path").distinct()


def scanned_before(paths: DataFrame, photos: DataFrame, before: Column, key: str = "path", scanned: str = "scanned_at") -> DataFrame:
    """Paths last scanned before a date, or never."""
    return paths.join(photos.where(F.col(scanned) >= before).select(key), key, "left_anti")


def left_to_scan(paths: DataFrame, photos: DataFrame, since: Column, settings: str, key: str = "path", scanned: str = "scanned_at", version: str = "config_version") -> DataFrame:
    """What a resumed run has still to do: all but what was scanned since its start under the same settings."""
    return paths.join(photos.where((F.col(version) == settings) & (F.col(scanned) >= since)).select(key), key, "left_anti")


class Measures:
    """Measures of groups of frames (bursts, sweeps), taken again only for groups with new frames.

    ``folder`` holds generations of measures and of marks; a mark says up to when frames were seen and under which
    settings.  Appends come in the order measures, then mark, so a pass that dies is simply done again."""

    def __init__(self, spark: SparkSession, folder: str, group: str, scanned: str, measure: Callable[[DataFrame], DataFrame], settings: str):
        self.spark, self.folder, self.group, self.scanned, self.measure, self.settings = spark, folder.rstrip("/"), group, scanned, measure, settings

    def _mark(self) -> tuple[int, datetime | None]:
        """The last whole generation, and the mark, if it was made under the same settings."""
        try:
            marks = self.spark.read.schema("generation long, through timestamp, settings string").parquet(f"{self.folder}/marks")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, None
        last = marks.agg(F.max(F.struct("generation", "through", "settings")).alias("m")).first()["m"]
        return last["generation"], last["through"] if last["settings"] == self.settings else None

    def fresh(self, frames: DataFrame) -> DataFrame:
        """The groups to measure: with a frame newer than the mark, or of unknown age; all of them without a mark."""
        _, mark = self._mark()
        rows = frames.where(F.col(self.group).isNotNull())
        if mark is None:
            return rows.select(self.group).distinct()
        new = F.col(self.scanned).isNull() | (F.col(self.scanned) > F.lit(mark))
        return rows.where(new).select(self.group).distinct()

    def update(self, frames: DataFrame) -> int:
        """Measure what is fresh, append it as a generation of its own, and move the mark; the generation's number."""
        generation = self._mark()[0] + 1
        rows = frames.where(F.col(self.group).isNotNull()).join(self.fresh(frames), self.group, "left_semi")
        path = f"{self.folder}/measures/generation={generation}"
        self.measure(rows).write.mode("overwrite").parquet(path)
        through = frames.agg(F.max(self.scanned)).first()[0]
        self.spark.createDataFrame([(generation, through, self.settings)], "generation long, through timestamp, settings string").coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")
        return generation

    def generation(self, number: int) -> DataFrame:
        """What one pass measured."""
        return self.spark.read.parquet(f"{self.folder}/measures/generation={number}")

    def current(self, frames: DataFrame) -> DataFrame:
        """The newest measure of every group that still has frames, with the generation that took it."""
        whole = self._mark()[0]
        rows = self.spark.read.parquet(f"{self.folder}/measures").where(F.col("generation") <= whole)
        newest = rows.groupBy(self.group).agg(F.max("generation").alias("generation"))
        rows = rows.join(newest, [self.group, "generation"])
        return rows.join(frames.select(self.group).distinct(), self.group, "left_semi")
