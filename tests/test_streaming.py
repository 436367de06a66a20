"""Streams give what the batch form gives."""

from pyspark.sql import functions as F

from lumenfold.operators import grouping
from lumenfold.streaming import ingest


def test_sessions_equal_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    schema = events.schema.simpleString()[7:-1]
    stream = ingest.session_counts(ingest.file_stream(spark, str(tmp_path / "in"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)), "ts", ["user_id"], "60 minutes", "1 minute")
    assert schema
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("sessions").select("user_id", "n", F.unix_micros("start")).collect())
    batch = grouping.gap_sessions(events, ["user_id"], "ts", "event_id", 3600 - 1e-6).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("start"))
    assert got == sorted((r["user_id"], r["n"], r["start"]) for r in batch.collect())


def test_ingest_runs_batches(spark, tmp_path):
    spark.range(10).withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.once_each(ingest.file_stream(spark, str(tmp_path / "in"), "id long, ts timestamp"), "id", "ts", "1 hour")
    ingest.ingest(stream, str(tmp_path / "state"), lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 10
