"""What is kept between runs: batches after silence, scan runs, measures by generation, the text index, exports."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenfold.operators import similarity, text_index
from lumenfold.sources import runs, tables
from lumenfold.streaming import ingest, quiet

T0 = datetime(2024, 1, 1)
at = lambda s: T0 + timedelta(seconds=s)


def stream_of(spark, folder, batches, schema="path string, folder string, ts timestamp"):
    """One file for each batch, read in order, one at a time."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) == len(batches)
    return ingest.file_stream(spark, folder, schema, per_trigger=1)


def test_a_batch_comes_once_after_silence(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    quiet.use_timers(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        batches = [
            [("a1", "a", at(0)), ("a2", "a", at(5)), ("b1", "b", at(4))],
            [("a3", "a", at(20)), ("a1", "a", at(21))],  # moves a's timer; a1 is there already
            [("c1", "c", at(45))],  # b has been quiet for 30 s and more, a has not
            [("c2", "c", at(60))],  # a as well
            [("a4", "a", at(200))],  # c; and a begins anew
            [("z", "z", at(1000))],
        ]
        events = stream_of(spark, str(tmp_path / "in"), batches)
        seen = []

        def keep(df, k):
            seen.extend((k, r["key"], r["item"], r["items"], r["last"]) for r in df.collect())

        ingest.ingest(quiet.settled(events, "folder", "path", "ts", 30), str(tmp_path / "state"), keep).awaitTermination()
        got = [(key, sorted(i for _, q, i, _, _ in seen if (q, _) == (key, _))) for key in ("b",)]
        assert got == [("b", ["b1"])]
        batch = {}
        for k, key, item, n, last in seen:
            batch.setdefault((k, key), []).append((item, n, last))
        order = [(key, sorted(i for i, _, _ in rows), rows[0][1], rows[0][2]) for (k, key), rows in sorted(batch.items())]
        assert [o[:3] for o in order] == [("b", ["b1"], 1), ("a", ["a1", "a2", "a3"], 3), ("c", ["c1", "c2"], 2), ("a", ["a4"], 1)]
        assert order[1][3] == at(21)
        when = {key: k for (k, key), _ in sorted(batch.items(), reverse=True)}
        assert when["b"] < when["a"] < when["c"]  # not before its own silence
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_too_few_items_wait_for_more(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    quiet.use_timers(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        batches = [[("1", "u", at(0)), ("2", "u", at(1))], [("x", "w", at(100))], [("3", "u", at(120))], [("y", "w", at(500))], [("y2", "w", at(900))]]
        events = stream_of(spark, str(tmp_path / "in"), batches)
        seen = []
        ingest.ingest(quiet.settled(events, "folder", "path", "ts", 30, least=3), str(tmp_path / "state"), lambda df, k: seen.extend(tuple(r) for r in df.collect())).awaitTermination()
        assert sorted(r[1] for r in seen if r[0] == "u") == ["1", "2", "3"] and {r[2] for r in seen} == {3}  # w has two at its silences
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_scan_runs(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    assert log.events().count() == 0 and runs.resumable(log.runs(), at(0)).count() == 0
    one = log.start("scan", {"b": 1, "a": 2}, 10, at(0))
    log.progress(one, 4, at(10))
    fails = spark.createDataFrame([("p1", "decode", "x" * 900), ("p2", "score", "no"), ("p1", "decode", "again")], "path string, stage string, error string")
    log.failures(one, fails, at(11))
    log.finish(one, "completed", at(20))
    two = log.start("scan", {}, 5, at(100))
    log.progress(two, 3, at(130))
    row = {r["run"]: r for r in log.runs().collect()}
    assert (one, two) == (1, 2) and row[1]["status"] == "completed" and row[1]["failed"] == 2 and row[1]["processed"] == 4 and row[1]["settings"] == '{"a": 2, "b": 1}'
    assert row[2]["status"] == "running" and row[2]["heartbeat"] == at(130) and row[2]["finished"] is None
    assert runs.resumable(log.runs(), at(200)).count() == 0 and [r["run"] for r in runs.in_progress(log.runs(), at(200)).collect()] == [2]
    assert [r["run"] for r in runs.resumable(log.runs(), at(251)).collect()] == [2] and runs.in_progress(log.runs(), at(251)).count() == 0
    log.finish(two, "failed", at(300))
    three = log.start("scan", {}, 1, at(400))
    log.failures(three, fails.limit(0), at(401))
    log.finish(three, "completed", at(410))
    assert [r["run"] for r in runs.resumable(log.runs(), at(500)).collect()] == [2]
    paths = lambda scope: sorted(r["path"] for r in runs.failed_paths(log.events(), scope).collect())
    assert paths("last") == paths("all") == paths(1) == ["p1", "p2"] and paths(2) == []
    assert log.events().agg(F.max(F.length("error"))).first()[0] == 500


def test_only_fresh_groups_are_measured(spark, tmp_path):
    schema = "g long, photo long, scanned timestamp"
    first = [(1, 1, at(0)), (1, 2, at(1)), (2, 3, at(2)), (3, 4, None), (None, 5, at(3)), (4, 6, at(1))]
    read = []

    def take(rows):
        read.append(rows.count())
        return rows.groupBy("g").agg(F.count("*").alias("n"))

    kept = runs.Measures(spark, str(tmp_path / "m"), "g", "scanned", take, "v1")
    frames = spark.createDataFrame(first, schema)
    assert kept.update(frames) == 1 and read == [5]
    more = spark.createDataFrame([r for r in first if r[0] != 4] + [(2, 7, at(9)), (5, 8, at(8))], schema)  # group 4 is gone
    assert kept.update(more) == 2 and read[1] == 4  # 2 (two frames), 3 (unknown age) and 5, not 1
    assert sorted(map(tuple, kept.generation(2).collect())) == [(2, 2), (3, 1), (5, 1)]
    assert sorted((r["g"], r["n"], r["generation"]) for r in kept.current(more).collect()) == [(1, 2, 1), (2, 2, 2), (3, 1, 2), (5, 1, 2)]
    assert kept.update(more) == 3 and read[2] == 1  # 3 alone
    other = runs.Measures(spark, str(tmp_path / "m"), "g", "scanned", take, "v2")
    assert other.update(more) == 4 and read[3] == 6  # other settings: everything


def test_index_equals_a_scan_and_reads_little(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    index = text_index.TextIndex(spark, str(tmp_path / "index"), "doc_id", buckets=16)
    index.update(docs.where("doc_id % 3 > 0").withColumn("text", F.concat(F.lit("zebra "), F.col("text"))), "text")
    index.update(docs.where("doc_id % 3 > 0"), "text")
    index.update(docs.where("doc_id % 3 = 0").unionByName(spark.createDataFrame([(-1, "zebra idiot"), (-2, None)], "doc_id long, text string")), "text")
    index.update(docs.limit(0), "text", removed=spark.createDataFrame([(-1,), (-2,)], "doc_id long"))
    for terms in (["idiot", "license"], ["the"], ["zebra"], ["die", "die2", "la"]):
        got = {r["doc_id"]: round(r["score"], 9) for r in index.search(terms).collect()}
        want = {r["doc_id"]: round(r["score"], 9) for r in similarity.bm25(docs, "doc_id", "text", terms).collect()}
        assert got == want
    assert index.texts().count() == n
    plan = index.postings(["idiot"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = ", plan) and "EqualTo(term,idiot)" in plan
    held = spark.read.parquet(f"{tmp_path}/index/postings")
    of = held.where(F.col("term") == "idiot").select("bucket").distinct().collect()
    assert len(of) == 1 and held.where(F.col("bucket") == of[0][0]).count() < held.count() / 6
    index.compact()
    assert {r["doc_id"]: round(r["score"], 9) for r in index.search(["idiot"]).collect()} == {r["doc_id"]: round(r["score"], 9) for r in similarity.bm25(docs, "doc_id", "text", ["idiot"]).collect()}
    assert spark.read.parquet(f"{tmp_path}/index/postings").where("segment = 5").count() < held.count()


def test_second_export(spark):
    schema = "path string, caption string, stars int, size long, blob binary, extra int"
    source = spark.createDataFrame([("a", None, 3, 10, b"x", 1), ("b", "new", 0, 11, b"y", 1), ("c", "c", 2, 12, b"z", 1), ("n", "n", 1, 13, b"w", 1)], schema)
    viewer = spark.createDataFrame([("a", "cached", 5, 10, None), ("b", "old", None, 9, None), ("c", "c", 0, 12, b"kept"), ("gone", "g", 1, 1, None)], "path string, caption string, stars int, size long, blob binary")
    got = {r["path"]: tuple(r)[1:] for r in tables.merged_export(source, viewer, "path", ["blob"], ["caption"], ["stars"]).collect()}
    assert got == {"a": ("cached", 5, 10, None, "same"), "b": ("new", 0, 11, None, "updated"), "c": ("c", 2, 12, b"kept", "updated"), "n": ("n", 1, 13, None, "added"), "gone": ("g", 1, 1, None, "deleted")}
