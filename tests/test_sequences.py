"""Ordered grouping that SQL does not express, against brute force over whole tables."""

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators import culling, grouping
from lumenfold.plans.registry import QUERIES


def test_burst_runs_equal_a_plain_scan(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet").withColumn("phash", (F.col("user_id") % 20) * 6148914691236517)
    got = {r["event_id"]: (r["burst"], r["n"]) for r in QUERIES["burst_runs"](spark, data).collect()}
    frames = sorted((r["ts"].timestamp(), r["event_id"], r["phash"]) for r in rows.select("ts", "event_id", "phash").collect())
    runs, members = [], []
    for t, key, h in frames:
        near = any((t - u <= 5.0 and bin((h ^ g) & (2**64 - 1)).count("1") <= 32) or (t - u <= 600.0 and bin((h ^ g) & (2**64 - 1)).count("1") <= 16) for u, _, g in members)
        if not near:
            members = []
            runs.append(members)
        members.append((t, key, h))
    want = {k: (min(m[1] for m in run), len(run)) for run in runs if len(run) > 1 for _, k, _ in run}
    assert got == want


def test_moment_boundaries_need_lasting_changes():
    assert grouping.moment_boundaries(list("aaabaaacccc"), 3) == [0, 4, 7]  # back to a for three frames
    assert grouping.moment_boundaries(list("aabbb"), 3) == [0]
    assert grouping.moment_boundaries(["a"] * 3 + [None] * 3 + ["b"] * 3, 3) == [0, 6]
    assert grouping.moment_boundaries([], 3) == [0]


def test_scenes_cover_large_groups_once(spark, data):
    got = QUERIES["moment_scenes"](spark, data).collect()
    assert got and all(2 <= r["n"] <= 60 and r["start"] <= r["end"] and (r["share"] is None or 0 < r["share"] <= 1) for r in got)
    rows = [(0, k, 60.0 * k + (3600 if k > 40 else 0), float(k % 7), "a" if k < 70 else "b", 0.9) for k in range(150)]
    df = spark.createDataFrame(rows, "p int, id long, s double, score double, moment string, c double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    found = sorted((tuple(r) for r in grouping.built_scenes(df, ["p"], "ts", "id", "score", "moment", "c").collect()), key=lambda r: r[2])
    assert [r[1] for r in found] == [41, 29, 40, 40] and [r[5] for r in found] == ["a", "a", "b", "b"]
    assert found[0][4] == 6 and sum(r[1] for r in found) == 150


def test_smoothing_of_weight_zero_is_argmax(spark):
    p = np.random.default_rng(1).dirichlet([1] * 4, 60)
    rows = [(0, k, float(k * 30 + (30_000 if k > 30 else 0)), [float(x) for x in p[k]] if k % 9 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, s double, chance array<double>").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("long")))
    labels = ["a", "b", "c", "d"]
    plain = {r["id"]: r["moment"] for r in grouping.smooth_moments(df, ["g"], "ts", "id", "chance", labels, weight=0.0).collect()}
    assert plain == {k: labels[int(p[k].argmax())] for k in range(60) if k % 9}
    smooth = grouping.smooth_moments(df, ["g"], "ts", "id", "chance", labels, weight=1.0).collect()
    assert len(smooth) == len(plain) and all(0 < r["confidence"] <= 1 for r in smooth)
    assert sum(plain[r["id"]] != r["moment"] for r in smooth) > 0


def test_diverse_selection_equals_greedy_steps(spark):
    r = np.random.default_rng(2)
    rows = [(0, k, [float(x) for x in r.standard_normal(6)], float(r.random())) for k in range(40)] + [(0, 40, None, 0.9), (0, 41, [1.0], 0.95)]
    got = [x["id"] for x in culling.mmr(spark.createDataFrame(rows, "g int, id long, v array<double>, q double"), "g", "id", "v", "q", 12).orderBy("rank").collect()]
    v = {k: np.asarray(x) / np.linalg.norm(x) for _, k, x, _ in rows if x and len(x) == 6}
    q = {k: s for _, k, _, s in rows}
    lo, hi = min(q.values()), max(q.values())
    chosen = []
    while len(chosen) < 12:
        value = {k: 0.5 * (q[k] - lo) / (hi - lo) - 0.5 * max([float(v[k] @ v[c]) for c in chosen] + [0.0]) for k in v if k not in chosen}
        chosen.append(max(value, key=lambda k: (value[k], q[k])))
    assert got == chosen


def test_near_pairs_stay_inside_blocks(spark):
    from lumenfold.operators import similarity

    r = np.random.default_rng(3)
    x = r.standard_normal((300, 12))
    x[100:150] = x[:50] + 0.1 * r.standard_normal((50, 12))
    rows = [(k, "hot" if k % 10 else f"g{k % 3}", [float(y) for y in x[k]]) for k in range(300)] + [(900, "hot", None), (901, "hot", [0.0] * 12), (902, "hot", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    for group in (None, "g"):
        got = {(p["a"], p["b"]) for p in similarity.pairs_above(df, "id", "v", 0.8, group, block=40).collect()}
        assert got == {(a, b) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= 0.8 and (group is None or rows[a][1] == rows[b][1])}
