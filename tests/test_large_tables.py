"""Queries over keys and rows as larger tables have them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.plans.registry import QUERIES


@pytest.fixture(scope="module")
def twins(spark, tmp_path_factory):
    """Vectors with keys on both sides of where a product of 64 bits overflows, each third like the one before."""
    r = np.random.default_rng(5)
    keys = [*range(60), *range(4_480, 4_540), *range(600_000, 600_060), 10**12]
    x = r.standard_normal((len(keys), 16))
    for i, k in enumerate(keys):
        if i and k % 3:
            x[i] = x[i - 1] + 0.01 * r.standard_normal(16)
    folder = str(tmp_path_factory.mktemp("twins"))
    rows = [(k, [float(y) for y in v], k % 5) for k, v in zip(keys, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    h = {k: (k // 3 * 6148914691236517 + (1985 if k % 3 == 2 else k % 3)) % 2**64 for k in keys}
    u = {k: v / np.linalg.norm(v) for k, v in zip(keys, x, strict=True)}
    bits = {(a, b): (h[a] ^ h[b]).bit_count() for a in keys for b in keys if a < b}
    edges = {(a, b, n) for (a, b), n in bits.items() if n <= 12 and (float(u[a] @ u[b]) >= 0.9 if a % 7 and b % 7 else n <= 6)}
    return folder, keys, edges


def test_hashes_of_large_keys_wrap(spark, twins):
    folder, _, edges = twins
    assert {tuple(r) for r in QUERIES["duplicate_edges"](spark, folder).collect()} == edges
    assert any(a > 4_500 for a, _, _ in edges)


def test_groups_of_large_keys(spark, twins):
    folder, keys, edges = twins
    root = {k: k for k in keys}
    for _ in keys:  # labels fall until they rest
        for a, b, _ in edges:
            root[a] = root[b] = min(root[a], root[b])
    paired = {k for a, b, _ in edges for k in (a, b)}
    roots = sorted({root[k] for k in paired})
    want = {(k, 1 + roots.index(root[k]), sum(root[x] == root[k] for x in paired)) for k in paired}
    got = QUERIES["near_duplicate_groups"](spark, folder).select("vec_id", "number", "n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and max(k for k, _, _ in want) > 4_500


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((240, 8))
    x[100:140] = x[:40] + 0.1 * r.standard_normal((40, 8))
    rows = [(3 * k, k % 4, [float(y) for y in x[k]]) for k in range(240)] + [(1, 1, None), (2, None, [1.0] * 8), (4, 1, [float("nan")] * 8)]
    u = np.vstack([x, [[1.0] * 8]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    keys, labels = [*range(0, 720, 3), 2], [*(k % 4 for k in range(240)), None]
    s = u @ u.T
    pairs = {(min(keys[i], keys[j]), max(keys[i], keys[j])): (s[i, j], labels[i], labels[j]) for i in range(241) for j in range(i) if s[i, j] >= 0.8}
    return spark.createDataFrame(rows, "id long, label int, v array<double>"), pairs


def test_blocks_meet_without_copies(vectors):
    """Vectors are not copied once for every block that they meet: no row is multiplied before tiles are compared."""
    from lumenfold.operators import similarity

    df, pairs = vectors
    found = similarity.pairs_above(df, "id", "v", 0.8, block=20)
    assert {(r["a"], r["b"]) for r in found.collect()} == set(pairs)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def roots_of(pairs):
    root = {k: k for p in pairs for k in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_links_join_what_pairs_join(vectors):
    """A task hands on a row for each of its rows at most, and no pairs."""
    from lumenfold.operators import grouping, similarity

    df, pairs = vectors
    for rows, block in ((df, 20), (df.coalesce(1), 2048)):
        links = similarity.linked_above(rows, "id", "v", 0.8, block=block)
        assert {r["node"]: r["component"] for r in grouping.components(links).collect()} == roots_of(pairs)
        total = links.selectExpr("sum(n)", "min(least)", "max(most)", "sum(total)").first()
        scores = [x for x, _, _ in pairs.values()]
        assert total[0] == len(pairs) and np.allclose(total[1:], [min(scores), max(scores), sum(scores)])
    assert links.select("a").distinct().count() == links.count()  # of one task


def test_merge_groups_count_edges_where_they_are_found(vectors):
    from lumenfold.operators import grouping, similarity

    df, pairs = vectors
    root = roots_of(pairs)
    found = similarity.merge_groups(similarity.linked_above(df, "id", "v", 0.8, block=20), grouping.components).collect()
    for r in found:
        scores = [s for (a, _), (s, _, _) in pairs.items() if root[a] == r["component"]]
        assert (r["members"], r["edges"]) == (sum(c == r["component"] for c in root.values()), len(scores))
        assert np.allclose([r["least"], r["most"], r["mean"]], [min(scores), max(scores), np.mean(scores)], atol=1e-6)
    assert {r["component"] for r in found} == set(root.values())


def test_pairs_of_different_labels(vectors):
    """As in the SQL, a missing label is neither the same nor different."""
    from lumenfold.operators import similarity

    df, pairs = vectors
    found = similarity.pairs_above(df, "id", "v", 0.8, block=20, apart="label").collect()
    assert {(r["a"], r["b"]) for r in found} == {p for p, (_, x, y) in pairs.items() if x is not None and y is not None and x != y}


def test_turned_down_in_either_order(spark):
    from lumenfold.operators import similarity

    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    no = spark.createDataFrame([(2, 1), (3, 2), (2, 3)], "a long, b long")
    assert [tuple(r) for r in similarity.without_rejected(pairs, no).collect()] == [(1, 3)]


def test_bursts_across_many_buckets(spark):
    """Runs that end in, before and long before the window of a bucket, with people and missing hashes."""
    import datetime as dt

    from lumenfold.operators import grouping

    r = np.random.default_rng(4)
    for gap, values in ((20.0, 6), (90.0, 40), (3.0, 400)):
        t = np.round(np.cumsum(r.exponential(gap, 900)), 3)
        t[200:220] = t[200]
        h = r.integers(0, 2**62, values)[r.integers(0, values, 900)]
        rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=float(t[k])), None if k % 50 == 3 else int(h[k]), None if k % 7 == 0 else k % 3) for k in range(900)]
        df = spark.createDataFrame(rows, "id long, ts timestamp, h long, p int")
        for person in (None, "p"):
            members, want = [], {}
            for k in range(900):
                def near(i):
                    far = 999 if rows[i][2] is None or rows[k][2] is None else (rows[i][2] ^ rows[k][2]).bit_count()
                    d = (rows[k][1] - rows[i][1]).total_seconds()
                    same = person is None or None in (rows[i][3], rows[k][3]) or rows[i][3] == rows[k][3]
                    return d <= 5 and same and far <= 44 or d <= 60 and far <= 22
                members = [*members, k] if any(map(near, members)) else [k]
                want[k] = members[0]
            sizes = {s: [*want.values()].count(s) for s in set(want.values())}
            got = {x["id"]: (x["burst"], x["n"]) for x in grouping.burst_runs(df, "ts", "id", "h", person, 60.0, 5.0, 22).collect()}
            assert got == {k: (s, sizes[s]) for k, s in want.items() if sizes[s] > 1}


def test_one_long_burst_is_not_one_group(spark):
    """60,000 frames in one run took the square of their number, in one task."""
    import time

    from lumenfold.operators import grouping

    df = spark.range(60_000).select("id", F.timestamp_millis(F.col("id") * 500).alias("ts"), F.lit(7).cast("long").alias("h"))
    began = time.time()
    got = grouping.burst_runs(df, "ts", "id", "h", None, 600.0)
    assert got.groupBy("burst", "n").count().collect() == [(0, 60_000, 60_000)] and time.time() - began < 60


def test_company_in_time_without_meeting_it(spark):
    """Photos at the very ends of a seed's day count, missing values do not; no photo is copied for a seed."""
    import datetime as dt

    from lumenfold.operators import capsules

    r = np.random.default_rng(6)
    t0, day = dt.datetime(2024, 1, 1), 86_400
    at = [*(int(x) for x in r.integers(0, 12 * day, 150)), 3 * day, 4 * day, 2 * day, 4 * day + 1, None]
    rows = [(k, None if x is None else t0 + dt.timedelta(seconds=x), None if k % 9 == 2 else float(k % 10)) for k, x in enumerate(at)]
    photos = spark.createDataFrame(rows, "photo long, taken timestamp, aggregate double")
    seeds = [x for x in rows if x[0] % 5 == 0 or x[0] > 149]
    found = capsules.near_times(photos, spark.createDataFrame(seeds, "seed long, seed_taken timestamp, own double"), 1)
    want = {}
    for seed, taken, _ in seeds:
        if taken is not None:
            mine = [a for k, u, a in rows if u is not None and k != seed and abs((u - taken).total_seconds()) <= day]
            told = [a for a in mine if a is not None]
            want[seed] = (len(mine), round(sum(told), 6) if told else None)
    assert {x["seed"]: (x["n"], None if x["s"] is None else round(x["s"], 6)) for x in found.collect()} == want


def test_long_segments_are_smoothed_in_batches(spark):
    """A segment of many batches comes out as from one pass, with no more than a batch in hand."""
    from lumenfold.operators import grouping

    n, labels = 5_000, ["a", "b", "c"]
    p = np.random.default_rng(7).dirichlet([0.7] * 3, n)
    rows = [("x" if k % 5 else None, k, k * 20 + 40_000 * (k > 3_000), [float(y) for y in p[k]]) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, s long, chance array<double>").withColumn("ts", F.timestamp_seconds("s"))
    step = 0.5 * np.log(grouping.transitions(3) + 1e-9)
    want = {}
    for part in ([k for k in range(n) if bool(k % 5) == some and (k > 3_000) == late] for some in (True, False) for late in (True, False)):
        path, post = grouping.viterbi(np.log(p[part] + 1e-9), step)
        want |= {k: (labels[x], post[i, x]) for i, (k, x) in enumerate(zip(part, path, strict=True))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        found = grouping.smooth_moments(df, ["g"], "ts", "id", "chance", labels)
        got = {r["id"]: (r["moment"], r["confidence"]) for r in found.collect()}
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: m for k, (m, _) in got.items()} == {k: m for k, (m, _) in want.items()}
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 1e-9


def test_forests_of_tasks_are_no_larger_than_their_rows(spark):
    """Tiles' forests are thinned in the task: with 15 blocks each row had an edge for every block before."""
    from lumenfold.operators import density
    from lumenfold.operators.tiles import packed_blocks

    r = np.random.default_rng(9)
    x = r.standard_normal((300, 5))
    df = spark.createDataFrame([(k, -1, [float(y) for y in v]) for k, v in enumerate(x)], "id long, core long, v array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        blocks = packed_blocks(df.withColumn("core", F.lit(0)), "id", "v", 20, number="core")
        edges = density.tile_forests(blocks, "<f8", density.EVERYTHING).collect()
        near = {r["_k"]: r["core"] for r in density.core_distances(blocks, "<f8", 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    d = density.distances(*(x / np.linalg.norm(x, axis=1, keepdims=True),) * 2)
    assert len(edges) <= 4 * 299  # two partitions a side, four tasks at most
    np.fill_diagonal(d, np.inf)
    assert all(np.isclose(near[k], np.sort(d[k])[2]) for k in range(300))
    weights = np.sort(d[np.isfinite(d)])
    for cut in (weights[len(weights) // 200], weights[len(weights) // 50]):  # the same rows are joined at every distance
        root = list(range(300))
        want = list(range(300))
        for _ in range(300):
            for e in edges:
                if e["w"] <= cut:
                    root[e["a"]] = root[e["b"]] = min(root[e["a"]], root[e["b"]])
            new = [min(want[k], *(want[j] for j in np.flatnonzero(d[k] <= cut)), want[k]) for k in range(300)]
            if new == want:
                break
            want = new
        assert root == want
