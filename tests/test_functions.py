"""Known answers of expressions and algorithms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import exprs
from lumenfold.operators import culling, filters, grouping, learning, scoring, stats, windows
from lumenfold.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exposure_value(spark):
    lit = F.lit
    assert value(spark, exprs.exposure_value(lit(16.0), lit("0.01"), lit(100))) == pytest.approx(14.64, abs=0.01)
    assert value(spark, exprs.exposure_value(lit(2.5), lit("0.0015625"), lit(10000))) == pytest.approx(5.32, abs=0.01)
    for bad in ((lit(None), lit("1"), lit(100)), (lit(2.0), lit("0"), lit(100)), (lit(2.0), lit("x"), lit(100))):
        assert value(spark, exprs.exposure_value(*bad)) is None


def test_capture_times_and_shutter(spark):
    assert value(spark, exprs.capture_time(F.lit("2024:05:06 07:08:09"))) == dt.datetime(2024, 5, 6, 7, 8, 9)
    assert value(spark, exprs.capture_time(F.lit("2024-05-06"))) == dt.datetime(2024, 5, 6)
    assert value(spark, exprs.capture_time(F.lit("junk"))) is None
    assert value(spark, exprs.shutter_seconds(F.lit("1/250"))) == pytest.approx(0.004)
    assert value(spark, exprs.shutter_seconds(F.lit("1/0"))) is None
    assert value(spark, exprs.exif_to_iso(F.lit("2024:05:06 07:08:09"))) == "2024-05-06 07:08:09"
    assert value(spark, exprs.season_year(F.lit("2023-12-05").cast("date"))) == 2024


def test_hue_and_tags(spark):
    assert [value(spark, exprs.hue_bucket(F.lit(float(h)))) for h in (350, 10, 15, 300)] == ["red", "red", "orange", "magenta"]
    assert value(spark, exprs.tags(F.lit('["a", " b "]'))) == ["a", "b"]
    assert value(spark, exprs.tags(F.lit("x, y,,"))) == ["x", "y"]


def test_hamming_and_duplicate_gate(spark):
    from lumenfold.operators.similarity import duplicate_gate

    a = F.lit(0).cast("long")
    gate = lambda bits, cos: value(spark, duplicate_gate(a, F.lit((1 << bits) - 1).cast("long"), F.lit(cos).cast("double")))
    assert [gate(3, 0.0), gate(8, 1.0), gate(17, 1.0), gate(3, None), gate(8, None)] == [False, True, False, True, False]
    assert value(spark, exprs.hamming(F.lit(None).cast("long"), a)) == exprs.MISSING_HASH_DISTANCE


def test_nearest_rank(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    assert tuple(stats.nearest_rank(df, ["g"], "v", [50, 95]).first()) == (1, 51.0, 96.0)


@pytest.mark.parametrize(("evs", "yes"), [([8.29, 10.29, 12.29], True), ([12.29, 11.29, 10.29], True), ([12.29, 10.34, 8.38], True), ([8.0, 10.0], False), ([8.0, 10.0, 9.0], False)])
def test_brackets(spark, evs, yes):
    rows = [("c", dt.datetime(2024, 1, 1, 0, 0, k), k, e) for k, e in enumerate(evs)]
    df = spark.createDataFrame(rows, "camera string, ts timestamp, id int, ev double")
    assert (grouping.bracket_runs(df, ["camera"], "ts", "id", "ev").count() == 1) is yes


def test_bracket_base_of_two_is_the_first(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, 0), 1, 15.64), (1, dt.datetime(2024, 1, 1, 0, 0, 1), 2, 12.64)]
    df = spark.createDataFrame(rows, "g int, ts timestamp, id int, ev double")
    assert {r["base_ev"] for r in grouping.bracket_base(df, "g", "ts", "id", "ev").collect()} == {15.64}


def test_bursts_join_any_member_across_midnight(spark):
    t = dt.datetime(2024, 1, 1, 23, 59, 50)
    rows = [(k, t + dt.timedelta(seconds=8 * k), 0 if k != 2 else -1) for k in range(5)] + [(9, t + dt.timedelta(hours=3), 0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, phash long")
    got = {r["id"]: r["burst"] for r in grouping.burst_runs(df, "ts", "id", "phash").collect()}
    assert got == {0: 0, 1: 0, 3: 3, 4: 3}


def test_viterbi_smooths_one_odd_frame():
    p = np.full((7, 3), 0.05)
    p[:, 1] = 0.9
    p[3] = [0.9, 0.05, 0.05]
    path, post = grouping.viterbi(np.log(p), np.log(grouping.transitions(3)))
    assert path.tolist() == [1] * 7 and np.allclose(post.sum(1), 1)


def test_scene_split_at_largest_gap():
    assert [p.tolist() for p in grouping.split_scene(np.asarray([0, 1, 2, 50, 51]), 3)] == [[0, 1, 2], [3, 4]]


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(1, 2), (50, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in grouping.components(edges).collect()}
    assert {got[k] for k in range(10, 41)} == {10} and got[2] == 1 and got[50] == 3


def test_journeys(spark):
    base = dt.datetime(2024, 1, 1)
    home = [("u", base + dt.timedelta(hours=k), k, 48.8, 2.3) for k in range(20)]
    trip = [("u", base + dt.timedelta(days=5, hours=k), 100 + k, 40.4, -3.7) for k in range(9)]
    df = spark.createDataFrame(home + trip, "user string, ts timestamp, id int, lat double, lon double")
    assert [r["n"] for r in grouping.journeys(df, ["user"], "ts", "id", "lat", "lon").collect()] == [9]


def test_rules_and_weights(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, None, "x")], "id int, score double, kind string")
    r = {"high": scoring.rule({"min_score": 4, "kind": "x"})}
    assert [x["c"] for x in df.orderBy("id").select(scoring.category(r).alias("c")).collect()] == ["high", "default"]
    assert scoring.integer_weights({"a": 1, "b": 1, "c": 1}) == {"a": 33, "b": 33, "c": 34}


def test_pair_learning_finds_the_feature():
    rng = np.random.default_rng(0)
    d = rng.normal(size=(300, 4))
    y = (d[:, 0] > 0).astype(float)
    assert learning.bradley_terry(d, y).argmax() == 0
    assert learning.pair_logistic(d, y).argmax() == 0
    assert learning.pair_accuracy(np.asarray([[4.0], [-3.0], [0.0]]), np.asarray([1, 1, 0.5]), np.ones(1)) == pytest.approx(2 / 3)
    w = learning.simplex_box(np.asarray([5.0, 0.1, 0.0]))
    assert w.sum() == pytest.approx(1) and w.max() <= 0.6 + 1e-9


def test_mmr_prefers_different_rows(spark):
    rows = [("g", 1, [1.0, 0.0], 9.0), ("g", 2, [1.0, 0.01], 8.9), ("g", 3, [0.0, 1.0], 8.0), ("g", 4, None, 9.9)]
    df = spark.createDataFrame(rows, "g string, id int, v array<double>, q double")
    assert [r["id"] for r in culling.mmr(df, "g", "id", "v", "q", 4, 0.5).orderBy("rank").collect()] == [1, 3, 2, 4]


def test_upsert_keeps_user_columns(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 4)], "path string, score int, stars int")
    new = spark.createDataFrame([("b", 7), ("c", 8)], "path string, score int")
    assert sorted(map(tuple, tables.upsert(old, new, "path", ["score"]).select("path", "score", "stars").collect())) == [("a", 1, 5), ("b", 7, 4), ("c", 8, None)]


def test_sidecars_round_trip(spark):
    df = spark.createDataFrame([("a", 9.5, ["x", "y"])], "path string, score double, tags array<string>")
    back = tables.read_sidecars(tables.sidecars(df, "path", "score", "tags")).first()
    assert (back["rating"], back["tags"]) == (5, ["x", "y"])


def test_visibility(spark):
    df = spark.createDataFrame([("/a/1",), ("/b/1",)], "path string")
    seen = lambda p: df.where(filters.visible(F.col("path"), p)).count()
    assert [seen(None), seen([]), seen(["/a/"])] == [2, 0, 1]


def test_average_ranks(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 7)], "g int, v int")
    assert sorted(r["r"] for r in windows.average_ranks(df, "v", ["g"], "r").collect()) == [1.5, 1.5, 3.0]
