"""Themed collections of photos."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import exprs
from lumenfold.operators.windows import group_top_k
from lumenfold.sources.tables import checkpointed

# --- Fixed values ---------------------------------------------------------------------------------------------
VIVID, MUTED, MONO_SHARE = 0.5, 0.25, 0.5
SEED_DAYS, SEED_KM = 7, 10.0
STORY_COSINE, STORY_LEAST = 0.75, 8
# -------------------------------------------------------------------------------------------------------------


def best_of(df: DataFrame, groups: list[Column | str], score: Column, key: str, k: int, least: int) -> DataFrame:
    """The best k rows of each group of at least ``least``: sizes come from a partial aggregate and ranks from a window
    that keeps k rows of a group before it shuffles them."""
    names = [g if isinstance(g, str) else f"_g{i}" for i, g in enumerate(groups)]
    rows = df.select("*", *(g.alias(n) for g, n in zip(groups, names, strict=True) if not isinstance(g, str))).withColumn("_s", F.round(score, 6))
    sizes = rows.groupBy(*names).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    rank = F.row_number().over(Window.partitionBy(*names).orderBy(F.col("_s").desc_nulls_last(), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).join(sizes, names).drop("_s")


def faces_of(faces: DataFrame, photos: DataFrame, key: str, k: int = 40, least: int = 10) -> DataFrame:
    """Each person's best photos by quality of photo and face, for people with enough of them."""
    rows = faces.select("person", key).distinct().join(photos.select(key, "aggregate", "face_quality"), key)
    score = 0.6 * F.coalesce("aggregate", F.lit(0.0)) + 0.4 * F.coalesce("face_quality", F.lit(0.0))
    return best_of(rows, ["person"], score, key, k, least).select("person", key, "rank", "group_size")


def without_overlap(members: DataFrame, collection: str, key: str, order: str, most: float = 0.5) -> DataFrame:
    """Collections of which no more than a share stands in an earlier one (by ``order``, then name)."""
    sizes = members.groupBy(collection).agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    a = members.select(F.col(collection).alias("_a"), key)
    b = members.select(F.col(collection).alias("_b"), key)
    ahead = sizes.select(F.col(collection).alias("_b"), F.col("_o").alias("_ob"))
    both = a.join(b, key).where("_a <> _b").groupBy("_a", "_b").agg(F.count("*").alias("_shared"))
    crowded = both.join(sizes.withColumnRenamed(collection, "_a"), "_a").join(ahead, "_b")
    crowded = crowded.where(((F.col("_ob") < F.col("_o")) | ((F.col("_ob") == F.col("_o")) & (F.col("_b") < F.col("_a")))) & (F.col("_shared") > most * F.col("_n")))
    return members.join(crowded.select(F.col("_a").alias(collection)).distinct(), collection, "left_anti")


def seasonal(photos: DataFrame, key: str, k: int = 40, least: int = 10) -> DataFrame:
    """The finest photos of each season; a winter counts to the year in which it ends."""
    rows = photos.select(key, "aesthetic", exprs.season("taken").alias("season"), exprs.season_year("taken").alias("year"))
    return best_of(rows, ["year", "season"], F.col("aesthetic"), key, k, least).select("year", "season", key, "rank")


def favourites(photos: DataFrame, key: str, period: Column, k: int, least: int) -> DataFrame:
    rows = photos.where(F.coalesce(F.col("favourite"), F.lit(0)) == 1).withColumn("period", period.cast("string"))
    return best_of(rows, ["period"], F.col("aggregate"), key, k, least).select("period", key, "rank")


def starred(photos: DataFrame, key: str, stars: int, k: int) -> DataFrame:
    """Photos of at least so many stars, best first, for each number of stars."""
    return best_of(photos.where(F.col("stars") >= stars), ["stars"], F.col("aggregate"), key, k, 1).select("stars", key, "rank")


def palette(photos: DataFrame, period: Column, least: int = 10) -> DataFrame:
    """A word for the colours of each period that has a mood of its own."""
    a = photos.groupBy(period.alias("period")).agg(F.count("*").alias("n"), F.round(F.avg("saturation"), 6).alias("saturation"), F.round(F.avg(F.coalesce(F.col("mono"), F.lit(0))), 6).alias("mono")).where(F.col("n") >= least)
    return a.select("period", "n", F.when(F.col("mono") > MONO_SHARE, "monochrome").when(F.col("saturation") > VIVID, "vibrant").when(F.col("saturation") < MUTED, "muted").alias("mood")).where("mood is not null")


def near_places(photos: DataFrame, places: DataFrame, key: str, km: float) -> DataFrame:
    """Photos within ``km`` of given places (place, lat0, lon0): cells of a grid at least that wide in latitude bring
    candidates together, the distance decides."""
    cell = km / 111.0
    p = photos.where("lat is not null and lon is not null").withColumn("_c", F.floor(F.col("lat") / cell))
    q = places.withColumn("_c", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("lat0") / cell) + d)))
    distance = exprs.haversine_km("lat0", "lon0", "lat", "lon")
    return p.join(q, "_c").where(distance <= km).select("place", key, F.round(distance, 3).alias("km"))


def near_times(photos: DataFrame, seeds: DataFrame, days: int = SEED_DAYS) -> DataFrame:
    """(seed, n, s): number and summed aggregate of the other photos within some days of each seed (seed, seed_taken, own).

    Sums up to both ends of a seed's span are subtracted, so photos are not met by every seed: photos of one time are
    added up, they and the ends are dealt by range, and what stands in earlier ranges is added."""
    span, parts = days * 86_400_000_000, int(photos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = photos.select(micros("taken").alias("_t"), "aggregate").where("_t is not null").groupBy("_t").agg(F.count("*").alias("n"), F.count("aggregate").alias("m"), F.coalesce(F.sum("aggregate"), F.lit(0.0)).cast("double").alias("s"))
    held = held.withColumn("_o", F.lit(1))
    end = F.explode(F.array(F.struct((F.col("_at") - span).alias("_t"), F.lit(0).alias("_o")), F.struct((F.col("_at") + span).alias("_t"), F.lit(2).alias("_o"))))
    ends = seeds.withColumn("_at", micros("seed_taken")).where("_at is not null").select("seed", F.col("own").cast("double").alias("own"), end.alias("_e")).select("seed", "own", "_e.*")
    points = held.unionByName(ends.select("*", *(F.lit(0).cast(t).alias(c) for c, t in (("n", "long"), ("m", "long"), ("s", "double")))), allowMissingColumns=True)
    dealt = checkpointed(points.repartitionByRange(parts, "_t", "_o").withColumn("_part", F.spark_partition_id()))  # bounds are sampled
    own, ranges = Window.partitionBy("_part").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_part")
    before = dealt.groupBy("_part").agg(*(F.sum(c).alias(c) for c in "nms")).select("_part", *((F.sum(c).over(ranges) - F.col(c)).alias(f"_{c}") for c in "nms"))  # a row a range
    upto = dealt.select("seed", "own", "_o", "_part", *(F.sum(c).over(own).alias(c) for c in "nms")).where(F.col("_o") != 1).join(before, "_part")
    inside = upto.groupBy("seed").agg(F.max("own").alias("own"), *(F.sum((F.col(c) + F.col(f"_{c}")) * (F.col("_o") - 1)).alias(c) for c in "nms"))
    m = F.col("m") - F.col("own").isNotNull().cast("int")
    return inside.select("seed", (F.col("n") - 1).alias("n"), F.when(m > 0, F.col("s") - F.coalesce("own", F.lit(0.0))).alias("s"))


def discovery(photos: DataFrame, seeds: DataFrame, key: str, axes: Mapping[str, str], days: int = SEED_DAYS, least: int = 3) -> DataFrame:
    """For each seed, one of the photos, the axis along which its company is largest and best: number of photos times mean
    aggregate.  Axes are equal columns, and nearness in time; the company of a value is counted once, not once for each
    seed.  Keys are unique."""
    near = near_times(photos, seeds.select(F.col(key).alias("seed"), F.col("taken").alias("seed_taken"), F.col("aggregate").alias("own")), days)
    every = near.select("seed", F.lit("time").alias("axis"), "n", "s")
    for axis, c in sorted(axes.items()):
        about = photos.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("_n"), F.sum("aggregate").alias("_s"))
        own = seeds.where(F.col(c).isNotNull()).select(F.col(key).alias("seed"), c, F.col("aggregate").alias("_own")).join(about, c)
        every = every.unionByName(own.select("seed", F.lit(axis).alias("axis"), (F.col("_n") - 1).alias("n"), (F.col("_s") - F.coalesce("_own", F.lit(0.0))).alias("s")))
    # number times mean is the sum
    return every.where(F.col("n") >= least).groupBy("seed").agg(F.min_by(F.struct("axis", "n", F.round("s", 3).alias("score")), F.struct(-F.round("s", 3), F.col("axis"))).alias("b")).select("seed", "b.axis", "b.n", "b.score")


def rotated_cover(members: DataFrame, collection: str, key: str, score: str, bucket: int, n: int = 5) -> DataFrame:
    """A cover among each collection's best n, which changes with the time bucket that the caller passes."""
    top = group_top_k(members, [collection], [F.col(score).desc_nulls_last(), F.col(key)], n)
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(collection).cast("string"), F.lit(str(bucket)))), 1, 7), 16, 10).cast("long")
    return top.where(F.col("rank") - 1 == turn % F.least(F.col("group_size"), F.lit(n))).select(collection, key)


def dimensions() -> dict[str, Column]:
    """Values by which photos are gathered into collections."""
    return {
        "camera": F.col("camera"),
        "lens": F.col("lens"),
        "category": F.col("category"),
        "moment": F.col("moment"),
        "year": F.year("taken"),
        "month": F.date_format("taken", "yyyy-MM"),
        "weekday": exprs.sunday_weekday("taken"),
        "hour": F.hour("taken"),
        "season": exprs.season("taken"),
        "stars": F.when(F.col("stars") > 0, F.col("stars")),
        "mono": F.when(F.col("mono") == 1, "mono"),
        "faces": F.when(F.col("faces") == 0, "none").when(F.col("faces") == 1, "one").when(F.col("faces") > 1, "group"),
        "focal": F.when(F.col("focal") < 35, "wide").when(F.col("focal") < 85, "normal").otherwise("tele"),
        "aperture": F.when(F.col("f_stop") < 3, "open").when(F.col("f_stop") < 9, "middle").otherwise("closed"),
        "iso": F.when(F.col("iso") <= 400, "low").when(F.col("iso") <= 1600, "middle").otherwise("high"),
        "tier": exprs.quality_tier("aggregate"),
    }


def crossed(photos: DataFrame, first: str, second: str, key: str, k: int, least: int, groups: int = 20) -> DataFrame:
    """Collections of two dimensions at once: the largest pairs of values, each with its best rows."""
    d = dimensions()
    rows = photos.select(key, "aggregate", d[first].cast("string").alias("x"), d[second].cast("string").alias("y")).where("x is not null and y is not null")
    top = rows.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "x", "y").limit(groups)
    return best_of(rows.join(F.broadcast(top.select("x", "y")), ["x", "y"], "left_semi"), ["x", "y"], F.col("aggregate"), key, k, least).select("x", "y", key, "rank")


def colour_stories(photos: DataFrame, key: str, vector: str, tags: str, score: str, alike: float = STORY_COSINE, least: int = STORY_LEAST, stories: int = 5, k: int = 40) -> DataFrame:
    """The largest groups of photos that look alike, each with its best photos and its two most frequent tags as name.

    Groups are components of pairs within ``alike``, over all photos; rows (story, name, n, key, rank)."""
    from lumenfold.operators.grouping import components
    from lumenfold.operators.similarity import linked_above

    member = components(linked_above(photos, key, vector, alike)).select(F.col("node").alias(key), F.col("component").alias("story"))
    top = member.groupBy("story").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "story").limit(stories)
    rows = member.join(F.broadcast(top), "story").join(photos.select(key, tags, score), key)  # a handful of stories
    counts = rows.select("story", F.explode(tags).alias("tag")).groupBy("story", "tag").agg(F.count("*").alias("t"))
    first = group_top_k(counts, ["story"], [F.col("t").desc(), F.col("tag")], 2)
    name = first.groupBy("story").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: F.initcap(x["tag"])), " & ").alias("name"))
    best = group_top_k(rows.select("story", "n", key, score), ["story"], [F.col(score).desc_nulls_last(), F.col(key)], k)
    return best.join(name, "story", "left").select("story", F.coalesce("name", F.lit("Visual Story")).alias("name"), "n", key, "rank")
