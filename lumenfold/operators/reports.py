"""Reports over the library: gear, settings, categories, rules, comparisons, labels, albums and stored counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import exprs

# --- Fixed values: settings buckets (bound, label) and score bands --------------------------------------------
ISO_BUCKETS = ((100, "100"), (200, "200"), (400, "400"), (800, "800"), (1600, "1600"), (3200, "3200"), (6400, "6400"), (12800, "12800"))
ISO_ABOVE = "25600+"
FOCAL_BUCKETS = ((20, "<20mm"), (35, "20-34mm"), (50, "35-49mm"), (85, "50-84mm"), (135, "85-134mm"), (200, "135-199mm"), (400, "200-399mm"))
FOCAL_ABOVE = "400mm+"
SHUTTER_BUCKETS = ((0.00025, "1/8000-1/4000"), (0.0005, "1/4000-1/2000"), (0.001, "1/2000-1/1000"), (0.002, "1/1000-1/500"), (0.004, "1/500-1/250"), (0.008, "1/250-1/125"), (0.0167, "1/125-1/60"), (0.0333, "1/60-1/30"), (0.25, "1/30-1/4"))
SHUTTER_ABOVE = "1/4s+"
BANDS = (4, 6, 8)
# -------------------------------------------------------------------------------------------------------------


def bucket(value: Column, bounds: tuple[tuple[float, str], ...], above: str, closed: bool = False) -> Column:
    """The label of the first bound that the value lies below (or at, if ``closed``); null unless it is positive."""
    out = F.lit(above)
    for bound, label in reversed(bounds):
        out = F.when(value <= bound if closed else value < bound, label).otherwise(out)
    return F.when(value > 0, out)


def gear(df: DataFrame, columns: list[str], averages: list[str], k: int = 20) -> DataFrame:
    """Cameras, lenses and their combinations with counts and averages, the most frequent of each kind.  Missing
    scores stay out of averages; missing settings count as 0."""
    kinds = [(c, F.col(c)) for c in columns] + [(" + ".join(columns), F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)), F.concat_ws(" + ", *columns)))]
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), v.alias("name")) for n, v in kinds))).alias("g"), *averages).select("g.*", *averages).where("name is not null")
    stats = rows.groupBy("kind", "name").agg(F.count("*").alias("n"), *(F.round(F.avg(a if a in ("aggregate", "aesthetic") else F.coalesce(F.col(a), F.lit(0.0))), 4).alias(f"avg_{a}") for a in averages))
    from pyspark.sql import Window

    return stats.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "name"))).where(F.col("_r") <= k).drop("_r")


def settings(df: DataFrame) -> DataFrame:
    """Histograms of ISO, aperture, focal length, shutter time and score in one pass, with each bucket's least value."""
    shutter = exprs.shutter_seconds("shutter")
    parts = {
        "iso": (F.col("iso"), bucket(F.col("iso"), ISO_BUCKETS, ISO_ABOVE, closed=True)),
        "aperture": (F.col("f_stop"), F.when(F.col("f_stop") > 0, F.round("f_stop", 1).cast("string"))),
        "focal": (F.col("focal"), bucket(F.col("focal"), FOCAL_BUCKETS, FOCAL_ABOVE)),
        "shutter": (shutter, bucket(shutter, SHUTTER_BUCKETS, SHUTTER_ABOVE)),
        "score": (F.col("aggregate"), (F.round(F.col("aggregate") * 2) / 2).cast("string")),
    }
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), v.cast("double").alias("v"), b.alias("bucket")) for n, (v, b) in parts.items()))).alias("s")).select("s.*").where("bucket is not null")
    return rows.groupBy("setting", "bucket").agg(F.count("*").alias("n"), F.round(F.min("v"), 6).alias("least"))


def categories(df: DataFrame, category: str, metrics: list[str]) -> DataFrame:
    """Averages of each category and a histogram of its scores by whole points; those without one stand under null."""
    histogram = F.array(*(F.count_if(F.floor(F.col("aggregate")) == k) for k in range(11)))
    return df.groupBy(category).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(f"avg_{m}") for m in metrics), F.array_join(histogram.cast("array<string>"), ",").alias("histogram"))


def matched_against_assigned(df: DataFrame, rules: dict[str, Column], category: str) -> DataFrame:
    """For each rule how many rows match it, how many carry its name, and how many do both."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("m"), F.coalesce(F.col(category) == n, F.lit(False)).alias("a")) for n, c in sorted(rules.items())))).alias("r")).select("r.*")
    return rows.groupBy("rule").agg(F.count_if("m").alias("matched"), F.count_if("a").alias("assigned"), F.count_if(F.col("m") & F.col("a")).alias("both"))


def sample_of_category(df: DataFrame, category: str, name: str, key: str, metrics: list[str], k: int = 5000) -> DataFrame:
    """Raw metric vectors of a category, by key, at most k."""
    return df.where(F.col(category) == name).select(key, *metrics).orderBy(key).limit(k)


def stored_counts(df: DataFrame, families: dict[str, Column]) -> DataFrame:
    """Counts of several families in one pass, as a table to be stored: family, value, n."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("family"), c.cast("string").alias("value")) for n, c in families.items()))).alias("f")).select("f.*").where("value is not null")
    return rows.groupBy("family", "value").agg(F.count("*").alias("n"))


def comparisons(votes: DataFrame, a: str, b: str, winner: str) -> DataFrame:
    """Votes by winner, and the number of different photos on either side, in one row each."""
    by = votes.groupBy(F.col(winner).cast("string").alias("what")).agg(F.count("*").alias("n"))
    both = votes.select(F.col(a).alias("k")).union(votes.select(F.col(b).alias("k"))).where("k is not null").agg(F.count_distinct("k").alias("n"))
    return by.unionByName(both.select(F.lit("photos").alias("what"), "n"))


def labels(votes: DataFrame, group: str, user: str, label: str) -> DataFrame:
    """Inventory of labels for each user: their number, positive ones, and different groups."""
    return votes.groupBy(user).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positive"), F.count_distinct(group).alias("groups"))


def album_suggestion(df: DataFrame, group: str, moment: str, least: int, share: float) -> DataFrame:
    """The dominant moment of each group and its share, where it is large enough to name an album by."""
    n = df.where(F.col(moment).isNotNull()).groupBy(group, moment).agg(F.count("*").alias("n"))
    best = n.groupBy(group).agg(F.sum("n").alias("total"), F.min_by(F.struct(moment, "n"), F.struct(-F.col("n"), F.col(moment))).alias("b"))
    part = F.round(F.col("b.n") / F.col("total"), 6)
    return best.where((F.col("total") >= least) & (part >= share)).select(group, F.col(f"b.{moment}").alias("moment"), part.alias("share"))


def album_counts(albums: DataFrame, members: DataFrame, text: str | None = None, smart: bool | None = None) -> DataFrame:
    """Albums with their number of photos, by part of the name and kind."""
    out = albums
    if text:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if smart is not None:
        out = out.where(F.col("smart") == smart)
    n = members.groupBy("album").agg(F.count("*").alias("photos"))
    return out.join(n, "album", "left").select("album", "name", F.coalesce("photos", F.lit(0)).alias("photos"))


def library(df: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric: rows, mean, spread, bounds, and rows in each score band."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m")).select("m.*").where("v is not null")
    edges = [-float("inf"), *BANDS, float("inf")]
    bands = [F.count_if((F.col("v") >= lo) & (F.col("v") < hi)).alias(f"band_{k}") for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("spread"), F.min("v").alias("least"), F.max("v").alias("most"), *bands)
