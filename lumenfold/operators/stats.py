"""Aggregations: overviews, histograms, value counts, timelines, correlations, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.windows import at_position, modal, same, value_positions

DIGITS = 4


def mean(c: str, digits: int = DIGITS) -> Column:
    return F.round(F.avg(c), digits)


def overview(df: DataFrame, scores: list[str], ts: str) -> DataFrame:
    """One row: count, rounded averages, first and last day."""
    return df.agg(F.count("*").alias("n"), *(mean(c).alias(f"avg_{c}") for c in scores), F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day"))


def score_histogram(df: DataFrame, score: str) -> DataFrame:
    """Half-point buckets with counts and shares of all scored rows."""
    buckets = df.where(F.col(score).isNotNull()).groupBy((F.round(F.col(score) * 2) / 2).alias("bucket")).agg(F.count("*").alias("n"))
    total = buckets.agg(F.sum("n").alias("total"))
    return buckets.crossJoin(F.broadcast(total)).select("bucket", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def top_groups(df: DataFrame, group: str, score: str, least: int, k: int) -> DataFrame:
    """The k groups of at least ``least`` rows with the best average."""
    return df.groupBy(group).agg(F.count("*").alias("n"), mean(score).alias("avg_score")).where(F.col("n") >= least).orderBy(F.col("avg_score").desc(), group).limit(k)


def group_stats_with_mode(df: DataFrame, group: str, scores: list[str], item: str) -> DataFrame:
    """Per group: count, share, averages and the most frequent item (smallest among equals)."""
    stats = df.groupBy(group).agg(F.count("*").alias("n"), *(mean(c).alias(f"avg_{c}") for c in scores))
    total = stats.agg(F.sum("n").alias("total"))
    top = modal(df, [group], item).select(group, F.col(item).alias(f"top_{item}"), F.col("n").alias("top_n"))
    return stats.join(top, group, "left").crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("total"), 6)).drop("total")


def bucketed(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """Labels of half-open ranges below each bound; the last label holds the rest."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels, strict=False):
        out = out.when(value < bound, label)
    return out.otherwise(labels[-1])


def histogram_of(df: DataFrame, value: str, bounds: list[float], labels: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(bucketed(F.col(value), bounds, labels).alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least")).orderBy("least")


def heatmap(df: DataFrame, ts: str) -> DataFrame:
    """Counts by weekday (Sunday is 0) and hour."""
    return df.where(F.col(ts).isNotNull()).groupBy((F.dayofweek(ts) - 1).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))


def by_period(df: DataFrame, ts: str, layout: str, score: str) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, layout).alias("period")).agg(F.count("*").alias("n"), mean(score).alias("avg_score"))


def correlation_explorer(df: DataFrame, x: Column, metrics: list[str], least: int) -> DataFrame:
    """Averages of metrics by a bucketed x, for buckets of at least ``least`` rows."""
    return df.withColumn("x", x).where("x is not null").groupBy("x").agg(F.count("*").alias("n"), *(mean(m).alias(f"avg_{m}") for m in metrics)).where(F.col("n") >= least)


def pearson(df: DataFrame, group: str, target: str, metrics: list[str], least: int = 10) -> DataFrame:
    """r of each metric with the target in each group; 0 where either does not vary."""
    rows = df.select(group, F.col(target).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("m")).select(group, "y", "m.*").where("x is not null and y is not null")
    return rows.groupBy(group, "metric").agg(F.count("*").alias("n"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")).alias("r")).where(F.col("n") >= least).withColumn("r", F.round(F.coalesce("r", F.lit(0.0)), DIGITS))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select("f.*")
    return rows.where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def metric_ranges(df: DataFrame, metrics: list[str], bins: int = 20) -> DataFrame:
    """Finite minimum, maximum and a histogram of each metric; a metric without spread has one bin."""
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m")).select("m.*").where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    ends = rows.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))).cast("int")))).otherwise(0)
    return rows.join(F.broadcast(ends), "metric").groupBy("metric", "lo", "hi", place.alias("bin")).agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One count for each named condition, in a single pass."""
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def rule_overlap(df: DataFrame, rules: dict[str, Column], k: int = 50) -> DataFrame:
    """How often pairs of rules match the same row."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sorted(rules.items()))))
    pairs = df.select(names.alias("m")).where(F.size("m") > 1).select(F.explode(F.expr("flatten(transform(m, (a, i) -> transform(slice(m, i + 2, size(m)), b -> struct(a as rule_a, b as rule_b))))")).alias("p"))
    return pairs.groupBy("p.rule_a", "p.rule_b").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "rule_a", "rule_b").limit(k)


def nearest_rank(df: DataFrame, groups: list[str], value: str, percents: list[int], least: int = 1) -> DataFrame:
    """The value at index int(n * p / 100) of the sorted values, clamped to the last."""
    places = value_positions(df.where(F.col(value).isNotNull()), groups, value).where(F.col("_size") >= least)
    index = lambda p: F.least(F.floor(F.col("_size") * p / 100), F.col("_size") - 1)
    return places.groupBy(*groups).agg(*(at_position(value, index(p)).alias(f"p{p}") for p in percents))


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Named quantiles of each group's values, by linear interpolation between neighbours."""
    places = value_positions(df.where(F.col(value).isNotNull()), groups, value)
    place = lambda q: (F.col("_size") - 1) * q
    ends = [c for n, q in shares.items() for c in (at_position(value, F.floor(place(q))).alias(f"_lo_{n}"), at_position(value, F.ceil(place(q))).alias(f"_hi_{n}"), F.max(place(q) - F.floor(place(q))).alias(f"_at_{n}"))]
    between = lambda n: F.col(f"_lo_{n}") * (1 - F.col(f"_at_{n}")) + F.col(f"_hi_{n}") * F.col(f"_at_{n}")
    return places.groupBy(*groups).agg(*ends).select(*groups, *(F.round(between(n), DIGITS).alias(n) for n in shares))


def percentiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation, with the mean."""
    found = df.groupBy(*groups).agg(F.count(value).alias("n"), mean(value).alias("mean"))
    quarters = quantiles(df, groups, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return same(found, quarters, groups, "left").select(*groups, "n", "p25", "median", "p75", "mean")


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """One row of counts, moments and bounds, with the 95th percentile."""
    found = df.agg(F.count(value).alias("n"), mean(value).alias("mean"), F.round(F.stddev_samp(value), DIGITS).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return found.crossJoin(F.broadcast(quantiles(df, [], value, {"p95": 0.95})))  # one row on either side


def quarter_trend(df: DataFrame, ts: str, score: str, gain: float = 0.05) -> DataFrame:
    """Quarterly averages and whether each beats the one before by ``gain``."""
    q = df.groupBy((F.year(ts) * 4 + F.quarter(ts) - 1).alias("q")).agg(F.avg(score).alias("avg"), F.count("*").alias("n"))
    before = F.lag("avg").over(Window.orderBy("q"))  # one row a quarter
    return q.select("q", "n", F.round("avg", 6).alias("avg_score"), F.coalesce(F.col("avg") >= before * (1 + gain), F.lit(False)).alias("improved"))


def folder_rollup(df: DataFrame, path: str, root: str, score: str) -> DataFrame:
    """Immediate children below a root: count and best row (smallest path among equals)."""
    child = F.split_part(F.substring(F.col(path), len(root) + 1, 1 << 20), F.lit("/"), F.lit(1))
    rows = df.where(F.col(path).startswith(root)).withColumn("folder", child)
    return rows.groupBy("folder").agg(F.count("*").alias("n"), F.min_by(path, F.struct(-F.col(score), F.col(path))).alias("best"))


def location_grid(df: DataFrame, lat: str, lon: str, cell: float, least: int, k: int) -> DataFrame:
    """Grid cells of at least ``least`` rows, densest first."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.round(F.col(lat) / cell).cast("long").alias("y"), F.round(F.col(lon) / cell).cast("long").alias("x")).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "y", "x").limit(k)


def map_clusters(df: DataFrame, lat: str, lon: str, zoom: int, key: str, score: str) -> DataFrame:
    """Cells that halve with each zoom step: centroid, count and best row."""
    cell = 180.0 / 2 ** max(zoom, 2)
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.round(F.col(lat) / cell).cast("long").alias("y"), F.round(F.col(lon) / cell).cast("long").alias("x")).agg(F.count("*").alias("n"), mean(lat).alias("lat"), mean(lon).alias("lon"), F.min_by(key, F.struct(-F.col(score), F.col(key))).alias("best"))

