"""Ranking within groups, ordering and pagination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.tables import checkpointed


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which nulls are equal too; the keys come from the left side."""
    alike = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return left.join(alike, on, how).drop(*(f"_right_{k}" for k in keys))


def group_top_k(df: DataFrame, groups: list[Column | str], order: list[Column], k: int, least: int = 1) -> DataFrame:
    """The first k rows of each group of at least ``least`` rows, with rank and group size.

    Sizes are a partial aggregate of their own, so that the rank alone stands over the group and Spark keeps k rows of
    each group before it shuffles."""
    keys = [f"_group{i}" for i in range(len(groups))]
    rows = df.select("*", *((F.col(g) if isinstance(g, str) else g).alias(n) for g, n in zip(groups, keys, strict=True)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_size")).where(F.col("group_size") >= least)
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return same(best, sizes, keys).select(*df.columns, "group_size", "rank")


#: Distinct values of all groups that one task may sort: some megabytes.
FEW = 200_000


def value_positions(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Each distinct value of each group with its rows (_n), the group's rows below it (_below) and in all (_size).

    Equal values are counted before they travel and values are dealt by range, so a group of any size is many tasks.
    The ranges are written before they are numbered: bounds are sampled, and two reads could sample two ways.  Nulls
    stand first, as a value.  Up to ``FEW`` distinct values in all are numbered as they are, without ranges."""
    counted = checkpointed(df.groupBy(*groups, value).agg(F.count("*").alias("_n")))
    if counted.count() <= FEW:
        all_of = Window.partitionBy(*(groups or [F.lit(0)]))
        return counted.select(*groups, value, "_n", (F.sum("_n").over(all_of.orderBy(value)) - F.col("_n")).alias("_below"), F.sum("_n").over(all_of).alias("_size"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(counted.repartitionByRange(parts, *groups, value).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*groups, "_part").agg(F.sum("_n").alias("_held"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))  # one row for each range that the group reaches into
    before = sizes.select(*groups, "_part", (F.sum("_held").over(whole.orderBy("_part")) - F.col("_held")).alias("_before"), F.sum("_held").over(whole).alias("_size"))
    own = F.sum("_n").over(Window.partitionBy(*groups, "_part").orderBy(value)) - F.col("_n")
    return same(dealt.withColumn("_own", own), before, [*groups, "_part"]).select(*groups, value, "_n", (F.col("_before") + F.col("_own")).alias("_below"), "_size")


def row_before(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Beside each row the ``order`` columns of the one before it in its group, as a struct (null for the first).

    Rows are dealt by range; only the last row of each range is looked up from the next, so a group of any size is many tasks."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()))
    last = dealt.groupBy(group, "_part").agg(F.max(F.struct(*order)).alias("_last"))
    carried = last.select(group, "_part", F.lag("_last").over(Window.partitionBy(group).orderBy("_part")).alias("_carried"))
    own = F.lag(F.struct(*order)).over(Window.partitionBy(group, "_part").orderBy(*order))
    return same(dealt.withColumn("_own", own), carried, [group, "_part"]).withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_part")


def at_position(value: str, place: Column) -> Column:
    """Aggregate over ``value_positions``: the group's value at a position from 0."""
    return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col(value)))


def modal(df: DataFrame, groups: list[str], item: str) -> DataFrame:
    """Each group's most frequent item; ties go to the smallest."""
    counted = df.where(F.col(item).isNotNull()).groupBy(*groups, item).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("n").desc(), item))
    return counted.withColumn("_best", best).where("_best = 1").select(*groups, item, "n")


def percentile_rank(df: DataFrame, value: str, tie: str, scale: float = 10.0, out: str = "percentile_score") -> DataFrame:
    """Rank over n - 1, times ``scale``.  The table is ranked by a range sort: ranks inside each partition plus the
    sizes of the partitions before it, so no single task sorts all rows.  The ranges are written before they are
    numbered, as their bounds are sampled."""
    ranged = checkpointed(df.repartitionByRange(F.col(value).asc_nulls_first(), F.col(tie)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"), F.sum("count").over(Window.partitionBy(F.lit(0))).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(value).asc_nulls_first(), tie))
    ranked = ranged.withColumn("_own", own).join(F.broadcast(before), "_part")
    return ranked.withColumn(out, F.try_divide((F.col("_before") + F.col("_own") - 1) * scale, F.col("_n") - 1)).drop("_part", "_own", "_before", "_n")


def average_ranks(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """Ties share the mean of their ranks."""
    places = value_positions(df, groups, value).select(*groups, value, (F.col("_below") + (F.col("_n") + 1) / 2).alias(out))
    return same(df, places, [*groups, value])


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, cursor, limit: int) -> DataFrame:
    """The groups after a cursor, newest first; one more than asked tells whether there are more."""
    rows = df if cursor is None else df.where(F.col(key) < F.lit(cursor))
    return rows.orderBy(F.col(key).desc()).limit(limit + 1)


def worst_percent(df: DataFrame, score: str, tie: str, percent: float, most: int = 5000) -> DataFrame:
    """What lies below the best ``percent``, worst first, at most ``most`` rows."""
    import math

    n = df.count()
    keep = math.ceil(n * percent / 100)
    return df.orderBy(F.col(score).asc_nulls_first(), tie).limit(max(0, min(n - keep, most)))


def top_percent(df: DataFrame, score: str, tie: str, percent: float = 1.0, most: int = 50, least: int = 20) -> DataFrame:
    """Rows at or above the score at position max(1, round(n * percent))."""
    n = df.where(F.col(score).isNotNull()).count()
    if n < least:
        return df.limit(0)
    at = max(1, int(n * percent / 100 + 0.5))
    places = value_positions(df.where(F.col(score).isNotNull()), [], score)
    bound = places.agg(at_position(score, F.lit(n - 1 - min(at, n - 1)))).first()[0]
    return df.where(F.col(score) >= bound).orderBy(F.col(score).desc(), tie).limit(most)


def interleave(df: DataFrame, kind: str, priority: str, order: list[Column]) -> DataFrame:
    """Round-robin over kinds: the first of each by priority, then the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn("turn", turn).orderBy("turn", priority, kind)


def on_this_day(df: DataFrame, ts: str, month: int, day: int, before_year: int, order: list[Column], k: int, spread: int = 0) -> DataFrame:
    """Earlier years' rows around a calendar day: the best k of each year with the year's total."""
    near = F.abs(F.datediff(F.make_date(F.year(ts), F.lit(month), F.lit(day)), F.to_date(ts))) <= spread
    rows = df.where(near & (F.year(ts) < before_year)).withColumn("year", F.year(ts))
    return group_top_k(rows, ["year"], order, k).withColumnRenamed("group_size", "total")
