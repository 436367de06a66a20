"""Checks of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_violations(df: DataFrame, key: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their range or not finite."""
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for c, (lo, hi) in ranges.items()))).alias("v")).select(key, "v.*")
    return rows.where("value is not null and (isnan(value) or value < lo or value > hi)").select(key, "column", "value")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def outliers(df: DataFrame, key: str, value: str, group: str, sigmas: float = 3.0) -> DataFrame:
    """Values further from their group's mean than so many standard deviations."""
    about = df.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return df.join(about, group).where(F.abs(F.col(value) - F.col("m")) > sigmas * F.col("s")).select(key, group, value)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def null_shares(df: DataFrame) -> DataFrame:
    n = F.count("*")
    row = df.agg(*(F.round(1 - F.count(c) / n, 6).alias(c) for c in df.columns))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in df.columns))).alias("s")).select("s.*")


def type_corruption(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Texts in numeric columns that are no numbers."""
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), F.col(c).cast("string").try_cast("double").alias("number")) for c in columns))).alias("v")).select(key, "v.*")
    return rows.where("raw is not null and number is null").select(key, "column", "raw")


def flag_violations(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Flags other than 0, 1 and null."""
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("value")) for c in flags))).alias("v")).select(key, "v.*")
    return rows.where("value is not null and value not in (0, 1)")


def implications(df: DataFrame, key: str, rules: dict[str, tuple]) -> DataFrame:
    """Rows where a premise holds and its conclusion does not: name -> (premise, conclusion)."""
    broken = F.array_compact(F.array(*(F.when(p & ~F.coalesce(c, F.lit(False)), F.lit(n)) for n, (p, c) in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def vector_lengths(df: DataFrame, vector: str) -> DataFrame:
    """How many vectors have each length, the missing ones under null."""
    return df.groupBy(F.when(F.col(vector).isNotNull(), F.size(vector)).alias("length")).agg(F.count("*").alias("n"))
