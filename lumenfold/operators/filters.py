"""The gallery filter: independent conditions that are combined with AND.  Unknown parameters are ignored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import exprs


def _number(x) -> float | None:
    try:
        v = float(x)
    except (TypeError, ValueError):
        return None
    return v if v == v and abs(v) != float("inf") else None


def visible(path: Column, prefixes: list[str] | None) -> Column:
    """Rows below any of the prefixes; an empty list shows nothing, None shows all."""
    if prefixes is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (path.startswith(p.replace("\\", "/")) for p in prefixes), F.lit(False))


def hide_followers(lead: str, group: str, also: str | None = None) -> Column:
    """Keep leads, rows without a measured lead and rows outside any group."""
    keep = (F.col(lead) == 1) | F.col(lead).isNull() | F.col(group).isNull()
    return keep | (F.coalesce(F.col(also), F.lit(0)) == 1) if also else keep


@dataclass
class Query:
    """Compiles request parameters into one predicate and, for tags and people, semi and anti joins."""

    params: Mapping[str, object]
    numeric: tuple[str, ...] = ()
    equal: tuple[str, ...] = ()
    date: str | None = None
    prefix: str | None = None
    hue: str | None = None
    tier: str | None = None
    hide: Mapping[str, Column] = field(default_factory=dict)

    def conditions(self) -> list[Column]:
        p, out = self.params, []
        for c in self.numeric:
            if (v := _number(p.get(f"min_{c}"))) is not None:
                out.append(F.col(c) >= v)
            if (v := _number(p.get(f"max_{c}"))) is not None:
                out.append(F.col(c) <= v)
        out += [F.col(c) == p[c] for c in self.equal if p.get(c) not in (None, "")]
        if self.date and p.get("date_from"):
            out.append(F.to_date(F.col(self.date)) >= F.lit(p["date_from"]).cast("date"))
        if self.date and p.get("date_to"):
            out.append(F.to_date(F.col(self.date)) <= F.lit(p["date_to"]).cast("date"))
        if self.prefix and p.get("path_prefix"):
            out.append(F.col(self.prefix).startswith(str(p["path_prefix"]).replace("\\", "/")))
        if self.hue and p.get("hue"):
            out.append(exprs.hue_bucket(self.hue).isin(*str(p["hue"]).split(",")))
        if self.tier and p.get("quality"):
            out.append(exprs.quality_tier(self.tier) == p["quality"])
        out += [condition for name, condition in self.hide.items() if str(p.get(f"hide_{name}", "0")) in ("1", "true", "True")]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, self.conditions(), F.lit(True)))


def with_tags(df: DataFrame, tags: DataFrame, key: str, require: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """``tags``: (key, tag).  Any of the required ones, none of the excluded ones."""
    if require:
        df = df.join(tags.where(F.col("tag").isin(*require)).select(key).distinct(), key, "left_semi")
    return df.join(tags.where(F.col("tag").isin(*exclude)).select(key).distinct(), key, "left_anti") if exclude else df


def with_all_people(df: DataFrame, faces: DataFrame, key: str, people: list[int]) -> DataFrame:
    """Rows in which all listed people appear."""
    hit = faces.where(F.col("person_id").isin(*people)).groupBy(key).agg(F.count_distinct("person_id").alias("n")).where(F.col("n") == len(set(people)))
    return df.join(hit.select(key), key, "left_semi")


def preferences_overlay(photos: DataFrame, preferences: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A user's own ratings replace the shared ones; missing rows count as 0."""
    own = preferences.select(key, *(F.col(c).alias(f"_own_{c}") for c in columns))
    out = photos.drop(*columns).join(own, key, "left")
    return out.select(*(c for c in out.columns if not c.startswith("_own_")), *(F.coalesce(f"_own_{c}", F.lit(0)).alias(c) for c in columns))
