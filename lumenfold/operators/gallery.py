"""The gallery request: projection, toggles, set scope, overrides, ratings, albums, windows and text search."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: defaults of toggles, kinds of sets in order of priority, and shorthands ------------------
HIDE_DEFAULTS = {"bursts": "1", "duplicates": "1", "blinks": "0", "brackets": "1", "panoramas": "1", "rejected": "1"}
SCOPES = ("sequence", "burst", "duplicate")
SHORTHANDS = {
    "portraits": {"min_face_quality": 5, "min_faces": 1},
    "groups": {"min_faces": 3},
    "monochrome": {"mono": 1},
    "best": {"min_aggregate": 8},
}
QUALITY_BOUNDS = {"good": 6, "great": 7, "excellent": 8}
# -------------------------------------------------------------------------------------------------------------


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def toggle(kind: str) -> Column:
    """What stays when a kind of row is hidden.  Rows that belong to no set of the kind always stay."""
    if kind == "bursts":
        return (_flag("burst_lead") == 1) | F.col("burst_lead").isNull() | F.col("burst").isNull() | (_flag("sequence_lead") == 1)
    if kind == "duplicates":
        return (_flag("twin_lead") == 1) | F.col("twin_lead").isNull() | F.col("twin").isNull()
    if kind == "blinks":
        return _flag("blink") == 0
    if kind == "brackets":
        return F.coalesce(F.col("sequence_kind") != "bracket", F.lit(True)) | F.coalesce(F.col("ev_offset") == 0, F.lit(False))
    if kind == "panoramas":
        return F.coalesce(F.col("sequence_kind") != "panorama", F.lit(True)) | (_flag("sequence_lead") == 1)
    if kind == "rejected":
        return _flag("rejected") == 0
    raise ValueError(kind)


def resolved_toggles(params: Mapping[str, object], defaults: Mapping[str, str] = HIDE_DEFAULTS) -> dict[str, bool]:
    """A toggle that is not given takes its default; an explicit "0" is kept.  A set scope shows all its members,
    so it suppresses all toggles but that of blinks and that of rejected rows."""
    out = {k: str(params.get(f"hide_{k}") if params.get(f"hide_{k}") is not None else d) in ("1", "true", "True") for k, d in defaults.items()}
    if scope(params) is not None:
        out |= dict.fromkeys(("bursts", "duplicates", "brackets", "panoramas"), False)
    return out


def scope(params: Mapping[str, object]) -> Column | None:
    """The one set that a request is limited to, by priority of its kind."""
    column = {"sequence": "sequence", "burst": "burst", "duplicate": "twin"}
    for kind in SCOPES:
        if params.get(kind) not in (None, ""):
            return F.col(column[kind]) == int(str(params[kind]))
    return None


def expanded(params: Mapping[str, object]) -> dict[str, object]:
    """Shorthands ``type`` and ``quality`` as the filters that they stand for; filters that are given win."""
    out: dict[str, object] = {}
    if params.get("type") in SHORTHANDS:
        out |= SHORTHANDS[str(params["type"])]
    elif params.get("type"):
        out["category"] = params["type"]
    if params.get("quality") in QUALITY_BOUNDS:
        out["min_aggregate"] = QUALITY_BOUNDS[str(params["quality"])]
    return out | {k: v for k, v in params.items() if k not in ("type", "quality")}


def ratings(params: Mapping[str, object]) -> list[Column]:
    """At least some stars, favourites alone, or rejected ones alone; missing values count as 0."""
    out = []
    if str(params.get("min_rating", "")) in ("1", "2", "3", "4", "5"):
        out.append(_flag("stars") >= int(str(params["min_rating"])))
    if str(params.get("favourites", "0")) == "1":
        out.append(_flag("favourite") == 1)
    if str(params.get("only_rejected", "0")) == "1":
        out.append(_flag("rejected") == 1)
    return out


def exif_bounds(column: str, first: str | None, last: str | None) -> Column:
    """Bounds on capture times as text, ``YYYY:MM:DD hh:mm:ss``; days are given with dashes, the last one counts whole."""
    out = F.lit(True)
    if first:
        out = out & (F.col(column) >= first.replace("-", ":"))
    if last:
        out = out & (F.col(column) <= last.replace("-", ":") + " 23:59:59")
    return out


def capture_window(column: str, start: str | None, end: str | None) -> Column:
    """Inclusive bounds on a timestamp."""
    out = F.lit(True)
    if start:
        out = out & (F.col(column) >= F.lit(start).cast("timestamp"))
    return out & (F.col(column) <= F.lit(end).cast("timestamp")) if end else out


def overridden(photos: DataFrame, overrides: DataFrame, key: str, mode: str) -> DataFrame:
    """Rows with an override: ``any``, ``suppressed`` (its kind is null) or ``forced``."""
    rows = overrides if mode == "any" else overrides.where(F.col("kind").isNull() if mode == "suppressed" else F.col("kind").isNotNull())
    return photos.join(rows.select(key).distinct(), key, "left_semi")


def in_album(photos: DataFrame, members: DataFrame, album: int, key: str) -> DataFrame:
    return photos.join(members.where(F.col("album") == album).select(key).distinct(), key, "left_semi")


def search_terms(text: str) -> list[str]:
    """Lower-case words; marks that a query language would read are dropped."""
    return ["".join(c for c in w if c.isalnum()) for w in text.lower().split() if any(c.isalnum() for c in w)]


def matches(text: str, columns: list[str]) -> Column:
    """Every term begins a word of any column; without usable terms, the text stands in one of them as it is."""
    words = F.flatten(F.array(*(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^\\p{L}\\p{N}]+") for c in columns)))
    terms = search_terms(text)
    if not terms:
        return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower())) for c in columns))

    def begins(term: str) -> Column:
        return F.exists(words, lambda w: w.startswith(term))

    return reduce(lambda a, b: a & b, map(begins, terms))


def searched(photos: DataFrame, text: str, columns: list[str], key: str, faces: DataFrame | None = None, persons: DataFrame | None = None) -> DataFrame:
    """Rows whose columns match, or that show a person whose name holds the text."""
    hit = photos.where(matches(text, columns))
    if faces is None or persons is None:
        return hit
    named = persons.where(F.contains(F.lower("name"), F.lit(text.strip().lower()))).select("person")
    shown = faces.join(named, "person", "left_semi").select(key)
    return photos.join(hit.select(key).union(shown).distinct(), key, "left_semi")


def projected(photos: DataFrame, base: list[str], optional: list[str], overlay: DataFrame | None, overrides: DataFrame | None, key: str, swapped: tuple[str, ...] = ("stars", "favourite", "rejected")) -> DataFrame:
    """Base columns and those optional ones that exist; a user's overlay replaces the rating columns, and the kind of
    an override and whether there is one stand beside them."""
    have = [c for c in [*base, *optional] if c in photos.columns]
    out = photos.select(*have)
    if overlay is not None:
        own = overlay.select(key, *(F.col(c).alias(f"_own_{c}") for c in swapped))
        out = out.join(own, key, "left").select(*(F.coalesce(f"_own_{c}", F.lit(0)).alias(c) if c in swapped else F.col(c) for c in have))
    if overrides is not None:
        out = out.join(overrides.select(key, F.col("kind").alias("override_kind"), F.lit(True).alias("_has")), key, "left").withColumn("overridden", F.coalesce("_has", F.lit(False))).drop("_has")
    return out


def numeric_bounds(params: Mapping[str, object], columns: list[str]) -> list[Column]:
    out = []
    for name, v in params.items():
        c = name[4:]
        if name[:4] in ("min_", "max_") and c in columns:
            try:
                bound = float(str(v))
            except ValueError:
                continue
            if bound == bound and abs(bound) != float("inf"):
                out.append(F.col(c) >= bound if name[:4] == "min_" else F.col(c) <= bound)
    return out


def conditions(params: Mapping[str, object], columns: list[str]) -> list[Column]:
    """All of a request's conditions on the rows themselves."""
    p = expanded(params)
    out = numeric_bounds(p, columns) + ratings(p) + [toggle(k) for k, on in resolved_toggles(p).items() if on and not (k == "rejected" and str(p.get("only_rejected", "0")) == "1")]
    out += [F.col(c) == p[c] for c in ("category", "camera", "mono", "moment") if p.get(c) not in (None, "") and c in columns]
    if p.get("lens"):
        out.append(F.col("lens").startswith(str(p["lens"])))
    if (one := scope(p)) is not None:
        out.append(one)
    if p.get("window_start") or p.get("window_end"):
        out.append(capture_window("taken", p.get("window_start"), p.get("window_end")))
    return out


def request(photos: DataFrame, params: Mapping[str, object]) -> DataFrame:
    return photos.where(reduce(lambda a, b: a & b, conditions(params, photos.columns), F.lit(True)))


def smart_album(photos: DataFrame, stored: str) -> DataFrame:
    """A stored filter, run again."""
    return request(photos, json.loads(stored))


def ordered(df: DataFrame, by: str, descending: bool, key: str, allowed: tuple[str, ...], sink: tuple[str, ...] = ()) -> list[Column]:
    """An order by a known column (else by ``key``), ties by key.  Missing values of ``sink`` columns always come last."""
    if by not in allowed:
        return [F.col(key)]
    c = F.col(by)
    if by in sink:
        return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key)]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col(key)]


def page_with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page and the number of all rows beside each of its rows; the count is a partial aggregate of its own."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def curated(photos: DataFrame, key: str, least: float, pool: int, n: int, seed: str) -> DataFrame:
    """The best rows that are neither rejected nor blinks, and a sample of them that ``seed`` draws."""
    good = photos.where((_flag("rejected") == 0) & (_flag("blink") == 0) & (F.col("aggregate") >= least))
    best = good.orderBy(F.col("aggregate").desc(), key).limit(pool)
    return best.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def set_members(photos: DataFrame, key: str) -> DataFrame:
    """Members of sequences in display order: brackets by distance from the base, others as captured."""
    from pyspark.sql import Window

    place = F.when(F.col("sequence_kind") == "bracket", F.abs("ev_offset"))
    w = Window.partitionBy("sequence").orderBy(place.asc_nulls_last(), "taken", key)
    return photos.where(F.col("sequence").isNotNull()).withColumn("place", F.row_number().over(w))
