"""Scalar expressions over photo metadata, all as plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: layouts, cut-points and bucket bounds that results depend on -----------------------------
CAPTURE_LAYOUTS = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
HUE_BUCKETS = {"red": ((0, 15), (345, 360)), "orange": ((15, 45),), "yellow": ((45, 70),), "green": ((70, 165),), "cyan": ((165, 195),), "blue": ((195, 255),), "purple": ((255, 300),), "magenta": ((300, 345),)}
NEUTRAL_SATURATION = 0.15
TOP_PICK_SHARES = {"aggregate": 0.20, "aesthetic": 0.32, "composition": 0.24, "face_quality": 0.24}
TOP_PICK_FACE_RATIO, TOP_PICK_LEAST = 0.20, 7.0
QUALITY_TIERS = (("excellent", 8.0), ("good", 7.0), ("fair", 6.0))
STAR_CUTS = ((9.0, 5), (8.0, 4), (7.0, 3), (5.5, 2))
EARTH_KM = 6371.0
MISSING_HASH_DISTANCE = 999
# -------------------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def capture_time(text: Column | str) -> Column:
    """The first layout that fits the text's first 19 characters; null if none does."""
    head = F.substring(_col(text), 1, 19)
    return F.coalesce(*(F.try_to_timestamp(head, F.lit(layout)) for layout in CAPTURE_LAYOUTS))


def exif_to_iso(text: Column | str) -> Column:
    """Only the date part's colons become dashes."""
    t = _col(text)
    return F.concat(F.replace(F.substring(t, 1, 10), F.lit(":"), F.lit("-")), F.substring(t, 11, 1 << 20))


def monday_week(ts: Column | str) -> Column:
    """Week of the year, Monday-based, 00 before the first Monday (not the ISO week)."""
    t = _col(ts)
    return F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7).cast("int")


def sunday_weekday(ts: Column | str) -> Column:
    return F.dayofweek(_col(ts)) - 1


def season(ts: Column | str) -> Column:
    m = F.month(_col(ts))
    return F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn")


def season_year(ts: Column | str) -> Column:
    """December counts towards the next year's winter."""
    t = _col(ts)
    return F.year(t) + (F.month(t) == 12).cast("int")


def shutter_seconds(text: Column | str) -> Column:
    """Decimal seconds or a fraction; null where neither."""
    t = _col(text)
    top, bottom = F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(t, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.instr(t, "/") > 0, F.try_divide(top, bottom)).otherwise(t.try_cast("double"))


def exposure_value(f_stop: Column | str, seconds: Column | str, iso: Column | str) -> Column:
    """log2(N^2 / t) - log2(ISO / 100); null on missing or non-positive operands."""
    n, t, s = _col(f_stop).try_cast("double"), _col(seconds).try_cast("double"), _col(iso).try_cast("double")
    return F.when((n > 0) & (t > 0) & (s > 0), F.log2(n * n / t) - F.log2(s / 100))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Different bits of two 64-bit hashes; a missing one is far from everything."""
    return F.coalesce(F.bit_count(_col(a).bitwiseXOR(_col(b))), F.lit(MISSING_HASH_DISTANCE))


def hash_from_hex(text: Column | str) -> Column:
    return F.conv(_col(text), 16, -10).try_cast("bigint")


def hue_bucket(hue: Column | str) -> Column:
    """Half-open hue ranges; red lies on both sides of 0."""
    h = _col(hue)
    return F.coalesce(*(F.when((h >= lo) & (h < hi), name) for name, ranges in HUE_BUCKETS.items() for lo, hi in ranges))


def quality_tier(score: Column | str) -> Column:
    s = _col(score)
    out = F.when(s.isNull(), F.lit(None))
    for name, least in QUALITY_TIERS:
        out = out.when(s >= least, name)
    return out.otherwise("poor")


def stars(score: Column | str) -> Column:
    s = _col(score)
    out = F.when(s.isNull(), F.lit(0))
    for least, n in STAR_CUTS:
        out = out.when(s >= least, n)
    return out.otherwise(0)


def colour_temperature(hue: Column | str, saturation: Column | str) -> Column:
    h = _col(hue)
    return F.when(F.coalesce(_col(saturation), F.lit(0.0)) < NEUTRAL_SATURATION, "neutral").when((h <= 60) | (h >= 300), "warm").when((h >= 150) & (h <= 270), "cool").otherwise("neutral")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geo_box(lat: Column | str, lon: Column | str, lat0: float, lon0: float, km: float) -> Column:
    """A box around a point, without refinement by distance."""
    import math

    dlat, dlon = km / 111.0, km / (111.0 * max(math.cos(math.radians(lat0)), 0.01))
    return _col(lat).between(lat0 - dlat, lat0 + dlat) & _col(lon).between(lon0 - dlon, lon0 + dlon)


def cosine(a: Column | str, b: Column | str) -> Column:
    """In double precision; null for missing or zero vectors and for different lengths."""
    x, y = (F.transform(_col(v), lambda e: e.cast("double")) for v in (a, b))

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)

    return F.when(F.size(x) == F.size(y), F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))))


def finite(x: Column | str) -> Column:
    """NaN and infinities become null."""
    c = _col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def tags(text: Column | str) -> Column:
    """A JSON list or comma-separated text as a list of trimmed tags."""
    t = F.trim(_col(text))
    raw = F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.split(t, ","))
    return F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "_")


def stable_id(*parts: Column | str) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *(_col(p).cast("string") for p in parts))), 1, 12)


def lens_is_junk(text: Column | str) -> Column:
    """Under four characters, or nothing but digits and separators."""
    t = _col(text)
    return (F.length(t) < 4) | F.regexp_replace(t, "[:\\- .]", "").rlike("^[0-9]*$")


def top_pick_score(aggregate, aesthetic, composition, face_quality, face_ratio) -> Column:
    """A blend; where no face is prominent, half of its share goes to each of aesthetic and composition."""
    a, b, c, f = (F.coalesce(_col(x), F.lit(0.0)) for x in (aggregate, aesthetic, composition, face_quality))
    w = TOP_PICK_SHARES
    half = w["face_quality"] / 2
    with_face = a * w["aggregate"] + b * w["aesthetic"] + c * w["composition"] + f * w["face_quality"]
    without = a * w["aggregate"] + b * (w["aesthetic"] + half) + c * (w["composition"] + half)
    return F.when(_col(face_ratio) >= TOP_PICK_FACE_RATIO, with_face).otherwise(without)


def crop_box(width, height, aspect: float, x, y) -> Column:
    """The largest box of an aspect around a point, moved inside the frame."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    bw = F.least(w, h * aspect)
    bh = bw / aspect
    left = F.greatest(F.lit(0.0), F.least(w - bw, _col(x) - bw / 2))
    top = F.greatest(F.lit(0.0), F.least(h - bh, _col(y) - bh / 2))
    return F.struct(left.alias("left"), top.alias("top"), bw.alias("width"), bh.alias("height"))


def round_exact(value: Column | str, digits: int = 0) -> Column:
    """Rounds the exact binary value, halves to even, as Python's ``round`` does: 12.35, which is a little less, is 12.3.

    Twice the value times a power of ten is a sum of exact parts (the value times powers of two), kept as a double
    and what it lacks; its distance from an odd whole number decides."""
    x = _col(value).cast("double")
    factor = 10**digits
    high, low = F.lit(0.0), F.lit(0.0)
    for k in reversed(range((2 * factor).bit_length())):
        if 2 * factor >> k & 1:
            part = x * F.lit(float(2**k))
            total = high + part
            back = total - high
            low = low + ((high - (total - back)) + (part - back))
            high = total
    whole = F.floor(high / 2)  # the result is whole or whole + 1, over the factor
    past = (high - (2 * whole + 1).cast("double")) + low
    up = F.when(past > 0, 1).when(past < 0, 0).otherwise(F.pmod(whole, F.lit(2)))
    return F.when(F.abs(x) < 2.0**52 / (2 * factor), (whole + up).cast("double") / factor).otherwise(x)
