"""Rule-based categories, normalisation and the weighted aggregate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(spec: Mapping[str, object], tags: str | None = None) -> Column:
    """AND of ranges (``min_x`` / ``max_x``; a missing value fails), equalities and tag conditions."""
    parts = []
    for name, v in spec.items():
        if name.startswith("min_"):
            parts.append(F.col(name[4:]) >= v)
        elif name.startswith("max_"):
            parts.append(F.col(name[4:]) <= v)
        elif name == "any_tags":
            parts.append(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, v))))
        elif name == "all_tags":
            parts += [F.array_contains(tags, t) for t in v]
        elif name == "no_tags":
            parts.append(~F.arrays_overlap(F.col(tags), F.array(*map(F.lit, v))))
        else:
            parts.append(F.col(name) == v)
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def category(rules: Mapping[str, Column], promote: tuple[str, ...] = (), exclude: tuple[str, ...] = (), override: str | None = None, default: str = "default") -> Column:
    """The first matching rule, promoted ones first; a known override wins."""
    order = [*[n for n in promote if n in rules], *[n for n in rules if n not in promote]]
    out = F.lit(default)
    for n in reversed([n for n in order if n not in exclude]):
        out = F.when(rules[n], n).otherwise(out)
    return F.when(F.col(override).isin(*rules, default), F.col(override)).otherwise(out) if override else out


def weights(percent: Mapping[str, float]) -> dict[str, float]:
    """Fractions that sum to 1."""
    total = sum(percent.values())
    return {k: v / total for k, v in percent.items()} if total > 0 else {k: 1 / len(percent) for k in percent}


def integer_weights(percent: Mapping[str, float]) -> dict[str, int]:
    """Whole percents; the last takes what rounding leaves."""
    w, names = weights(percent), list(percent)
    out = {k: round(100 * w[k]) for k in names[:-1]}
    return out | {names[-1]: 100 - sum(out.values())}


def guarded(c: str, default: float, bound: float = 100.0) -> Column:
    """Values that are missing, not numbers or out of bounds count as the default."""
    v = F.col(c).try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= bound), v).otherwise(default)


def clamp(c: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def penalties(noise: Column, bimodality: Column, saturation: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.5), (z(noise) - 4) * 0.3)) + F.when(z(bimodality) > 2.5, 0.5).otherwise(0.0) + F.when(z(saturation) > 0.9, 0.5).otherwise(0.0)


def aggregate_score(metrics: Mapping[str, Column], share: Mapping[str, float], blink: Column | None = None, bonus: Column | None = None, minus: Column | None = None) -> Column:
    """Weighted sum of clamped metrics, halved on a blink, with bonus and penalties, clamped to 0..10."""
    total = reduce(lambda a, b: a + b, (clamp(metrics[m]) * F.lit(float(w)) for m, w in share.items()), F.lit(0.0))
    if blink is not None:
        total = F.when(blink == 1, total * 0.5).otherwise(total)
    return clamp(total + (bonus if bonus is not None else F.lit(0.0)) - (minus if minus is not None else F.lit(0.0)))


def normalised(df: DataFrame, group: str, value: str, by_group: DataFrame, overall: DataFrame, percentile: str) -> DataFrame:
    """value / percentile * 10, clamped: the group's percentile if there is one, else the overall one; 0 passes through."""
    g = by_group.select(group, F.col(percentile).alias("_g"))
    o = overall.select(F.col(percentile).alias("_o"))
    p = F.coalesce("_g", "_o")
    out = df.join(g, group, "left").crossJoin(F.broadcast(o))  # the overall one is a single row
    return out.withColumn(f"{value}_norm", F.when(F.coalesce(p, F.lit(0.0)) == 0, F.col(value)).otherwise(clamp(F.col(value) / p * 10))).drop("_g", "_o")


def drift(fresh: DataFrame, old: DataFrame, key: list[str], value: str, share: float = 0.10) -> DataFrame:
    """Stored figures that moved by more than a share."""
    o = old.select(*key, F.col(value).alias("_old"))
    return fresh.join(o, key).withColumn("stale", F.coalesce(F.abs(F.col(value) - F.col("_old")) > share * F.abs("_old"), F.lit(True)))


def critique(df: DataFrame, key: str, metrics: list[str], share: Mapping[str, float]) -> DataFrame:
    """Contribution and verdict of each metric."""
    rows = df.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(share.get(m, 0.0))).alias("weight")) for m in metrics))).alias("m")).select(key, "m.*")
    return rows.withColumn("contribution", F.round(F.col("value") * F.col("weight"), 4)).withColumn("verdict", F.when(F.col("value") >= 7.5, "strength").when(F.col("value") < 5, "weakness"))


# --- Fixed values: thresholds and sizes of penalties, value bounds of metrics ---------------------------------
LEADING_LINES_BLEND, LINES_SCALE = 0.3, 1.77
VALUE_BOUNDS = {"iso": 1e7, "f_stop": 100.0, "focal": 3000.0}
PORTRAITS, FACE_KINDS, DARK_KINDS = ("portrait", "group_portrait"), ("portrait", "portrait_bw", "group_portrait"), ("night", "astro", "concert")
#: Metrics that count as measured, and the columns that hold them.
PLAIN_METRICS = {
    "face_quality": "face_quality", "face_sharpness": "face_sharpness", "eye_sharpness": "eye_sharpness", "power_point": "power_point_score",
    "exposure": "exposure_score", "contrast": "contrast_score", "aesthetic_iaa": "aesthetic_iaa", "face_quality_iqa": "face_quality_iqa", "liqe": "liqe_score",
    "subject_sharpness": "subject_sharpness", "subject_prominence": "subject_prominence", "subject_placement": "subject_placement", "bg_separation": "bg_separation",
    "symmetry": "form_symmetry", "balance": "form_balance", "edge_entropy": "form_edge_entropy", "fractal": "form_fractal",
}
# -------------------------------------------------------------------------------------------------------------


def metric_vector(raw: Mapping[str, Column], defaults: Mapping[str, float]) -> dict[str, Column]:
    """Every metric that weights may name, from 0 to 10; one that is missing or not finite takes its default."""
    out = {}
    for name, default in defaults.items():
        c = raw.get(name)
        if c is None:
            out[name] = F.lit(float(default))
            continue
        v = c.cast("double")
        out[name] = clamp(F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(float(default)))
    return out


def composition(points: Column, lines: Column) -> Column:
    """Composition with its bonus for leading lines (from 0 to 10)."""
    return F.when(lines > 0, F.least(F.lit(10.0), points + LEADING_LINES_BLEND * lines)).otherwise(points)


def measured_vector(raw: Mapping[str, Column], kind: str, share: Mapping[str, float]) -> dict[str, Column]:
    """The metrics of a photo of category ``kind``, each from 0 to 10 where it is right, from what was measured.

    Sharpness is owed to high ISO, isolation to wide apertures; colour is neutral in monochrome photos; leading lines
    raise the composition of all but portraits; noise counts downwards; the share of a quality that is not measured by
    itself goes to the aesthetic.  What is missing, no number or out of bounds takes its default."""

    def get(name: str, default: float | None) -> Column:
        c = raw.get(name)
        if c is None:
            return F.lit(default).cast("double")
        v = c.cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= F.lit(VALUE_BOUNDS.get(name, 100.0))), v).otherwise(F.lit(default).cast("double"))

    iso, stop = get("iso", None), get("f_stop", None)
    sharp = get("tech_sharpness", 5.0)
    isolation = get("isolation_bonus", 1.0)
    wide = F.least(F.lit(3.0), isolation * F.when(stop <= 2.0, 1.5).otherwise(1.3))
    isolation = F.when((stop != 0) & (stop <= 2.8), wide).otherwise(isolation)
    lines = F.least(F.lit(10.0), get("leading_lines_score", 0.0) * LINES_SCALE)
    mono = F.coalesce(raw["is_monochrome"].cast("int"), F.lit(0)) != 0 if "is_monochrome" in raw else F.lit(False)
    extra = share.get("quality", 0.0) / max(share.get("aesthetic", 0.0), 0.01) if share.get("aesthetic", 0.0) > 0 else 0.0
    plain = {name: get(source, 5.0) for name, source in PLAIN_METRICS.items()}
    return plain | {
        "aesthetic": get("aesthetic", 5.0) + extra,
        "tech_sharpness": F.when(iso > 800, F.least(F.lit(10.0), sharp + 0.5 * F.log2(iso / 800))).otherwise(sharp),
        "composition": get("comp_score", 5.0) if kind in PORTRAITS else composition(get("comp_score", 5.0), lines),
        "leading_lines": lines,
        "color": F.when(mono, 5.0).otherwise(get("color_score", 5.0)),
        "color_harmony": F.when(mono, 5.0).otherwise(get("color_harmony", 5.0)),
        "dynamic_range": F.least(F.lit(10.0), get("histogram_spread", 0.0) / 6.0),
        "saturation": F.least(F.lit(10.0), get("mean_saturation", 0.5) * 10.0),
        "noise": clamp(10.0 - get("noise_sigma", 0.0) * 0.7),
        "isolation": F.least(F.lit(10.0), (isolation - 1.0) * 5.0),
    }


def category_score(raw: Mapping[str, Column], kind: str, share: Mapping[str, float], flags: Mapping[str, float] | None = None) -> Column:
    """The aggregate of a photo of one category: weighted metrics, halved for shut eyes in portraits, less penalties.

    ``flags`` may name bonus, noise_tolerance, clipping (factors), and blink, skip_clipping, skip_oversaturation."""
    f = dict(flags or {})
    zero = lambda n: F.coalesce(raw[n].cast("double"), F.lit(0.0)) if n in raw else F.lit(0.0)
    metrics = measured_vector(raw, kind, share)
    score = reduce(lambda a, b: a + b, (F.greatest(F.lit(0.0), F.least(F.lit(10.0), metrics[m])) * F.lit(float(w)) for m, w in share.items() if w > 0 and m in metrics), F.lit(0.0))
    if f.get("blink", kind in FACE_KINDS):
        score = F.when(zero("is_blink") != 0, score * 0.5).otherwise(score)
    score = score + f.get("bonus", 0.0)
    if not f.get("skip_clipping", kind == "silhouette"):
        clipped = F.when(zero("is_silhouette") != 0, 0.0).otherwise(zero("shadow_clipped") * 0.5 + zero("highlight_clipped"))
        score = score - clipped * f.get("clipping", 1.5 if kind == "default" else 1.0)
    score = score - F.greatest(F.lit(0.0), F.least(F.lit(1.5), (zero("noise_sigma") - 4.0) * 0.3)) * f.get("noise_tolerance", 1.0)
    score = score - F.when(zero("histogram_bimodality") > 2.5, 0.5).otherwise(0.0)
    if not f.get("skip_oversaturation", kind in DARK_KINDS):
        score = score - F.when(zero("mean_saturation") > 0.9, 0.5).otherwise(0.0)
    return clamp(score)


def rescored(df: DataFrame, key: str, kind: str, raw: Mapping[str, Column], share: Mapping[str, Mapping[str, float]], flags: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """(key, category, aggregate, exposure_score) of rows whose category stands in ``kind``, in one projection."""
    score = category_score(raw, "default", share["default"], (flags or {}).get("default"))
    for name in share:
        if name != "default":
            score = F.when(F.col(kind) == name, category_score(raw, name, share[name], (flags or {}).get(name))).otherwise(score)
    return df.select(key, F.col(kind).alias("category"), F.round(score, 4).alias("aggregate"), F.round(raw["exposure_score"], 4).alias("exposure_score"))


def recomputed(df: DataFrame, key: str, rules: Mapping[str, Column], priority: tuple[str, ...], share: Mapping[str, Mapping[str, float]], metrics: Mapping[str, Column], blink: Column, minus: Column, override: str | None = None) -> DataFrame:
    """The whole chain in one projection: category by priority, that category's weights, aggregate."""
    kind = category(rules, promote=priority, override=override)
    rows = df.withColumn("_kind", kind)
    score = F.lit(None).cast("double")
    for name, percent in share.items():
        score = F.when(F.col("_kind") == name, aggregate_score(metrics, weights(percent), blink, None, minus)).otherwise(score)
    return rows.withColumn("_score", F.coalesce(score, aggregate_score(metrics, weights(share["default"]), blink, None, minus))).select(key, F.col("_kind").alias("category"), F.round("_score", 4).alias("aggregate"))


def changed(old: DataFrame, new: DataFrame, key: str, least: float = 0.005) -> DataFrame:
    """Rows whose stored aggregate or category the new figures would change."""
    o = old.select(key, F.col("category").alias("_c"), F.col("aggregate").alias("_a"))
    moved = ~F.col("category").eqNullSafe(F.col("_c")) | F.coalesce(F.abs(F.col("aggregate") - F.col("_a")) >= least, F.lit(True))
    return new.join(o, key).where(moved).select(*new.columns)


def suggested_bounds(df: DataFrame, group: str, metrics: list[str], low: int = 10, high: int = 90, least: int = 20) -> DataFrame:
    """Ranges that hold the middle of each category's metrics, as rules to start from: (group, metric, low, high), by
    the nearest rank; values are counted and dealt by range, so no category is gathered."""
    from lumenfold.operators.stats import nearest_rank

    rows = df.where(F.col(group).isNotNull()).select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m")).select(group, "m.*")
    return nearest_rank(rows, [group, "metric"], "v", [low, high], least).select(group, "metric", F.col(f"p{low}").alias("low"), F.col(f"p{high}").alias("high"))
