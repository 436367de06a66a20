"""Culling feeds: leads, groups of bursts, brackets, panoramas, duplicates and scenes, reasons, needs and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.similarity import hashes_within
from lumenfold.operators.windows import value_positions

# --- Fixed values: weights of the lead choice and of burst scores, gaps of reject reasons, targets ----------
LEAD_EYES, LEAD_EXPRESSION, LEAD_SHARPNESS, LEAD_LEARNED = 0.03, 0.015, 0.01, 0.05
BURST_SHARES = {"aggregate": 0.4, "aesthetic": 0.25, "sharpness": 0.2, "open_eyes": 0.15}
COMPARISONS_WANTED = 30
EYES_CLOSED_MOST, EXPRESSION_LEAST = 4.0, 4.0
SHARPNESS_GAP, EXPRESSION_GAP, AESTHETIC_GAP, AGGREGATE_GAP = 1.0, 1.0, 0.5, 0.3
DUPLICATE_BITS, DUPLICATE_COSINE, DUPLICATE_STRICT_BITS = 12, 0.90, 6
# -------------------------------------------------------------------------------------------------------------


def lead_score(aggregate: str, faces: str, eyes: str, expression: str, sharpness: str, learned: str | None = None) -> Column:
    """The aggregate, moved a little by eyes and expression where there are faces, by sharpness and by what was learnt;
    a missing part moves nothing."""

    def part(c: str, weight: float) -> Column:
        return F.coalesce((F.col(c) - 5) * weight, F.lit(0.0))

    face = F.when(F.coalesce(F.col(faces), F.lit(0)) > 0, part(eyes, LEAD_EYES) + part(expression, LEAD_EXPRESSION)).otherwise(0.0)
    out = F.coalesce(F.col(aggregate), F.lit(0.0)) + face + part(sharpness, LEAD_SHARPNESS)
    return out + part(learned, LEAD_LEARNED) if learned else out


def leads(df: DataFrame, group: str, score: Column, key: str) -> DataFrame:
    """Each group's lead: the best score, ties by key.  A partial aggregate: no group is gathered or sorted."""
    rows = df.where(F.col(group).isNotNull()).select(group, key, F.round(score, 6).alias("_s"))
    return rows.groupBy(group).agg(F.min_by(key, F.struct(-F.col("_s"), F.col(key))).alias("lead"), F.count("*").alias("n"))


def groups_of(edges: DataFrame, components, rows: DataFrame, key: str, score: Column, least: int = 2, most: int | None = None) -> DataFrame:
    """Components of ``edges`` (a, b) as groups: a number from 1 in order of their smallest member, size and lead."""
    member = components(edges.select("a", "b")).select(F.col("node").alias(key), F.col("component").alias("root"))
    group = leads(member.join(rows, key), "root", score, key).where(F.col("n") >= least)
    if most:
        group = group.where(F.col("n") <= most)
    number = value_positions(group.select("root"), [], "root").select("root", (F.col("_below") + 1).alias("number"))  # dealt by range
    return member.join(group, "root").join(number, "root")


def duplicate_edges(df: DataFrame, key: str, phash: str, vector: str) -> DataFrame:
    """Pairs whose hashes differ in at most 12 bits and whose vectors are close; 6 bits where one has no vector.

    Bits are counted in tiles of two blocks, and there only pairs within 12 bits are held against their vectors."""
    return hashes_within(df, key, phash, DUPLICATE_BITS, vector=vector, least=DUPLICATE_COSINE, strict=DUPLICATE_STRICT_BITS)


def threshold_report(pairs: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of each threshold; 0 where a denominator is."""
    cut = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    rows = pairs.select(cut, F.col(score).alias("s"), (F.col(label) == 1).alias("y"))
    hit = F.col("s") >= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    return out.select("threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(zero(F.try_divide(2 * p * r, p + r)), 6).alias("f1"))


def bracket_leads(df: DataFrame, burst: str, key: str) -> DataFrame:
    """Bursts all of whose members are of one bracket take its base as lead; others keep theirs."""
    whole = df.where(F.col(burst).isNotNull()).groupBy(burst).agg(
        F.count_distinct("sequence").alias("sets"),
        F.count_if(F.coalesce(F.col("sequence_kind") != "bracket", F.lit(True))).alias("outside"),
        F.min(F.when(F.col("ev_offset") == 0, F.col(key))).alias("base"),
        F.min(F.when(F.col("burst_lead") == 1, F.col(key))).alias("own"),
    )
    return whole.select(burst, F.when((F.col("sets") == 1) & (F.col("outside") == 0) & F.col("base").isNotNull(), F.col("base")).otherwise(F.col("own")).alias("lead"))


def reconciled(sets: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Detected sets (set, key) after a user's overrides (key, kind, forced_set): a suppressed member drops its whole
    set, and so does a member that a forced set claims; forced sets stand beside the rest."""
    claimed = overrides.select(key).distinct()
    dropped = sets.join(claimed, key, "left_semi").select("set").distinct()
    forced = overrides.where(F.col("kind").isNotNull()).select(F.col("forced_set").alias("set"), key)
    return sets.join(dropped, "set", "left_anti").select("set", key, F.lit(False).alias("forced")).unionByName(forced.select("set", key, F.lit(True).alias("forced")))


def stale_runs(df: DataFrame, run: str, scanned: str, measured: DataFrame, mark: str, settings: str) -> DataFrame:
    """Runs to measure again: a member was scanned after the run's mark, or never; the run has no mark; or it was
    measured under other settings."""
    newest = df.groupBy(run).agg(F.max(scanned).alias("newest"), F.bool_or(F.col(scanned).isNull()).alias("unknown"))
    m = measured.select(run, F.col(mark).alias("_mark"), F.col("settings").alias("_settings"))
    joined = newest.join(m, run, "left")
    stale = F.col("unknown") | F.col("_mark").isNull() | (F.col("newest") > F.col("_mark")) | (F.col("_settings") != settings)
    return joined.select(run, F.coalesce(stale, F.lit(True)).alias("stale"))


def burst_feed(df: DataFrame, group: str, key: str, reviewed: DataFrame, offset: int, limit: int, window: Column | None = None) -> DataFrame:
    """A page of groups of two or more that nobody has reviewed, all their members in time order with the seconds since
    the one before.  A window chooses groups, and does not cut their members."""
    chosen = df if window is None else df.where(window)
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).where("n >= 2")
    ids = sizes.join(chosen.select(group).distinct(), group, "left_semi").join(reviewed.select(group).distinct(), group, "left_anti")
    ids = ids.orderBy(group).offset(offset).limit(limit)
    w, micros = Window.partitionBy(group).orderBy("taken", key), F.unix_micros(F.col("taken").cast("timestamp"))
    delta = F.round((micros - F.lag(micros).over(w)) / 1e6, 3)
    return df.join(ids, group).select(group, key, "n", F.coalesce(delta, F.lit(0.0)).alias("delta_s"))


def burst_score(aggregate: str, aesthetic: str, sharpness: str, blink: str, faces: str | None = None, eyes: str | None = None, expression: str | None = None, eyes_share: float = 0.0, expression_share: float = 0.0) -> Column:
    """Blend of quality and open eyes; where a photo shows faces, eyes and expression join in at their shares."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    s = BURST_SHARES
    out = s["aggregate"] * z(aggregate) + s["aesthetic"] * z(aesthetic) + s["sharpness"] * z(sharpness) + s["open_eyes"] * F.when(F.coalesce(F.col(blink), F.lit(0)) == 1, 0.0).otherwise(10.0)
    for c, share in ((eyes, eyes_share), (expression, expression_share)):
        if c and faces:
            out = out + F.when(F.coalesce(F.col(faces), F.lit(0)) > 0, z(c) * share).otherwise(0.0)
    return out


def reject_reason(best: str = "best_") -> Column:
    """Why a row loses to its group's best, by the first rule that holds."""
    behind = lambda c, gap: F.round(F.col(f"{best}{c}") - F.col(c), 6) >= gap
    face = F.coalesce(F.col("faces"), F.lit(0)) > 0
    return (
        F.when((F.coalesce(F.col("blink"), F.lit(0)) == 1) | (face & (F.col("eyes") <= EYES_CLOSED_MOST)), "eyes_closed")
        .when(behind("sharpness", SHARPNESS_GAP), "soft")
        .when(face & (F.col("expression") < EXPRESSION_LEAST) & behind("expression", EXPRESSION_GAP), "expression")
        .when(behind("aesthetic", AESTHETIC_GAP), "lower_aesthetic")
        .when(behind("aggregate", AGGREGATE_GAP), "lower_overall")
        .otherwise("near_duplicate")
    )


def with_best(df: DataFrame, group: str, score: Column, key: str, columns: list[str]) -> DataFrame:
    """Each member beside its group's best, which a partial aggregate chooses; the best has reason null."""
    rows = df.where(F.col(group).isNotNull()).withColumn("_s", F.round(score, 6))
    best = rows.groupBy(group).agg(F.min_by(F.struct(key, *columns), F.struct(-F.col("_s"), F.col(key))).alias("_b"))
    out = rows.join(best, group)
    return out.select(*rows.columns, *(F.col(f"_b.{c}").alias(f"best_{c}") for c in [key, *columns])).drop("_s")


def dominant_category(df: DataFrame, group: str, score: Column, key: str, category: str) -> DataFrame:
    """The category of a group's best, or where it has none the most frequent one."""
    rows = df.where(F.col(group).isNotNull()).select(group, key, category, F.round(score, 6).alias("_s"))
    best = rows.groupBy(group).agg(F.min_by(category, F.struct(-F.col("_s"), F.col(key))).alias("own"))
    counted = rows.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("c"))
    mode = counted.groupBy(group).agg(F.min_by(category, F.struct(-F.col("c"), F.col(category))).alias("mode"))
    return best.join(mode, group, "left").select(group, F.coalesce("own", "mode").alias("category"))


def bracket_feed(df: DataFrame, key: str) -> DataFrame:
    """Brackets with their base first; the others are redundant if the base is known not to clip."""
    rows = df.where(F.col("sequence_kind") == "bracket")
    base = rows.groupBy("sequence").agg(F.min(F.when(F.col("ev_offset") == 0, F.struct(key, "clipped"))).alias("_base"))
    w = Window.partitionBy("sequence").orderBy(F.abs("ev_offset"), "ev_offset", key)
    redundant = (F.col("ev_offset") != 0) & F.coalesce(F.col("_base.clipped") == 0, F.lit(False))
    return rows.join(base, "sequence").select("sequence", key, F.row_number().over(w).alias("place"), redundant.alias("redundant"))


def panorama_feed(df: DataFrame, key: str) -> DataFrame:
    """Panoramas in capture order; the middle frame leads."""
    rows = df.where(F.col("sequence_kind") == "panorama")
    sizes = rows.groupBy("sequence").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("sequence").orderBy("taken", key))
    out = rows.join(sizes, "sequence").withColumn("place", place)
    return out.select("sequence", key, "place", (F.col("place") == F.floor(F.col("_n") / 2) + 1).alias("lead"))


def similar_feed(df: DataFrame, group: str, score: Column, key: str, seed: str, offset: int, limit: int) -> DataFrame:
    """Groups of which two members at least are not rejected, shuffled by a seed: id, size and best of each."""
    shown = leads(df.where(F.coalesce(F.col("rejected"), F.lit(0)) == 0), group, score, key).where("n >= 2")
    return shown.orderBy(F.md5(F.concat(F.lit(seed), F.col(group).cast("string"))), group).offset(offset).limit(limit)


def better_sibling(group: str, score: str) -> Column:
    """Whether a member of the same group has a better score."""
    return F.coalesce(F.max(score).over(Window.partitionBy(group)) > F.col(score), F.lit(False)) & F.col(group).isNotNull()


def comparison_needs(df: DataFrame, votes: DataFrame, category: str, wanted: int = COMPARISONS_WANTED) -> DataFrame:
    """Comparisons that a category still lacks."""
    have = votes.groupBy(category).agg(F.count("*").alias("have"))
    every = df.where(F.col(category).isNotNull()).select(category).distinct()
    return every.join(have, category, "left").select(category, F.coalesce("have", F.lit(0)).alias("have"), F.greatest(F.lit(0), F.lit(wanted) - F.coalesce("have", F.lit(0))).cast("long").alias("needed"))


def feed_order(groups: DataFrame, kind: str, key: str) -> list[Column]:
    """Orders of a feed of groups (n, best, second, newest, oldest, needed)."""
    orders = {
        "redundant": [F.col("n").desc()],
        "best": [F.col("best").desc_nulls_last()],
        "recent": [F.col("newest").desc_nulls_last()],
        "chronological": [F.col("oldest").asc_nulls_last()],
        "needs_comparisons": [F.col("needed").desc()],
        "easiest": [F.round(F.col("best") - F.col("second"), 6).desc_nulls_last()],
    }
    return [*orders.get(kind, orders["redundant"]), F.col(key)]


def group_features(df: DataFrame, group: str, score: str) -> DataFrame:
    """What feeds are ordered by.  The second best is the best of the rows but one that has the best score."""
    rows = df.where(F.col(group).isNotNull())
    about = rows.groupBy(group).agg(F.count("*").alias("n"), F.max(score).alias("best"), F.max("taken").alias("newest"), F.min("taken").alias("oldest"))
    joined = rows.select(group, score).join(about.select(group, "best"), group)
    second = joined.groupBy(group).agg(F.max(F.when(F.col(score) < F.col("best"), F.col(score))).alias("below"), F.count_if(F.col(score) == F.col("best")).alias("top"))
    return about.join(second, group).withColumn("second", F.when(F.col("top") > 1, F.col("best")).otherwise(F.col("below"))).drop("below", "top")


def evidence(df: DataFrame, category: str, moment: str) -> DataFrame:
    """Photos of each category and moment, with how many have faces, blink or are black and white."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.where(F.col(category).isNotNull()).groupBy(category, moment).agg(F.count("*").alias("n"), F.count_if(flag("faces") > 0).alias("with_faces"), F.count_if(flag("blink") == 1).alias("blinks"), F.count_if(flag("mono") == 1).alias("mono"))


def profile_suggestion(evidence: DataFrame, profiles: DataFrame, category: str, moment: str, least: float) -> DataFrame:
    """The best of ``profiles`` (profile, label, weight: 1 for telling labels, .5 for supporting ones) for the shoot;
    no profile below a share of the photos.  Ties go to the smaller name."""
    labels = evidence.select(F.col(category).alias("label"), "n").unionByName(evidence.select(F.col(moment).alias("label"), "n"))
    score = labels.join(profiles, "label").groupBy("profile").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    best = score.agg(F.min_by(F.struct("profile", "score"), F.struct(-F.col("score"), F.col("profile"))).alias("b"))
    total = evidence.agg(F.sum("n").alias("photos"))
    confidence = F.least(F.lit(1.0), F.col("b.score") / F.col("photos"))
    return best.crossJoin(total).select(F.when(confidence >= least, F.col("b.profile")).alias("profile"), F.round(confidence, 6).alias("confidence"))
