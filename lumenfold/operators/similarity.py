"""Vector similarity and text search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import exprs
from lumenfold.operators.tiles import BLOCK, Block, Rows, element_kind, grown, merged, near, packed_blocks, tiles
from lumenfold.sources.tables import checkpointed, workers_import


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def unit(vector: str, out: str = "unit") -> Column:
    """The vector in double precision and of length 1; null where it has none."""
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    size = F.sqrt(_dot(v, v))
    return F.when(size > 0, F.transform(v, lambda e: e / size)).alias(out)



def knn(df: DataFrame, key: str, vector: str, query: list[float], k: int, least: float = -1.0) -> DataFrame:
    """The k nearest rows by cosine.  Filters apply before, so nothing is fetched in excess."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return df.select(key, F.round(exprs.cosine(F.col(vector), q), 6).alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), key).limit(k)


def packed_units(df: DataFrame, key: str, vector: str, carry: str | None = None) -> DataFrame:
    """Rows (_k, _c, unit): key, a carried column as bigint or text, and the vector of length 1 as the bytes of its doubles.

    Rows without a key or a carried value, without a vector, with a zero one or with nulls or non-finite numbers in it
    are left out.  Numpy normalises whole Arrow batches; bytes travel instead of lists."""
    workers_import(df.sparkSession)
    kind = df.schema[carry].dataType.simpleString() if carry else "string"
    rows = df.select(F.col(key).cast("long").alias("_k"), (F.col(carry) if carry else F.lit("")).cast("bigint" if kind in ("int", "bigint") else "string").alias("_c"), F.col(vector).cast("array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            at = lists.offsets.to_numpy()
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), float)  # null numbers are nan here
            sizes, out = np.diff(at), np.full(len(lists), None, object)
            for d in np.unique(sizes[sizes > 0]):
                own = np.flatnonzero(sizes == d)
                v = flat[at[own][:, None] + np.arange(d)]
                with np.errstate(invalid="ignore", over="ignore"):
                    norm = np.sqrt((v * v).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                for i, u in zip(own[good], v[good] / norm[good][:, None], strict=True):
                    out[i] = u.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_c"), pa.array(out, pa.binary())], ["_k", "_c", "unit"])

    kind = "bigint" if kind in ("int", "bigint") else "string"
    return rows.where("_k is not null and _c is not null and v is not null").mapInArrow(pack, f"_k bigint, _c {kind}, unit binary").where("unit is not null")


def unpacked(units) -> np.ndarray:
    """The vectors of ``packed_units`` (of one length) as rows."""
    units = list(units)
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1) if units else np.empty((0, 0))


def pairs_above(df: DataFrame, key: str, vector: str, threshold: float, group: str | None = None, block: int = BLOCK, apart: str | None = None) -> DataFrame:
    """All pairs a < b with cosine of at least ``threshold``, inside each ``group`` if one is named, and only those that
    differ in an integer ``apart`` if one is named.

    Rows are dealt into blocks, whatever their group's size, so a hot group is many tiles; a tile is one numpy product of
    two blocks, and its memory has a bound.  Ids alone travel on."""
    blocks = packed_blocks(df, key, vector, block, group, apart)

    def make():
        def met(x: Block, y: Block) -> Iterator[pa.RecordBatch]:
            for i, j, score in near(x, y, threshold):
                a, b = x.keys[i], y.keys[j]
                keep = a != b if apart is None else (a != b) & (x.carried[i] != y.carried[j])
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(score[keep])], names=["a", "b", "score"])

        return met, lambda: iter(())

    return tiles(blocks, element_kind(df, vector), make, "a bigint, b bigint, score double")


def linked_above(df: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, n, least, most, total): links a - b (or a row by itself) that join what the pairs of ``pairs_above`` join, and
    for each a the number, least, largest and total score of some of its pairs; each pair counts once in all.

    A task hands on one row for each of its rows, however many pairs those make."""
    blocks = packed_blocks(df, key, vector, block)

    def make():
        rows, label, n, least, most, total = Rows(), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0)

        def met(x: Block, y: Block) -> Iterator[pa.RecordBatch]:
            nonlocal label, n, least, most, total
            first, second = rows.at(x), rows.at(y)
            size = len(rows.keys)
            label = np.concatenate([label, np.arange(len(label), size)])
            n, least, most, total = grown(n, size, 0), grown(least, size, np.inf), grown(most, size, -np.inf), grown(total, size, 0.0)
            for i, j, score in near(x, y, threshold):
                if len(i):
                    n[first] += np.bincount(i, minlength=len(x.keys))
                    total[first] += np.bincount(i, weights=score, minlength=len(x.keys))
                    np.minimum.at(least, first.start + i, score)
                    np.maximum.at(most, first.start + i, score)
                    label = merged(label, first.start + i, second.start + j)
            yield from ()

        def done() -> Iterator[pa.RecordBatch]:
            told = np.flatnonzero((n > 0) | (label != np.arange(len(label))))
            columns = [rows.keys[told], rows.keys[label[told]], n[told], least[told], most[told], total[told]]
            if len(told):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "n", "least", "most", "total"])

        return met, done

    return checkpointed(tiles(blocks, element_kind(df, vector), make, "a bigint, b bigint, n bigint, least double, most double, total double"))


def hashes_within(df: DataFrame, key: str, phash: str, most: int, block: int = BLOCK, vector: str | None = None, least: float = 0.0, strict: int = 0) -> DataFrame:
    """All pairs a < b whose 64-bit hashes differ in at most ``most`` bits, with the number of bits.

    With a ``vector``, pairs that both have one also need a cosine of at least ``least``, and others differ in at most
    ``strict`` bits.  A tile counts bits of whole rows of it at once, so a pair that is too far never becomes a row."""
    if vector is None:
        df, vector = df.select(key, phash, F.array().cast("array<float>").alias("_none")), "_none"
    blocks = packed_blocks(df, key, vector, block, number=phash, every=True)
    gated = vector != "_none"

    def make():
        def met(x: Block, y: Block) -> Iterator[pa.RecordBatch]:
            h, g = x.carried.view(np.uint64), y.carried.view(np.uint64)
            for at in range(0, len(h), 128):
                bits = np.bitwise_count(h[at : at + 128, None] ^ g[None, :])
                i, j = np.nonzero(bits <= most)
                far, i = bits[i, j].astype(np.int32), i + at
                keep = j > i if x is y else np.ones(len(i), bool)
                if gated and x.length and x.length == y.length:
                    keep &= ~(np.einsum("ij,ij->i", x.unit[i], y.unit[j]) < least)  # as in SQL, no number counts as large
                elif gated:
                    keep &= far <= strict
                a, b = x.keys[i], y.keys[j]
                keep &= a != b
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(far[keep])], names=["a", "b", "bits"])

        return met, lambda: iter(())

    return tiles(blocks, element_kind(df, vector), make, "a bigint, b bigint, bits int", one_length=False)


def duplicate_gate(a_hash: Column, b_hash: Column, cosine: Column) -> Column:
    """Loose on the hash with a close vector, strict without vectors."""
    d = exprs.hamming(a_hash, b_hash)
    return F.when(cosine.isNotNull(), (d <= 12) & (cosine >= 0.90)).otherwise(d <= 6)


def visual_blend(hash_distance: Column, cosine: Column) -> Column:
    return 0.7 * (1 - hash_distance / 64) + 0.3 * F.greatest(F.lit(0.0), cosine)


def histogram_intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, e: s + e)


def colour_score(a: Column, b: Column, sat: tuple[Column, Column], lum: tuple[Column, Column], mono: tuple[Column, Column]) -> Column:
    return 0.7 * histogram_intersection(a, b) + 0.1 * (1 - F.abs(sat[0] - sat[1])) + 0.1 * (1 - F.abs(lum[0] - lum[1])) + 0.1 * (mono[0] == mono[1]).cast("double")


def tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def bm25(df: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over the whole table for a few terms (keys are unique); only counts are aggregated."""
    words = df.select(key, F.explode_outer(tokens(text)).alias("t"))  # each text is split once; counts combine before they travel
    rows = words.groupBy(key).agg(F.count("t").alias("n"), *(F.count_if(F.col("t") == q).alias(f"tf{i}") for i, q in enumerate(query)))
    about = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    score = F.lit(0.0)
    for i in range(len(query)):
        tf, d = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.ln(1 + (F.col("docs") - d + 0.5) / (d + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.lit(False)
    for i in range(len(query)):
        hit = hit | (F.col(f"tf{i}") > 0)
    return rows.crossJoin(F.broadcast(about)).where(hit).select(key, score.alias("score"))


def min_max(df: DataFrame, score: str, out: str) -> DataFrame:
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.coalesce(F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0))).drop("lo", "hi")


def hybrid(vectors: DataFrame, texts: DataFrame, key: str, k: int) -> DataFrame:
    """Blend of two rankings over the union of their hits; a missing one counts 0."""
    v, t = vectors.select(key, F.col("score").alias("v")), min_max(texts, "score", "t").select(key, "t")
    return v.join(t, key, "full").select(key, F.round(0.7 * F.coalesce("v", F.lit(0.0)) + 0.3 * F.coalesce("t", F.lit(0.0)), 6).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def against_all(df: DataFrame, given: DataFrame, key: str, at_once: int = 10_000) -> DataFrame:
    """Each row beside every row of a small given table, which is broadcast in slices of about ``at_once`` rows by a
    hash of its ``key``; a larger table takes more slices, so what is broadcast has a bound."""
    slices = max(1, -(-given.count() // at_once))
    parts = (given.where(F.pmod(F.xxhash64(key), F.lit(slices)) == i) if slices > 1 else given for i in range(slices))
    return reduce(DataFrame.unionAll, (df.join(F.broadcast(part), F.lit(True)) for part in parts))


def zero_shot(df: DataFrame, key: str, vector: str, prompts: DataFrame, pool: str = "max") -> DataFrame:
    """Pooled cosine of each row with the prompts (label, prompt) of each label; prompts are a small given table."""
    scored = against_all(df.select(key, vector), prompts, "prompt").select(key, "label", exprs.cosine(vector, "prompt").alias("s"))
    return scored.groupBy(key, "label").agg((F.max("s") if pool == "max" else F.avg("s")).alias("score"))


def top_labels(scored: DataFrame, key: str, least: float, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "label")
    return scored.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def contrast_classify(scored: DataFrame, key: str, contrast: str, least: float, margin: float) -> DataFrame:
    """The best label if it is confident and beats the contrast label by a margin; else the contrast."""
    best = scored.groupBy(key).agg(F.max_by("label", F.when(F.col("label") != contrast, F.col("score"))).alias("best"), F.max(F.when(F.col("label") != contrast, F.col("score"))).alias("top"), F.max(F.when(F.col("label") == contrast, F.col("score"))).alias("other"))
    return best.select(key, F.when(F.col("top").isNull(), None).when((F.col("top") >= least) & (F.col("top") - F.coalesce("other", F.lit(-1.0)) >= margin), F.col("best")).otherwise(contrast).alias("label"))


def axis_score(vector: str, axis: list[float]) -> Column:
    c = exprs.cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in axis)))
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)) + 1) * 5


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Renormalised means of unit vectors."""
    parts = df.select(group, F.posexplode(unit(vector))).groupBy(group, "pos").agg(F.avg("col").alias("m"))
    mean = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select(group, F.transform("s", lambda x: x.m).alias("mean"))
    return mean.select(group, unit("mean", "centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centres: DataFrame, group: str, least: float) -> DataFrame:
    """The closest of a small table of centroids, if it is close enough."""
    s = against_all(df.select(key, vector), centres, group).select(key, group, exprs.cosine(vector, "centroid").alias("score"))
    return s.groupBy(key).agg(F.min_by(group, F.struct(-F.col("score"), F.col(group))).alias(group), F.max("score").alias("score")).where(F.col("score") >= least)


def person_similar(faces: DataFrame, photos: DataFrame, photo: int, key: str, vector: str, least: float, k: int) -> DataFrame:
    """Photos that share a person with a given one score 1, newest first; where it shows nobody known, photos score by
    the closest pair of faces."""
    own = faces.where(F.col(key) == photo)
    people = own.where(F.col("person").isNotNull()).select("person").distinct()
    if not people.isEmpty():
        hit = faces.where(F.col(key) != photo).join(people, "person", "left_semi").select(key).distinct()
        return photos.join(hit, key, "left_semi").select(key, F.lit(1.0).alias("score"), "taken").orderBy(F.col("taken").desc(), key).limit(k).select(key, "score")
    mine = own.select(F.col(vector).alias("_own"))  # all faces of one photo
    scored = against_all(faces.where(F.col(key) != photo), mine, "_own").select(key, exprs.cosine(F.col(vector), F.col("_own")).alias("s")).groupBy(key).agg(F.round(F.max("s"), 6).alias("score"))
    return scored.where(F.col("score") >= least).orderBy(F.col("score").desc(), key).limit(k)


def distortions(scored: DataFrame, key: str, temperature: float, least: float, k: int) -> DataFrame:
    """Attributes from cosines with opposite prompts (key, attribute, positive, negative): a sigmoid of their
    difference; the k most likely above a threshold."""
    p = F.round(1 / (1 + F.exp(-(F.col("positive") - F.col("negative")) / temperature)), 6)
    rows = scored.select(key, "attribute", p.alias("p")).where(F.col("p") >= least)
    w = Window.partitionBy(key).orderBy(F.col("p").desc(), "attribute")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_groups(links: DataFrame, components) -> DataFrame:
    """Groups of people to merge: members, and the least, largest and mean score of the direct edges alone.
    ``links`` are those of ``linked_above``, whose edges are counted where they were found."""
    member = components(links.select("a", "b")).select("node", "component")
    size = member.groupBy("component").agg(F.count("*").alias("members"))
    inside = links.where("n > 0").join(member.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.sum("n").alias("edges"), F.round(F.min("least"), 6).alias("least"), F.round(F.max("most"), 6).alias("most"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))
    return size.join(inside, "component")


def without_rejected(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Suggested pairs less those that somebody has turned down, in either order."""
    no = rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(no, ["a", "b"], "left_anti")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """An inverted index to be stored: term, key, occurrences, and the text's number of terms."""
    words = df.select(key, F.explode(tokens(text)).alias("term"))
    sizes = words.groupBy(key).agg(F.count("*").alias("size"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf")).join(sizes, key).select("term", key, "tf", "size")
