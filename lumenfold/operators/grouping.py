"""Ordered grouping: sessions, scenes, bursts, brackets, panoramas, journeys, components, smoothing."""

from __future__ import annotations

import itertools
import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import exprs
from lumenfold.sources.tables import checkpointed, workers_import


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def gap_sessions(df: DataFrame, by: list[str], ts: str, tie: str, gap_s: float, out: str = "session") -> DataFrame:
    """Rows of a key belong together while gaps stay within ``gap_s``; sessions number from 0 by time."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    new = (seconds(ts) - F.lag(seconds(ts)).over(w) > gap_s).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn(out, F.sum("_new").over(w)).drop("_new")


def adaptive_gap(df: DataFrame, by: list[str], ts: str, floor_s: float = 1200.0, times: float = 6.0) -> DataFrame:
    """Per key: the larger of a floor and a multiple of the upper median of positive gaps."""
    w = Window.partitionBy(*by).orderBy(ts)
    gaps = df.select(*by, (seconds(ts) - F.lag(seconds(ts)).over(w)).alias("gap")).where("gap > 0")
    g = Window.partitionBy(*by)
    ranked = gaps.withColumn("rn", F.row_number().over(g.orderBy("gap"))).withColumn("n", F.count("*").over(g))
    return ranked.where(F.expr("rn = n div 2 + 1")).select(*by, F.greatest(F.lit(floor_s), F.col("gap") * times).alias("gap_s"))


def scenes(df: DataFrame, by: list[str], ts: str, tie: str, score: str, least: int = 2) -> DataFrame:
    """Gap-split groups with an adaptive gap: size, bounds and best member."""
    rows = df.join(adaptive_gap(df, by, ts), by, "left")
    w = Window.partitionBy(*by).orderBy(ts, tie)
    rows = rows.withColumn("_new", F.coalesce((seconds(ts) - F.lag(seconds(ts)).over(w) > F.coalesce("gap_s", F.lit(1200.0))).cast("int"), F.lit(0)))
    rows = rows.withColumn("scene", F.sum("_new").over(w))
    best = F.min_by(tie, F.struct(-F.coalesce(F.col(score), F.lit(-1.0)), F.col(tie)))
    return rows.groupBy(*by, "scene").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"), best.alias("best")).where(F.col("n") >= least)


def bracket_runs(df: DataFrame, by: list[str], ts: str, tie: str, ev: str, gap_s: float = 3.0, step: float = 0.5, spread: float = 0.34, frames: int = 3, span: float = 1.0, phash: str | None = None) -> DataFrame:
    """Exposure brackets: runs of frames close in time whose exposure moves one way in even steps."""
    w = Window.partitionBy(*by).orderBy(ts, tie)
    near = (seconds(ts) - F.lag(seconds(ts)).over(w) <= gap_s) & (F.abs(F.col(ev) - F.lag(ev).over(w)) >= step)
    if phash:
        near = near & (exprs.hamming(F.col(phash), F.lag(phash).over(w)) <= 10)
    rows = df.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    rows = rows.withColumn("_step", F.col(ev) - F.lag(ev).over(Window.partitionBy(*by, "run").orderBy(ts, tie)))
    runs = rows.groupBy(*by, "run").agg(F.count("*").alias("n"), F.min("_step").alias("lo"), F.max("_step").alias("hi"), F.round(F.max(ev) - F.min(ev), 6).alias("span"), F.min(tie).alias("first"), F.max(tie).alias("last"))
    one_way = (F.col("lo") > 0) | (F.col("hi") < 0)
    return runs.where((F.col("n") >= frames) & one_way & (F.col("span") >= span) & (F.col("hi") - F.col("lo") <= spread)).drop("lo", "hi")


def bracket_base(df: DataFrame, group: str, ts: str, tie: str, ev: str, clipped: str | None = None) -> DataFrame:
    """Each frame's offset from its group's base: the middle exposure; of two middles the less clipped, else the earlier."""
    w = Window.partitionBy(group)
    rows = df.withColumn("_rn", F.row_number().over(w.orderBy(ev, tie))).withColumn("_n", F.count("*").over(w))
    middle = rows.where(F.col("_rn").isin(0) | ((F.col("_rn") - 1) == F.expr("_n div 2")) | ((F.expr("_n % 2") == 0) & (F.col("_rn") == F.expr("_n div 2"))))
    order = F.struct(F.coalesce(F.col(clipped), F.lit(0.0)) if clipped else F.lit(0.0), seconds(ts), F.col(tie))
    base = middle.groupBy(group).agg(F.min_by(ev, order).alias("base_ev"), F.min_by(tie, order).alias("base"))
    return df.join(base, group).withColumn("ev_offset", F.col("base_ev") - F.col(ev))


#: No frame before is near; and a run that began before all frames that a bucket can reach.
NONE, OLD = -(1 << 62), -(1 << 61)


def last_near(t: np.ndarray, h: np.ndarray, known: np.ndarray, who: np.ndarray, first: int, window: int, rapid: int, bits: int) -> np.ndarray:
    """For each position from ``first`` on the last one before that is near it, or ``NONE``; times ascend."""
    out, left, reach, steps = np.full(len(t), NONE), np.arange(first, len(t)), max(window, rapid), 16

    def near(p, c) -> np.ndarray:
        dt, far = t[p] - t[c], np.where(known[p] & known[c], np.bitwise_count(h[p] ^ h[c]), exprs.MISSING_HASH_DISTANCE)
        same = (who[p] < 0) | (who[c] < 0) | (who[p] == who[c])
        return (dt <= rapid) & same & (far <= 2 * bits) | (dt <= window) & (far <= bits)

    for d in range(1, steps + 1):
        left = left[left >= d]
        left = left[t[left] - t[left - d] <= reach]
        hit = near(left, left - d)
        out[left[hit]] = left[hit] - d
        left = left[~hit]
    for p in left.tolist():
        least, end, size = int(np.searchsorted(t, t[p] - reach)), p - steps, 64
        while end > least:
            c = np.arange(max(least, end - size), end)
            hit = np.flatnonzero(near(p, c))
            if len(hit):
                out[p] = c[hit[-1]]
                break
            end, size = int(c[0]), 4 * size
    return out


def carried_run(near: list[int]) -> tuple[int, list[int], list[int]]:
    """What a stretch of frames does to the run that reaches it, from each frame's last near one (below 0: before it).

    (m, above, starts): a run that began at m or before goes on to the end; one that began after ``above[k]`` (the largest
    such) has ended, and the last run of the stretch began at ``starts[k]``.  Runs that ended at one frame are one, so each
    frame is put on the stack and taken from it once."""
    m, stack = -1, []
    for k, j in enumerate(near):
        above = None
        while stack and stack[-1][1] > j:
            above = stack.pop()[0]
        if j < m:
            above, m = j, j
        if above is not None:
            stack.append((above, k))
    return m, [x for x, _ in stack], [k for _, k in stack]


def burst_runs(df: DataFrame, ts: str, key: str, phash: str, person: str | None = None, window_s: float = 3600.0, rapid_s: float = 5.0, bits: int = 7) -> DataFrame:
    """Chronological runs: a frame joins if it is near any member of the current run.

    A run is a stretch of frames, so a frame joins if the last frame that is near it is not before the run's first.  Frames
    are dealt by time into buckets of four windows, each with the window before it; there the last near frames are found,
    and what a bucket does to a run that comes in (``carried_run``).  One pass over the buckets, a row each, says which run
    comes into each of them, then buckets number their frames.  A run of any length is many tasks."""
    workers_import(df.sparkSession)
    window, rapid = (round(x * 1e6) for x in (window_s, rapid_s))
    reach = max(window, rapid, 1)
    width = 4 * reach
    rows = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.coalesce(F.col(phash).cast("long"), F.lit(0)).alias("_h"), F.col(phash).isNotNull().alias("_known"), *([F.col(person).alias("_w")] if person else [])).where("_t is not null")
    rows = rows.withColumn("_b", F.expr(f"(_t - pmod(_t, {width}L)) div {width}L"))
    rows = rows.withColumn("_to", F.explode(F.when((F.col("_b") + 1) * width - F.col("_t") <= reach, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))))

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", key], kind="stable")
        first = int((pdf["_b"] < pdf["_to"]).sum())
        if first == len(pdf):
            return pd.DataFrame({c: [] for c in ("_b", "_i", key, "_j", "_n", "_m", "_above", "_starts")}, dtype=object)
        known, h = pdf["_known"].to_numpy(), pdf["_h"].to_numpy().view(np.uint64)  # with nulls pandas would round hashes
        who = pd.factorize(pdf["_w"])[0] if person else np.full(len(pdf), -1)
        near = last_near(pdf["_t"].to_numpy(), h, known, who, first, window, rapid, bits)[first:]
        near[near != NONE] -= first
        m, above, starts = carried_run(near.tolist())
        n = len(near)
        told = lambda x: [x] + [None] * (n - 1)  # noqa: E731  with the bucket's first frame
        return pd.DataFrame({"_b": pdf["_to"].to_numpy()[first:], "_i": np.arange(n), key: pdf[key].to_numpy()[first:], "_j": near, "_n": np.full(n, n), "_m": np.full(n, m), "_above": told(above), "_starts": told(starts)})

    kind = dict(df.dtypes)[key]
    frames = checkpointed(rows.groupBy("_to").applyInPandas(before, f"_b bigint, _i bigint, `{key}` {kind}, _j bigint, _n bigint, _m bigint, _above array<bigint>, _starts array<bigint>"))

    def follow(batches):
        last = size = at = None  # the bucket before, its frames, and where the current run began
        for pdf in batches:
            out = []
            for b, n, m, above, starts in pdf[["_b", "_n", "_m", "_above", "_starts"]].itertuples(index=False):
                at = at or (b, 0)
                came = at[1] - size if last == b - 1 == at[0] else OLD
                out.append((b, came, *at))
                if came > m:
                    at = (b, int(starts[int(np.searchsorted(above, came)) - 1]))
                last, size = b, n
            yield pd.DataFrame(out, columns=["_b", "_came", "_rb", "_ri"])

    ends = frames.where("_i = 0").select("_b", "_n", "_m", "_above", "_starts").repartition(1).sortWithinPartitions("_b")
    coming = checkpointed(ends.mapInPandas(follow, "_b bigint, _came bigint, _rb bigint, _ri bigint"))

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        start, out = int(pdf["_came"].iloc[0]), []
        for k, j in enumerate(pdf["_j"].tolist()):
            if j < start:
                start = k
            out.append(start)
        out = np.asarray(out)
        own = out >= 0
        return pd.DataFrame({key: pdf[key], "_rb": np.where(own, pdf["_b"], pdf["_rb"]), "_ri": np.where(own, out, pdf["_ri"])})

    found = checkpointed(frames.select("_b", "_i", key, "_j").join(coming, "_b").groupBy("_b").applyInPandas(numbered, f"`{key}` {kind}, _rb bigint, _ri bigint"))
    runs = found.groupBy("_rb", "_ri").agg(F.count("*").alias("n"), F.min(key).alias("burst")).where("n >= 2")
    return found.join(runs, ["_rb", "_ri"]).select(key, "burst", "n")


def panorama_candidates(df: DataFrame, by: list[str], ts: str, tie: str, gap_s: float = 30.0, frames: int = 8, most: int = 500) -> DataFrame:
    """Runs of one camera and focal length with short gaps, cut into pieces of at most ``most`` frames."""
    rows = gap_sessions(df, by, ts, tie, gap_s, "run")
    w = Window.partitionBy(*by, "run")
    rows = rows.withColumn("n", F.count("*").over(w)).where(F.col("n") >= frames)
    return rows.withColumn("piece", F.floor((F.row_number().over(w.orderBy(ts, tie)) - 1) / most))


def panorama_segments(steps: DataFrame, by: list[str], order: str, drift: float = 0.43, frames: int = 3) -> DataFrame:
    """Greedy extension along one axis and direction.  ``steps``: shift (dx, dy) of each frame from the one before,
    in frame sizes.  Each run's frames are bounded by the candidates' cut."""

    def segments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        moves, out, k = pdf[["dx", "dy"]].fillna(0).to_numpy(), np.full(len(pdf), -1), 0
        number = 0
        while k < len(pdf) - 1:
            best = (0.0, k)
            for axis in (0, 1):
                for sign in (1, -1):
                    e, total = k, 0.0
                    while e + 1 < len(pdf) and sign * moves[e + 1, axis] > 0 and abs(moves[e + 1, axis]) >= abs(moves[e + 1, 1 - axis]):
                        total += abs(moves[e + 1, axis])
                        e += 1
                    best = max(best, (total, e))
            if best[0] >= drift and best[1] - k + 1 >= frames:
                out[k : best[1] + 1] = number
                number, k = number + 1, best[1] + 1
            else:
                k += 1
        return pdf[[*by, order]].assign(segment=out)

    kinds = dict(steps.dtypes)
    return steps.groupBy(*by).applyInPandas(segments, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, order]) + ", segment bigint")


def journeys(df: DataFrame, by: list[str], ts: str, tie: str, lat: str, lon: str, away_km: float = 50.0, gap_h: float = 24.0, least: int = 8) -> DataFrame:
    """Stretches away from home, the densest tenth-of-a-degree cell."""
    cells = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(*by, F.round(F.col(lat) / 0.1).alias("y"), F.round(F.col(lon) / 0.1).alias("x")).agg(F.count("*").alias("n"))
    home = cells.groupBy(*by).agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("n"), F.col("y"), F.col("x"))).alias("h"))
    rows = df.join(home, by).where(exprs.haversine_km(F.col("h.y") * 0.1, F.col("h.x") * 0.1, lat, lon) >= away_km)
    return gap_sessions(rows, by, ts, tie, gap_h * 3600, "journey").groupBy(*by, "journey").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end")).where(F.col("n") >= least)


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges`` (a, b).

    In each round a node takes the least label among its own, its neighbours' and its label's label, and so does the node
    that it is labelled with, so whole trees of labels move at once and long paths take few rounds.  Each round is
    written to the shared folder, which cuts lineage and survives lost executors."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = checkpointed(edges.where("a <> b").select(F.explode(ends).alias("_e")).select("_e.u", "_e.v").distinct())  # edges are computed once
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        offers = labels.join(near, "node").select(F.explode(F.array("node", "label")).alias("node"), "near").groupBy("node").agg(F.min("near").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        new = checkpointed(labels.join(offers, "node").join(hop, "label").select("node", F.least("label", "near", "hop").alias("label"), (F.least("near", "hop") < F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")


def component_groups(rows: DataFrame, key: str, edges: DataFrame, score: str, least: int = 2, most: int = 50) -> DataFrame:
    """Components of bounded size: id, size and best member."""
    member = components(edges).withColumnRenamed("node", key).join(rows, key)
    return member.groupBy("component").agg(F.count("*").alias("n"), F.min_by(key, F.struct(-F.coalesce(F.col(score), F.lit(-1.0)), F.col(key))).alias("best")).where(F.col("n").between(least, most))


def split_scene(times: np.ndarray, most: int) -> list[np.ndarray]:
    """Recursive split at the largest gap (nearest the middle among equals) until no part exceeds ``most``."""
    if len(times) <= most:
        return [np.arange(len(times))]
    gaps = np.diff(times)
    at = min(np.flatnonzero(gaps == gaps.max()).tolist(), key=lambda k: (abs(k + 1 - len(times) / 2), k)) + 1
    return split_scene(times[:at], most) + [at + part for part in split_scene(times[at:], most)]


def transitions(n: int, stay: float = 0.6, forward: float = 0.3, floor: float = 0.01) -> np.ndarray:
    """Probabilities between labels in their usual order: most stay, some go on to the next one."""
    m = np.full((n, n), floor) + np.eye(n) * stay + np.eye(n, k=1) * forward
    return m / m.sum(1, keepdims=True)


def viterbi(log_p: np.ndarray, log_step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable label path and posteriors of a segment's frames, in log space."""
    n, k = log_p.shape
    if n == 0:
        return np.zeros(0, int), np.zeros((0, k))
    best, back = log_p[0].copy(), np.zeros((n, k), int)
    ahead = [log_p[0].copy()]
    for t in range(1, n):
        score = best[:, None] + log_step
        back[t] = score.argmax(0)
        best = score.max(0) + log_p[t]
        ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + log_step, axis=0) + log_p[t])
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    behind = [np.zeros(k)]
    for t in range(n - 1, 0, -1):
        behind.append(np.logaddexp.reduce(log_step + (log_p[t] + behind[-1])[None, :], axis=1))
    joint = np.stack(ahead) + np.stack(behind[::-1])
    return np.asarray(path[::-1]), np.exp(joint - np.logaddexp.reduce(joint, axis=1, keepdims=True))


def smoothed(chunks: Iterator[tuple[np.ndarray, np.ndarray]], log_step: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, label path and posteriors as ``viterbi`` has them, for a segment that comes in chunks (keys, log_p), last first.

    What the way back needs of a chunk is put aside in a file, beyond 64 MB on the machine's disk; one chunk is held.
    Probabilities are scaled frame by frame, so the sums stay small however long the segment is."""
    step = np.exp(log_step)
    with tempfile.SpooledTemporaryFile(max_size=64 << 20, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as aside:
        best, a, starts = None, None, []
        for keys, log_p in chunks:
            p, back, ahead = np.exp(log_p), np.zeros(log_p.shape, np.int16), np.empty(log_p.shape)
            for t in range(len(log_p)):
                if best is None:
                    best, a = log_p[t], p[t]
                else:
                    score = best[:, None] + log_step
                    back[t] = score.argmax(0)
                    best, a = score.max(0) + log_p[t], (a @ step) * p[t]
                a = a / a.sum()
                ahead[t] = a
            starts.append(aside.tell())
            pickle.dump((keys, p, back, ahead), aside, protocol=pickle.HIGHEST_PROTOCOL)
        at, b = int(best.argmax()), np.ones(len(log_step))
        for start in reversed(starts):
            aside.seek(start)
            keys, p, back, ahead = pickle.load(aside)
            path, behind = np.empty(len(p), int), np.empty(p.shape)
            for t in range(len(p) - 1, -1, -1):
                path[t], behind[t] = at, b
                at, b = int(back[t, at]), step @ (p[t] * b)
                b = b / b.sum()
            joint = ahead * behind
            yield keys, path, joint / joint.sum(1, keepdims=True)


def smooth_moments(df: DataFrame, by: list[str], ts: str, key: str, probabilities: str, labels: list[str], weight: float = 0.5, gap_s: float = 6 * 3600) -> DataFrame:
    """Smoothed label and confidence of each row with probabilities; gaps of more than ``gap_s`` cut segments, each of
    which one task reads in order and batch by batch.  A weight of 0 leaves each frame to itself."""
    workers_import(df.sparkSession)
    log_step = weight * np.log(transitions(len(labels)) + 1e-9)
    cut = gap_sessions(df.where(F.col(probabilities).isNotNull()), by, ts, key, gap_s, "_segment").withColumn("_id", F.to_json(F.struct(*by, "_segment")))
    rows = cut.select("_id", ts, key, probabilities).repartition("_id").sortWithinPartitions("_id", F.col(ts).asc_nulls_last(), F.col(key).asc_nulls_last())

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for pdf in batches:
                if len(pdf):
                    ids, keys = pdf["_id"].to_numpy(), pdf[key].to_numpy()
                    log_p = np.log(np.stack(pdf[probabilities].to_numpy()).astype(float) + 1e-9)
                    cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        yield ids[x], keys[x:y], log_p[x:y]

        for _, segment in itertools.groupby(pieces(), key=lambda piece: piece[0]):
            for keys, path, post in smoothed((piece[1:] for piece in segment), log_step):
                yield pd.DataFrame({key: keys, "moment": [labels[k] for k in path], "confidence": post[np.arange(len(path)), path]})

    return rows.mapInPandas(smooth, f"{key} {dict(df.dtypes)[key]}, moment string, confidence double")


def moment_boundaries(labels: list[str | None], least: int) -> list[int]:
    """Where a new label begins that lasts ``least`` frames, after as many frames of the part before."""
    out, i = [0], 1
    while i < len(labels) and least >= 1 and len(labels) >= 2 * least:
        lasts = 0
        if labels[i] is not None and labels[i] != labels[i - 1]:
            while i + lasts < len(labels) and labels[i + lasts] == labels[i]:
                lasts += 1
        if lasts >= least and i - out[-1] >= least:
            out.append(i)
        i += max(1, lasts) if lasts >= least and out[-1] == i else 1
    return out


def built_scenes(df: DataFrame, by: list[str], ts: str, key: str, score: str, moment: str, confidence: str, least_run: int = 3, most: int = 60, least: int = 2) -> DataFrame:
    """Scenes in order: gaps of time, then lasting changes of moment, then size; number of photos, bounds, best photo, and the
    moment that weighs most with its share.  Each stretch between gaps is one group."""
    workers_import(df.sparkSession)
    rows = df.join(adaptive_gap(df, by, ts), by, "left")
    w = Window.partitionBy(*by).orderBy(ts, key)
    rows = rows.withColumn("_new", F.coalesce((seconds(ts) - F.lag(seconds(ts)).over(w) > F.coalesce("gap_s", F.lit(1200.0))).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(w))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, key], kind="stable").reset_index(drop=True)
        times = pd.to_datetime(pdf[ts]).astype("int64").to_numpy()
        names = [m if isinstance(m, str) else None for m in pdf[moment]]
        cuts, found = [*moment_boundaries(names, least_run), len(pdf)], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            for part in split_scene(times[a:b], most):
                own = pdf.iloc[a + part]
                if len(own) < least:
                    continue
                weight: dict[str, float] = {}
                for m, c in zip(own[moment], own[confidence], strict=True):
                    if isinstance(m, str):
                        weight[m] = weight.get(m, 0.0) + (0.5 if c != c else c)
                top = min(weight, key=lambda m: (-round(weight[m], 9), m), default=None)
                best = own.assign(_s=own[score].fillna(-1.0)).sort_values(["_s", key], ascending=[False, True], kind="stable")[key].iloc[0]
                found.append([*(own[c].iloc[0] for c in by), len(own), own[ts].iloc[0], own[ts].iloc[-1], best, top, round(weight[top] / sum(weight.values()), 3) if top and sum(weight.values()) else None])
        return pd.DataFrame(found, columns=[*by, "n", "start", "end", "best", "moment", "share"])

    kinds = dict(df.dtypes)
    return rows.groupBy(*by, "_run").applyInPandas(build, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", n bigint, start timestamp, end timestamp, best {kinds[key]}, moment string, share double")



