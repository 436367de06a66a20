"""Density clusters against a tree built by hand, and what they mean for people."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import density


def brute_clusters(v, least, samples, radius=2.0, epsilon=0.0):
    """The hierarchy by connectivity at every distance, over the whole matrix: clusters as frozensets of rows."""
    d = density.distances(v, v)
    np.fill_diagonal(d, 0)
    off = d + np.where(np.eye(len(v), dtype=bool), np.inf, 0)
    core = np.sort(off, axis=1)[:, samples - 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    np.fill_diagonal(m, np.inf)
    m[m > radius] = np.inf

    def parts(rows, below):
        """Connected parts of rows under edges strictly cheaper than ``below`` (or any, if it is None)."""
        left, out = np.zeros(len(m), bool), []
        left[list(rows)] = True
        while left.any():
            seen = np.zeros(len(m), bool)
            new = np.zeros(len(m), bool)
            new[left.argmax()] = True
            while new.any():
                seen |= new
                reach = m[new].min(axis=0)
                new = left & ~seen & ((reach < np.inf) if below is None else (reach < below))
            out.append(frozenset(np.flatnonzero(seen).tolist()))
            left &= ~seen
        return out

    def dearest(rows):
        """The distance at which a part falls apart: the dearest edge of a spanning tree."""
        rows = sorted(rows)
        part, most = m[np.ix_(rows, rows)], 0.0
        rest, near = np.ones(len(rows), bool), part[0].copy()
        rest[0] = False
        while rest.any():
            y = int(np.where(rest, near, np.inf).argmin())
            most, rest[y], near = max(most, near[y]), False, np.minimum(near, part[y])
        return most

    def cluster(rows, born):
        """(members, mass, children, born) of a cluster whose members are ``rows`` at its birth."""
        members, mass, now = rows, 0.0, rows
        while True:
            if len(now) == 1:
                return members, mass, [], born
            w = dearest(now)
            lam = 1 / max(w, density.STEP)
            split = parts(now, w)
            large = [p for p in split if len(p) >= least]
            if len(large) == 1:
                mass += (lam - born) * (len(now) - len(large[0]))
                now = large[0]
            else:
                return members, mass + (lam - born) * len(now), [cluster(p, lam) for p in large], born

    def choose(c, may):
        members, mass, children, born = c
        below, held = [], 0.0
        for x in children:
            chosen, stable = choose(x, True)
            below += chosen
            held += stable
        if may and (not children or held <= mass):
            return [c], mass
        return below, max(held, mass)

    trees, out = parts(range(len(v)), None), []
    whole = len(trees) == 1
    for t in trees:
        if len(t) < 2:
            continue
        root = cluster(t, 0.0 if whole else 1 / radius)
        chosen = choose(root, not whole)[0]
        if epsilon:
            up = {}

            def walk(c):
                for x in c[2]:
                    up[x[0]] = c
                    walk(x)

            walk(root)
            raised = []
            for c in chosen:
                while 1 / max(c[3], 1e-300) < epsilon and c[0] in up and not (whole and up[c[0]] is root):
                    c = up[c[0]]
                raised.append(c)
            chosen = [c for c in raised if not any(c[0] < x[0] for x in raised)]
        out += [c[0] for c in chosen if len(c[0]) >= least]
    return set(out)


def crowd(seed, n, dim=8, groups=12, spread=0.25):
    r = np.random.default_rng(seed)
    v = r.standard_normal((groups, dim))[r.integers(0, groups, n)] + r.standard_normal((n, dim)) * spread * r.choice([0.3, 1, 2], (n, 1))
    v[5], v[9] = v[7], v[7]  # equal rows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def found(labels):
    out = {}
    for k, c in labels.items():
        if c is not None:
            out.setdefault(c, set()).add(k)
    assert all(c == min(members) for c, members in out.items())
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize(("least", "samples", "radius", "epsilon"), [(2, 2, 2.0, 0.0), (5, 3, 2.0, 0.0), (4, 2, 0.6, 0.0), (3, 2, 2.0, 0.35), (3, 1, 0.8, 0.3)])
def test_condensed_tree(least, samples, radius, epsilon):
    for seed in range(3):
        v = crowd(seed, 60)
        d = density.distances(v, v)
        np.fill_diagonal(d, np.inf)
        core = np.sort(d, axis=1)[:, samples - 1]
        cost = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        cost[cost > radius] = np.inf
        i, j, w = density.forest(cost, False)
        up = list(range(len(v)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in zip(i, j, strict=True):
            up[root(a)] = root(b)
        labels, whole = {k: None for k in range(len(v))}, len(w) == len(v) - 1
        for r in {root(k) for k in range(len(v))}:
            own = [k for k in range(len(w)) if root(i[k]) == r]
            if own:
                nodes = np.unique(np.concatenate([i[own], j[own]]))
                got = density.condensed(nodes, np.searchsorted(nodes, i[own]), np.searchsorted(nodes, j[own]), w[own], least, whole, radius, epsilon)
                for c in set(got.tolist()) - {-1}:
                    labels |= {int(k): int(nodes[got == c].min()) for k in nodes[got == c]}
        assert found(labels) == brute_clusters(v, least, samples, radius, epsilon)


@pytest.mark.parametrize("block", [1024, 40])
def test_clusters_of_500_vectors(spark, block):
    v = crowd(11, 500)
    rows = [(k, x.tolist()) for k, x in enumerate(v * 3)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8)]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in density.clusters(df, "id", "v", least=4, samples=3, block=block).collect()}
    assert len(got) == 505 and all(got[k] is None for k, _ in odd)
    want = brute_clusters(v, 4, 3)
    assert found(got) == want and len(want) > 3


def test_few_or_no_faces(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert density.clusters(empty, "id", "v").collect() == []
    one = spark.createDataFrame([(4, [1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in density.clusters(one, "id", "v").collect()] == [(4, None)]


def test_people_after_a_clustering(spark):
    unit = lambda a: [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]
    faces = [(1, unit(0), 1, None), (2, unit(2), 1, 7), (3, unit(4), 1, 7),  # close to person 5, though 7 owned it
             (10, unit(90), 10, 7), (11, unit(92), 10, None), (12, unit(94), 10, 7), (13, unit(96), 10, 8),  # half and more were of 7
             (20, unit(180), 20, 7), (21, unit(182), 20, 8), (22, unit(184), 20, 6), (23, unit(186), 20, 99),  # nobody's
             (30, unit(270), None, 8), (31, unit(300), None, None), (32, unit(310), None, 99)]
    df = spark.createDataFrame(faces, "id long, v array<double>, cluster long, was long")
    persons = spark.createDataFrame([(5, unit(1)), (6, unit(30)), (7, None), (8, unit(250))], "person long, centre array<double>")
    got = {r["id"]: (r["person"], r["how"], r["representative"]) for r in density.people_of(df, "id", "v", persons, "was").collect()}
    assert {got[k] for k in (1, 2, 3)} == {(5, "centre", None)}
    assert {got[k] for k in (10, 11, 12, 13)} == {(7, "owner", None)}
    assert {got[k] for k in (20, 21, 22, 23)} == {(None, "new", 21)}
    assert got[30] == (8, "returned", None) and got[31] == got[32] == (None, None, None)
    centres = {r["cluster"]: r for r in density.cluster_centres(df, "id", "v", "cluster").collect()}
    assert centres[1]["size"] == 3 and np.allclose(centres[1]["centre"], unit(2))


def test_forest_of_two_blocks():
    r = np.random.default_rng(2)
    cost = r.integers(1, 30, (25, 31)).astype(float)
    cost[cost > 20] = np.inf
    i, j, w = density.forest(cost, True)
    whole = np.full((56, 56), np.inf)
    whole[:25, 25:] = cost
    whole[25:, :25] = cost.T
    assert w.sum() == density.forest(whole, False)[2].sum()
    assert all(whole[a, b] == c for a, b, c in zip(i, j, w, strict=True))


def test_whole_query(spark, data):
    from lumenfold.plans.registry import QUERIES

    got = QUERIES["face_clusters"](spark, data)
    rows = got.collect()
    assert got.columns == ["vec_id", "cluster", "person", "how", "representative"] and len(rows) == len({r["vec_id"] for r in rows})
    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in e], float)
    want = brute_clusters(v / np.linalg.norm(v, axis=1, keepdims=True), 2, 2)
    assert found({r["vec_id"]: r["cluster"] for r in rows}) == {frozenset(e[k]["vec_id"] for k in c) for c in want}
    was = {r["vec_id"]: r["label"] if r["label"] % 2 == 0 else None for r in e}
    assert all((r["person"], r["how"]) == ((was[r["vec_id"]], "returned") if was[r["vec_id"]] is not None else (None, None)) for r in rows if r["cluster"] is None)
    assert got.where(F.col("how").isin("centre", "owner") & F.col("person").isNull()).count() == 0


def test_hashes_within_any_distance(spark):
    r = np.random.default_rng(1)
    h = r.integers(-(2**63), 2**63, 300)
    h[100:200] = h[:100] ^ (1 << r.integers(0, 60, 100))
    h[250], h[251] = h[3], h[3]
    from lumenfold.operators.similarity import hashes_within

    df = spark.createDataFrame([*((k, int(x)) for k, x in enumerate(h)), (999, None)], "id long, h long")
    for block in (32_768, 50):
        got = {tuple(x) for x in hashes_within(df, "id", "h", 12, block).collect()}
        bits = lambda a, b: bin((int(h[a]) ^ int(h[b])) & (2**64 - 1)).count("1")
        assert got == {(a, b, bits(a, b)) for a in range(300) for b in range(a + 1, 300) if bits(a, b) <= 12}
        assert len(got) < 0.02 * 300**2 / 2


def test_rounding_as_python_does(spark):
    from lumenfold.functions import exprs

    r = np.random.default_rng(0)
    values = [*map(float, np.round(r.uniform(-300, 300, 3000), 2)), 0.05, 0.15, 0.25, 0.35, -0.25, -0.35, 2.5, 3.5, 1e15 + 0.5, 4.35, 1e300, 0.0, 12.35, *(k / 8 for k in range(-40, 40))]
    for digits in (0, 1, 2):
        got = spark.createDataFrame([(x,) for x in values], "x double").select("x", exprs.round_exact("x", digits).alias("y")).collect()
        assert all(float(round(r["x"], digits)) == r["y"] for r in got)
