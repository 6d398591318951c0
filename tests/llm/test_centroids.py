"""Centroid clustering against whole scans in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from eventloom.llm import centroids


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in order[:k]]

    def assigned():
        out = []
        for _, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in now]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        a = assigned()
        for c in range(len(now)):
            if own := [v for (_, v), (n, _) in zip(kept, a, strict=True) if n == c]:
                now[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    a = assigned()
    sums = [sum(d for n, d in a if n == c) for c in range(len(now))]
    return sorted((str(i), n, d, sums[n], sum(sums), hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest()) for (i, _), (n, d) in zip(kept, a, strict=True))


def cases(dims):
    r = random.Random(4)
    hubs = [[r.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(hubs)]) for i in range(150)]
    rows += [(i, [r.choice([0.0, 1.0]) for _ in range(dims)]) for i in range(200, 260)]  # many ties
    rows += [(300, None), (301, []), (302, [0.0] * (dims + 1)), (303, [None] * dims), (304, [float("nan")] * dims), (305, [float("inf")] * dims), (None, [0.5] * dims), (None, [0.5] * dims)]
    return rows + [(7, [9.0] * dims), (7, [9.0] * dims), (400, [1e4] * dims), (401, [-3e3] * dims)]


@pytest.mark.parametrize(("k", "rounds", "dims"), [(8, 5, 4), (40, 5, 3), (1, 2, 3), (300, 2, 2), (6, 0, 3)])
def test_centroids(spark, k, rounds, dims):
    rows = cases(dims)
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, `a.b` string").repartition(3)
    got = sorted((str(x[0]), *x[1:]) for x in centroids.centroids(table, k, rounds, dims).collect())
    assert got == brute(rows, k, rounds, dims)


def test_nothing_to_cluster(spark):
    for rows in ([], [(1, None)], [(None, [0.0] * 64)]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert centroids.centroids(table).collect() == []


def test_bounds_spare_scans_and_are_never_wrong():
    r = np.random.default_rng(3)
    hubs = r.integers(-300, 300, (12, 16))
    x = hubs[r.integers(0, 12, 4000)] + r.integers(-30, 30, (4000, 16))
    now, before, scanned = x[:12].copy(), None, []
    state = centroids.Step(now).scan(x)
    for _ in range(6):
        new = np.array([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else now[c] for c in range(12)])
        now, before = new, now
        step = centroids.Step(now, before)
        *state, n = step.assign(x, *state)
        scanned.append(n)
        d = ((x[:, None, :] - now) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        assert (state[1] ** 2 >= d.min(1) * (1 - 1e-15)).all()
        assert (np.where(state[2] > 0, state[2], 0) ** 2 <= np.sort(d, 1)[:, 1]).all()
    assert scanned[-1] < 2000


def test_large_components_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [1 << 27, 0], [3, 4]])
    c = np.array([[-(1 << 27), 1 << 27], [0, 0]])
    assert centroids.squared(x, c).tolist() == [[int(((a.astype(object) - b) ** 2).sum()) for b in c] for a in x]
