"""Centroid clustering against plain loops over whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from scoreloom.llm import centroids
from scoreloom.llm.centroids import cluster, digest, nearest, rotated


def brute(rows, k, rounds, dimensions):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(256 * x) for x in v]))
    name = lambda key: hashlib.sha256(f"2:{'' if key is None else key}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(assign(v)[1], []).append(v)
        centres = [
            [sum(x) // len(members[i]) for x in zip(*members[i])] if i in members else c for i, c in enumerate(centres)
        ]
    found = [(key, *assign(v)[::-1]) for key, v in kept]
    total, own = sum(d for *_, d in found), {}
    for _, c, d in found:
        own[c] = own.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((key, c, d, own[c], total, sha[c]) for key, c, d in found), key=repr)


def vectors(seed, n=300, dimensions=8, groups=6, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dimensions))
    rows = []
    for i in range(n):
        # A third of all vectors are the same.
        v = centres[0] if i % 3 == 0 else centres[rng.integers(groups)] + spread * rng.normal(size=dimensions)
        rows.append((i, [float(np.float32(x)) for x in v]))
    bad = [None, [], [0.0] * (dimensions - 1), [None] * dimensions, [math.nan] + [0.0] * (dimensions - 1)]
    bad += [[math.inf] + [0.0] * (dimensions - 1), [-math.inf] * dimensions]
    rows += [(n + i, v) for i, v in enumerate(bad)]
    return rows + [(None, rows[1][1]), (4, rows[4][1]), (4, rows[5][1])]


def found(spark, rows, kind="float", **more):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    made = digest(*cluster(frame, **more))
    return sorted((tuple(r) for r in made.collect()), key=repr)


@pytest.mark.parametrize("seed, spread, k", [(0, 0.05, 5), (1, 0.5, 12), (2, 3.0, 40)])
def test_against_plain_loops(spark, seed, spread, k):
    rows = vectors(seed, spread=spread)
    got = found(spark, rows, k=k, dimensions=8, leading=3)
    assert got == brute(rows, k, 5, 8)


def test_ties_and_empty_clusters(spark):
    # Whole steps on a line: many distances are equal, and equal vectors leave centroids empty.
    rows = [(i, [float(i % 7) / 256, 0.0]) for i in range(60)]
    assert found(spark, rows, k=20, dimensions=2, leading=1, kind="double") == brute(rows, 20, 5, 2)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, -1.0])]
    assert found(spark, rows, dimensions=2) == brute(rows, 40, 5, 2)
    assert found(spark, [(1, None), (2, [1.0])], dimensions=2) == []
    assert found(spark, [], dimensions=2) == []


def test_large_components_stay_exact_or_are_an_error(spark):
    rows = [(i, [(-1) ** i * (2.0**18 + i), float(i)]) for i in range(20)]
    assert found(spark, rows, k=6, dimensions=2, kind="double") == brute(rows, 6, 5, 2)
    with pytest.raises(Exception, match="beyond"):
        found(spark, [(1, [1e9, 0.0])], dimensions=2, kind="double")


def test_bounds_are_below_the_distances_and_save_most_of_them():
    rng = np.random.default_rng(5)
    c = rng.integers(-500, 500, size=(40, 64))
    v = c[rng.integers(40, size=3000)] + rng.integers(-40, 40, size=(3000, 64))
    mean = v.mean(axis=0)
    axes = np.linalg.svd(v - mean, full_matrices=False)[2].T
    lead, rest = rotated(v.astype(float), mean, axes, 16)
    c_lead, c_rest = rotated(c.astype(float), mean, axes, 16)
    exact = np.square(v[:, None] - c[None]).sum(axis=2)
    bound = np.square(lead[:, None] - c_lead[None]).sum(axis=2) + np.square(rest[:, None] - c_rest[None])
    assert (bound <= exact * (1 + 1e-9) + 1e-3).all()
    at, best, measured = nearest(v, lead, rest, c, c_lead, c_rest)
    assert (at == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert measured < 0.1 * exact.size


def test_clashing_names(spark):
    frame = spark.createDataFrame(
        [(1, [1.0, 2.0], 5, 6), (2, [3.0, 4.0], 7, 8)], "key int, v array<double>, cluster int, distance int"
    )
    rows = digest(*cluster(frame, key="key", vector="v", dimensions=2)).collect()
    assert sorted((r.key, r.distance) for r in rows) == [(1, 0), (2, 0)]
    assert centroids.CENTROIDS == 40
