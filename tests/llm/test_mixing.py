"""Mixing against a plain simulation of the queues."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import mixing


def brute_targets(sizes, budget, weights=mixing.WEIGHTS, repeats=mixing.REPEATS):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = budget - sum(target.values())
        share = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if share * weight[s] >= repeats * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: float(repeats * sizes[s]) for s in over}
        open_ -= over


def corpus(seed, n=400, sources=8):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(sources)] + ["é", "Z", None]
    docs = []
    for i in range(n):
        source = "s0" if i % 3 == 0 else rng.choice(names)
        docs.append((i, "w " * rng.choice([0, 1, 5, 30, 200]), source))
    return docs


def mixed(spark, docs, **more):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    return mixing.mix(frame, **more).collect()


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("budget", [None, 500, 40_000])
def test_targets_and_budget(spark, seed, budget):
    docs = corpus(seed)
    rows = mixed(spark, docs, budget=budget)
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    limit = sum(sizes.values()) if budget is None else budget
    want = brute_targets(sizes, limit)
    largest = max(r.size for r in rows)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= largest
    for r in rows:
        assert r.size == len(docs[r.doc_id][1].split())
        assert 0 <= r.taken <= mixing.REPEATS * r.size
        assert r.size == 0 or r.taken % r.size == 0
    assert sum(r.taken for r in rows) <= limit


def test_the_order_of_finish_times(spark):
    """What is taken is what a simulation of the queues takes, copy by copy."""
    docs = corpus(7, n=150)
    rows = mixed(spark, docs)
    total = sum(r.size for r in rows)
    hashes = spark.createDataFrame([(r.doc_id, r.size) for r in rows], "key bigint, size bigint").select(
        "key", F.xxhash64("key", "size", F.lit(10)).alias("h")
    )
    h = {r.key: r.h for r in hashes.collect()}
    import math

    buckets = math.isqrt(len(docs)) + 1
    place = lambda r: (((h[r.doc_id] % 2**64) >> 20) % buckets, h[r.doc_id])
    copies = []
    for s in {r.source for r in rows}:
        own = sorted((r for r in rows if r.source == s), key=place)
        at = 0
        for turn in range(mixing.REPEATS):
            for r in own:
                if r.size and r.target and at / r.target < 1:
                    copies.append(((at + r.size) / r.target, s is None, s or "", at % r.source_size, r))
                at += r.size
    taken, sum_ = {}, 0
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        sum_ += r.size
        if sum_ > total:
            break
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.size
    assert {r.doc_id: r.taken for r in rows if r.taken} == taken


def test_reruns_agree(spark):
    docs = corpus(3)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    a = sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()))
    assert a == sorted(map(tuple, mixing.mix(frame.repartition(2)).collect()))


def test_edge_cases(spark):
    docs = [(1, "a b", "x"), (1, "a b", "x"), (None, "a b c", None), (2, None, "x"), (3, "", "y"), (4, None, None)]
    rows = mixed(spark, docs)
    got = sorted((r.doc_id or 0, r.size, r.source or "", r.source_size) for r in rows)
    assert got == [(0, 3, "", 3), (1, 2, "x", 4), (1, 2, "x", 4), (2, 0, "x", 4), (3, 0, "y", 0), (4, 0, "", 3)]
    assert all(r.target == 0 and r.taken == 0 for r in rows if r.source == "y")
    assert mixed(spark, []) == []
    assert all(r.taken == 0 for r in mixed(spark, [(1, None, "x"), (2, "", "x")]))
    extra = spark.createDataFrame([(1, "a b", "x", 9, 9.0)], "doc_id bigint, text string, source string, size int, target double")
    row = mixing.mix(extra).first()
    assert (row.size, row.target, row.taken) == (2, 2.0, 2)


def test_a_hot_source_is_split_into_buckets(spark):
    docs = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows = mixed(spark, docs)
    by = {}
    for r in rows:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - g) <= 7 for t, g in by.values())


def test_a_row_that_makes_a_third_of_the_table_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 7)
    docs = [(1, "w " * 10, "s0")] * 1500 + [(i, "w " * (i % 40), f"s{i % 5}") for i in range(10, 3010)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs) and sum(r.doc_id == 1 for r in rows) == 1500
    taken = [r.taken for r in rows if r.doc_id == 1]
    assert set(taken) <= {0, 10, 20, 30}
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
    again = mixing.mix(frame.repartition(9)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
