"""Exact dedup against a dictionary, and the coding of fingerprints."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from scoreloom.llm import exact_dedup
from scoreloom.llm.exact_dedup import decode, encode, exact_duplicates, rice_bits

_LOWER = str.maketrans(exact_dedup._UPPER, exact_dedup._LOWER)


def brute(docs):
    groups = {}
    for key, text in docs:
        groups.setdefault((text or "").translate(_LOWER), []).append(key)
    out = []
    for key, text in docs:
        plain = (text or "").translate(_LOWER)
        keys = groups[plain]
        keep = max((k for k in keys if k is not None), default=None)
        out.append((key, keep, len(keys), key == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, docs, parts=3, **more):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
    return sorted((tuple(r) for r in exact_duplicates(frame, **more).collect()), key=repr)


@given(st.sets(st.integers(0, 1 << 30), min_size=1, max_size=200), st.integers(0, 40))
def test_codes_are_read_back(values, k):
    values = np.array(sorted(values), dtype=np.int64) + 1000
    k = min(k, 30) if k > 20 else max(k, 18)  # a small k writes long runs of ones
    assert (decode(encode(values, 1000, k), len(values), 1000, k) == values).all()


def test_codes_are_short():
    rng = np.random.default_rng(0)
    values = np.unique(rng.integers(0, 1 << 30, 1 << 16))
    code = encode(values, 0, rice_bits(len(values), 1 << 30))
    assert (decode(code, len(values), 0, rice_bits(len(values), 1 << 30)) == values).all()
    assert 8 * len(code) / len(values) < 16  # 14 bits of distance, about 1.5 more
    dense = np.arange(500)
    assert (decode(encode(dense, 0, 0), 500, 0, 0) == dense).all() and len(encode(dense, 0, 0)) == 63


def corpus(seed, n=600):
    rng = random.Random(seed)
    texts = ["Same Text", "same text", "SAME TEXT", "É", "é", "", None, "a\nb", "a b", "x" * 50_000]
    docs = []
    for i in range(n):
        if i % 3 == 0:
            docs.append((i, "A text that a third of all rows share"))
        else:
            docs.append((i, rng.choice(texts) if rng.random() < 0.3 else f"own {rng.randrange(n)}"))
    docs += [(None, "same text"), (None, "only under null"), (None, "only under null"), (5, docs[5][1])]
    return docs


@pytest.mark.parametrize(
    "more",
    [
        {},
        {"owned": 50, "block": 40},  # many owners and blocks
        {"spare": -6, "owned": 100, "block": 64},  # fingerprints of four bits: all are suspects
        {"spare": 50},
    ],
)
def test_against_a_dictionary(spark, more):
    docs = corpus(1)
    assert found(spark, docs, **more) == brute(docs)


def test_suspects_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    docs = corpus(2)
    assert found(spark, docs, block=100) == brute(docs)


def test_few_rows_are_false_suspects(spark):
    frame = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    marked, bits = exact_dedup.suspects(frame, "doc_id", "text", block=300)
    assert bits == 13 + exact_dedup.SPARE
    assert marked.filter("suspect").count() < 5000 * 4 / 2**exact_dedup.SPARE + 10


def test_empty_tables_nulls_and_clashing_names(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None)]) == brute([(None, None)])
    frame = spark.createDataFrame(
        [("b", "T", 1, 2), ("a", "t", 3, 4)], "key string, body string, sha int, keep_id int"
    )
    rows = exact_duplicates(frame, key="key", text="body").collect()
    assert sorted((r.key, r.keep_id, r.kept) for r in rows) == [("a", "b", False), ("b", "b", True)]


def test_one_more_reading_is_the_same(spark):
    docs = corpus(3)
    assert found(spark, docs, parts=1) == found(spark, docs, parts=7, block=33)
