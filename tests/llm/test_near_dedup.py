"""Near duplicates against comparing every pair."""

import random

import numpy as np
import pytest

from scoreloom.llm import components as cc
from scoreloom.llm import near_dedup as nd


def brute(docs):
    """component_id and set size per (id, text), from all pairs."""
    sets = [nd.shingles_of(nd.words_of(t.encode() if t else None)) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if nd.similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(docs[i][0], len(sets[i]), least.get(find(i), docs[i][0])) for i in range(len(docs))]


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, int(len(out) * share))):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def corpus(seed, hubs=3, per_hub=25):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    passage = words(60)
    docs = []
    for _ in range(hubs):
        hub = words(rng.choice([12, 60, 150]))
        docs += [" ".join(edited(rng, hub, rng.choice([0.01, 0.03, 0.05]))) for _ in range(per_hub)]
        docs += [" ".join(hub)] * 3
    docs += [" ".join(passage + words(rng.randint(1, 60))) for _ in range(60)]  # similar, rarely linked
    docs += [" ".join(words(rng.randint(1, 40))) for _ in range(40)]
    docs += ["one two three", "One  two\nthree", "one", "", "  \n"]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[j]) for i, j in enumerate(order)]


def found(spark, docs, **extra):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    return sorted(
        ((r.doc_id, r.n_shingles, r.component_id) for r in nd.near_duplicates(frame).collect()), key=str
    )


@pytest.mark.parametrize("seed", [0, 1])
def test_components_are_those_of_all_pairs(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == sorted(brute(docs), key=str)


def test_large_entries_in_blocks(spark, monkeypatch):
    """Every entry counts as large, and blocks hold a few documents."""
    monkeypatch.setattr(nd, "SMALL", 1)
    monkeypatch.setattr(nd, "BLOCK", 400)
    docs = corpus(2, hubs=2, per_hub=20)
    assert found(spark, docs) == sorted(brute(docs), key=str)


def test_large_entries_find_links_alone(spark, monkeypatch):
    """Without any link from pivots and pairs, blocks find all of them."""
    docs = corpus(3, hubs=2, per_hub=20)
    empty = lambda pairs, texts: pairs.select("u", "v").limit(0)
    monkeypatch.setattr(nd, "SMALL", 1)
    monkeypatch.setattr(nd, "BLOCK", 1500)
    monkeypatch.setattr(nd, "confirmed", empty)
    assert found(spark, docs) == sorted(brute(docs), key=str)


def test_nulls_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    docs = [
        (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C  D E F"), (None, "a b c d e f"),
        (5, None), (6, ""), (None, None), (7, "x"), (8, "x"), (None, "only one here"),
        (9, long), (10, long + " w"), (11, "İ ı ß é"), (11, "other text of this id"),
    ]
    frame = spark.createDataFrame([(*d, "c", 1) for d in docs], "doc_id bigint, text string, node string, kept int")
    rows = nd.near_duplicates(frame).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted(brute(docs), key=str)
    for r in rows:
        assert r.kept == (r.doc_id == r.component_id)


def test_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.near_duplicates(frame).collect() == []


def test_signatures_within_the_distance_meet():
    """Any two signatures that differ in DISTANCE symbols or fewer agree on some entry."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        n = rng.integers(0, nd.DISTANCE + 1)
        same = np.ones(nd.SYMBOLS, bool)
        same[rng.choice(nd.SYMBOLS, n, replace=False)] = False
        chunks = same.reshape(nd.CHUNKS, nd.CHUNK).sum(1)
        assert (chunks >= nd.CHUNK - nd.ERRORS).any()


def test_symbols_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**63, 1000, dtype=np.uint64)]
    sets.append(np.concatenate([sets[0][:750], rng.integers(0, 2**63, 250, dtype=np.uint64)]))
    a, b = nd.signatures([np.sort(s) for s in sets])
    assert abs((a == b).mean() - 0.6) < 0.12


def test_shingle_hashes_follow_the_words():
    h = nd.Hasher()
    for text in ("a b c d e f a b c d e", "a b", "a", "b a", ""):
        words = nd.words_of(text.encode())
        assert len(h.shingles(words)) == len(nd.shingles_of(words))
    assert h.shingles([b"a", b"b"]) != h.shingles([b"b", b"a"])
    assert nd.words_of("A\x0bB\xa0c Éd\x1fe".encode()) == ["a".encode(), "b\xa0c".encode(), "Éd\x1fe".encode()]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(5000 + 2 * i, 5001 + 2 * i) for i in range(20)]
    edges = chain + star + loose + [(7, 7)] + star[:5]
    rng.shuffle(edges)
    frame = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "u bigint, v bigint")
    got = {r.node: r.component for r in cc.components(frame).collect()}
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    want |= {n: n - n % 2 for n in range(5000, 5040)}
    assert got == want
    assert cc.components(frame.limit(0)).count() == 0
