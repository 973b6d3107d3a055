"""Toxicity: held-out texts, unseen misspellings, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import queries, rows
from scoreloom.llm import toxicity as tx

BAD = ["grumblor", "snarfeck", "vilqueth"]


def made(n, seed):
    rng = random.Random(seed)
    common = ["".join(rng.choices("aeioutnrsl", k=rng.randint(2, 7))) for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(5, 300))
        if i % 4 == 0:
            for _ in range(max(1, len(words) // 60)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ly"]))
        texts.append(" ".join(words))
        toxic.append(i % 4 == 0)
    return texts, toxic, common


@pytest.fixture(scope="module")
def model():
    texts, toxic, common = made(600, 1)
    return tx.train(texts, toxic), common


def score(model, text):
    scorer = tx.Scorer(model)
    return scorer.probability(scorer.document(tx.words_of(text)))


def test_unseen_texts(model):
    rng = random.Random(7)
    for i in range(100):
        words = rng.choices(model[1], k=rng.randint(5, 2000))
        assert score(model[0], " ".join(words)) < 0.5
        words.insert(rng.randrange(len(words)), BAD[i % 3])
        assert score(model[0], " ".join(words)) >= 0.5


def test_unseen_misspellings(model):
    rng = random.Random(8)
    text = " ".join(rng.choices(model[1], k=40))
    for word in ("grumblorr", "grumblorz", "snarfeckk", "vilqueths", "GRUMBLOR"):
        assert score(model[0], f"{text} {word} {text}") >= 0.5


def test_training_repeats(model):
    texts, toxic, _ = made(80, 2)
    a, b = (tx.train(texts, toxic) for _ in range(2))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_one_class_gives_no_model():
    assert tx.train(["a b"], [True]) is None
    assert tx.train([], []) is None
    assert tx.train(["", "!"], [True, False]) is None


def test_tables(spark):
    texts, toxic, _ = made(200, 3)
    docs = [(i, t, 0.5) for i, t in enumerate(texts)]
    docs += [(1000, None, 0.5), (1001, "", 0.5), (None, BAD[0], 0.5), (1, texts[1], 0.5), (1002, "a " * 100_000, 0.5)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    labels = [(i, int(x)) for i, x in enumerate(toxic)] + [(None, 1), (5, None), (0, 0), (1000, 1), (7777, 1)]
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    learned = tx.learn(frame, known, rows.fold(F.col("_key"), 5) != 0)
    got = tx.score(frame, learned, keep=["doc_id"]).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[1000] == by[1001] == by[1002] == 0 and by[None] == 1
    right = [by[i] == int(x) for i, x in enumerate(toxic)]
    assert np.mean(right) > 0.97
    empty = tx.learn(frame, known.limit(0))
    assert empty is None
    assert {r.score for r in tx.score(frame, empty).collect()} == {0.0}
    assert tx.score(frame.limit(0), learned).count() == 0


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, sf)
    labels = rows.table(spark, sf, "labels").select("doc_id", "toxic")
    held = found.filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.85


def test_long_texts_and_labels_without_a_text_do_not_end_the_sample(spark):
    texts, toxic, common = made(120, 5)
    long = " ".join(random.Random(6).choices(common, k=40_000))
    docs = list(enumerate(texts)) + [(1000 + i, long) for i in range(60)] + [(3000, None)]
    labels = [(i, int(x)) for i, x in enumerate(toxic)] + [(1000 + i, i % 2) for i in range(60)]
    labels += [(5000 + i, i % 2) for i in range(600)] + [(3000, 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    learned = tx.learn(frame, known, max_rows=100, max_chars=160_000)
    clean = " ".join(common[:50])
    assert score(learned, clean) < 0.5 <= score(learned, f"{clean} {BAD[0]} {BAD[1]} {clean}")


def test_a_class_of_long_texts_only_is_learned(spark):
    rng = random.Random(9)
    texts, toxic, common = made(120, 5)
    long = " ".join(rng.choice(BAD) if i % 20 == 0 else rng.choice(common) for i in range(20_000))
    docs = [(i, t) for i, (t, x) in enumerate(zip(texts, toxic)) if not x] + [(1000, long)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i == 1000)) for i, _ in docs], "doc_id bigint, toxic int")
    assert tx.learn(frame, known, max_chars=40_000) is not None
