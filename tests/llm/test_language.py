"""Language identification: vectors, held-out accuracy, edge cases."""

import numpy as np
import pyarrow.parquet as pq
from conftest import SF
from pyspark.sql import functions as F

from scoreloom.llm import language as lg
from scoreloom.llm import queries, rows


def test_a_profile_is_the_sum_of_bound_trigrams():
    letter = lambda c: lg.letter(ord(c) if c else 0, 64).astype(int)

    def trigram(a, b, c):
        return np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)

    text = "Ab, 1 c"
    want = trigram("", "a", "b") + trigram("a", "b", "") + trigram("b", "", "c") + trigram("", "c", "")
    assert np.allclose(lg.profiles([text], 64)[0], want / np.linalg.norm(want))


def test_batches_do_not_change_a_profile():
    texts = ["", "12 3", "x", "été " * 50, "the cat sat", "日本語 😀 text"]
    together = lg.profiles(texts, 128)
    for i, t in enumerate(texts):
        assert np.allclose(together[i], lg.profiles([t], 128)[0], atol=1e-6)
    assert not together[0].any() and not together[1].any() and together[2].any()


def test_a_very_long_text_keeps_its_language(monkeypatch):
    whole = lg.profiles(["the cat sat on the mat " * 200], 512)[0]
    monkeypatch.setattr(lg, "CHARACTERS", 100)
    assert float(whole @ lg.profiles(["the cat sat on the mat " * 200], 512)[0]) > 0.99


def test_held_out_texts_are_recognised(spark):
    found = {r.doc_id: r for r in queries.op9_language_id(spark, SF).collect()}
    truth = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()
    assert len(found) == len(truth)
    held = [(found[t["doc_id"]].lang_pred, t["lang"]) for t in truth if found[t["doc_id"]].held_out]
    assert len(held) > 20
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "the cat and the dog are here", "en", 1.0), (2, "der hund und die katze sind hier", "de", 2.0),
         (3, None, "en", 3.0), (4, "", None, 4.0), (5, "123 !", "en", 5.0), (None, "the dog", "xx", 6.0),
         (1, "the cat and the dog are here", "en", 1.0)],
        "doc_id bigint, text string, lang string, score double",
    )
    learned = lg.learn(docs, "doc_id", F.lit(True))
    assert sorted(learned) == ["de", "en"]
    got = sorted((r.doc_id or 0, r.lang_pred, r.score > 0) for r in lg.identify(docs, learned).collect())
    assert got == [(0, "en", True), (1, "en", True), (1, "en", True), (2, "de", True),
                   (3, "und", False), (4, "und", False), (5, "und", False)]
    assert {r.lang_pred for r in lg.identify(docs, {}).collect()} == {"und"}
    assert lg.identify(docs.limit(0), learned).count() == 0
    assert lg.learn(docs.limit(0), "doc_id", F.lit(True)) == {}


def test_what_is_held_out_is_not_learned(spark):
    docs = spark.createDataFrame(
        [(i, "aaa bbb" if i % 2 else "xyz", str(i)) for i in range(40)], "doc_id bigint, text string, lang string"
    )
    held = {r[0] for r in docs.filter(rows.fold(F.col("doc_id"), 4) == 2).select("lang").collect()}
    assert held and not held & set(lg.learn(docs, "doc_id", rows.fold(F.col("doc_id"), 4) != 2))


def test_a_hot_key_or_text_loses_no_language_and_no_bound(spark):
    rows_ = [(7, f"the cat and the dog number {i} are here", "en") for i in range(3000)]
    rows_ += [(8, "all the same words again and again", "en")] * 3000
    rows_ += [(100 + i, f"der hund und die katze nummer {i} sind hier", "de") for i in range(50)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    learned = lg.learn(docs, "doc_id", F.lit(True), per_language=40)
    assert sorted(learned) == ["de", "en"]
    got = {r.lang_pred for r in lg.identify(docs.filter("lang = 'en'"), learned).collect()}
    assert got == {"en"}
    # At most 40 texts a language are read, each once, and reruns choose the same.
    again = lg.learn(docs.repartition(5), "doc_id", F.lit(True), per_language=40)
    assert all(np.allclose(learned[x], again[x]) for x in learned)
