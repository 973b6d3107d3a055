"""Decontamination against a plain search for every window."""

import random
import re

import numpy as np
import pytest

from scoreloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(doc, items, window=13):
    words, hit, found = cut(doc), set(), set()
    for name, text in items:
        own = cut(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            phrase = own[i : i + window]
            for p in range(len(words) - len(phrase) + 1):
                if words[p : p + len(phrase)] == phrase:
                    hit.update(range(p, p + len(phrase)))
                    found.update([name] if name is not None else [])
    return len(words), len(hit), sorted(found)


def random_texts(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "Ee", "été", "g-h", "x"]
    items = [
        (str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 30]))))
        for i in range(n_items)
    ]
    docs = []
    for _ in range(n_docs):
        parts = [" ".join(rng.choices([*vocabulary, "zz", "YY", "q"], k=rng.randint(0, 40))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(items)[1])
        docs.append(rng.choice([" ", "\n", ", "]).join(parts))
    return docs, items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("window", [2, 13])
def test_a_shard_finds_what_a_plain_search_finds(seed, window):
    docs, items = random_texts(seed)
    found = dc.phrases([(n, t.encode()) for n, t in items], window)
    results = dc.search_shard(found, [dc.words_of(d.encode()) for d in docs])
    for doc, (names, spans) in zip(docs, results):
        n, hit, wanted = brute(doc, items, window)
        assert sum(b - a for a, b in spans) == hit
        assert names == wanted
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_suffixes_are_sorted():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 3000):
        text = np.append(rng.integers(0, 3, n - 1), 0).astype(np.int64)
        seps = np.cumsum(text == 0) - 1
        symbols = [(0, int(s)) if t == 0 else (1, int(t)) for t, s in zip(text, seps)]

        def suffix(i, symbols=symbols):
            out = []
            for s in symbols[i:]:
                out.append(s)
                if s[0] == 0:
                    break
            return out

        assert dc.sorted_suffixes(text).tolist() == sorted(range(n), key=suffix)


def test_ranks_count_symbols():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 20, 1000)
    ranks = dc.Ranks(symbols, 19)
    at = np.arange(0, 1001, 7)
    for s in (0, 3, 19):
        got = ranks.rank(np.full(len(at), s), at)
        assert got.tolist() == [int((symbols[:i] == s).sum()) for i in at]
    there, before = ranks.symbol_and_rank(np.arange(1000))
    assert (there == symbols).all()
    assert before.tolist() == [int((symbols[:i] == s).sum()) for i, s in enumerate(symbols)]


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, items string, spans int")
    return d, spark.createDataFrame(items, "item_id bigint, text string")


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
DOCS = [
    (1, f"x y {PASSAGE} z", "mine", 5),
    (2, None, None, None),
    (3, "", None, None),
    (4, "Short  ITEM!", None, None),
    (5, PASSAGE + " pad" * 400, None, None),
    (5, PASSAGE + " pad" * 400, None, None),
    (None, PASSAGE.upper(), None, None),
    (6, "--- ... !!!", None, None),
    (7, "w " * 60_000 + PASSAGE, None, None),
]
ITEMS = [(10, PASSAGE), (9, "short item"), (11, None), (12, " . "), (None, PASSAGE + " z"), (10, PASSAGE)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
@pytest.mark.parametrize("shard_words", [1, 1 << 20])
def test_edge_cases_and_blocks(spark, block_bytes, shard_words):
    docs, items = frames(spark, DOCS, ITEMS)
    found = dc.find_contamination(docs, items, block_bytes=block_bytes, shard_words=shard_words, keep=["doc_id"])
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in dc.digest(found).collect())
    assert got == [
        (0, 14, 14, 1, True),
        (1, 17, 15, 1, True),
        (2, 0, 0, 0, False),
        (3, 0, 0, 0, False),
        (4, 2, 2, 1, True),
        (5, 414, 14, 1, False),
        (5, 414, 14, 1, False),
        (6, 0, 0, 0, False),
        (7, 60_014, 14, 1, False),
    ]


def test_all_columns_stay_but_those_made(spark):
    docs, items = frames(spark, DOCS[:1], ITEMS)
    row = dc.find_contamination(docs, items).first()
    assert row.text == DOCS[0][1] and row["items"] == ["10"]
    assert [(s.start, s.end) for s in row.spans] == [(2, 17)]


def test_empty_tables(spark):
    docs, items = frames(spark, [], [])
    assert dc.digest(dc.find_contamination(docs, items)).count() == 0
    docs, items = frames(spark, DOCS, [])
    assert dc.digest(dc.find_contamination(docs, items)).filter("n_hit > 0 OR contaminated").count() == 0


def test_items_with_an_empty_or_no_id_and_repeated_items(spark):
    phrase = " ".join(f"word{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"a {phrase} b"), (2, "none of it")], "doc_id int, text string")
    for name, items in (("", [""]), (None, [])):
        benchmark = spark.createDataFrame([(name, phrase)] * 5, "item_id string, text string")
        found = {r.doc_id: r for r in dc.find_contamination(docs, benchmark).collect()}
        assert found[1].n_hit == 14 and found[1]["items"] == items and found[2].n_hit == 0
    # Repeated rows are one item: they need one block, and one block's bytes on the driver.
    benchmark = spark.createDataFrame([("x", phrase)] * 500, "item_id string, text string")
    found = dc.find_contamination(docs, benchmark, block_bytes=len(phrase) + 1)
    assert {r.doc_id: r["items"] for r in found.collect()} == {1: ["x"], 2: []}


def test_texts_are_sent_once_and_gathered_as_codes(spark):
    found = dc.phrases([("a", b"one two three")], 13)
    codes = dc.coded(found, dc.words_of(b"Two or one, three"))
    assert codes.tolist() == [2, 0, 1, 3] and codes.nbytes == 16
    docs = spark.createDataFrame([(1, "zero ONE two three"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    out = dc.find_contamination(docs, items)
    assert "cast(text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.text, r.items, r.n_hit) for r in out.collect()) == [(1, "zero ONE two three", ["a"], 3), (2, None, [], 0)]
