"""Curation: classes, clusters, counts and sketches, replay, licences, categories, filters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import conversations, corpus, filters
from scoreloom.session import local_table


def docs_of(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


# Exact classes and the best of a cluster


def test_exact_classes_and_membership(spark):
    rows = [(3, "A  b\n"), (1, "a B"), (2, "a b c"), (4, None), (5, None), (6, ""), (7, " \t"), (None, "a b"), (2, "a b c")]
    got = {(r.doc_id, r.keep_id, r.class_size, r.kept) for r in corpus.exact_dedup(docs_of(spark, rows)).collect()}
    assert got == {
        (3, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 2, True), (4, None, None, True),
        (5, None, None, True), (6, 6, 2, True), (7, 6, 2, False),
    }
    assert corpus.exact_dedup(docs_of(spark, [])).count() == 0


def test_a_class_of_a_third_of_the_table(spark):
    frame = spark.range(30_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same', concat('t', id)) AS text")
    found = corpus.exact_dedup(frame)
    assert found.where("class_size > 1").count() == 10_000 and found.where("kept").count() == 20_001
    members = found.selectExpr("doc_id", "class_hash AS cluster")
    rated = frame.withColumn("n", F.col("doc_id") % 100)
    kept = corpus.keep_best(rated, members, ["n"]).where("text = 'the same'").collect()
    assert [(r.doc_id, r.n) for r in kept] == [(99, 99)]


def test_best_of_a_cluster_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, 1.5, 2.5])) for i in range(200)]
    cluster = {i: rng.choice([None, "a", "b", "c", f"own{i}"]) for i in range(200)}
    frame = docs_of(spark, rows, "doc_id int, a int, b double")
    members = docs_of(spark, list(cluster.items()), "doc_id int, cluster string")
    got = {r.doc_id for r in corpus.keep_best(frame, members, ["a", "b"]).collect()}
    best = {}
    for i, a, b in rows:
        place = (a is None, -(a or 0), b is None, -(b or 0), i)
        if cluster[i] is not None:
            best[cluster[i]] = min(best.get(cluster[i], place), place)
    assert got == {p[-1] for p in best.values()} | {i for i in cluster if cluster[i] is None}


# Counts


def test_sketches_against_exact_values(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(400)) + f" d{i % 6000}", f"s{rng.randrange(3)}", rng.choice("ab")) for i in range(12_000)]
    frame = docs_of(spark, rows, "doc_id int, text string, source string, lang string")
    got = corpus.corpus_stats(frame, ["source", "lang"]).collect()
    assert len(got) == 6 + 3 + 2 + 1
    for r in got:
        own = [t for _, t, s, x in rows if r.source in (None, s) and r.lang in (None, x)]
        sizes = sorted(len(t.split()) for t in own)
        assert (r.documents, r.words, r.fewest, r.most) == (len(own), sum(sizes), sizes[0], sizes[-1])
        distinct = len(set(own))
        assert abs(r.texts - distinct) <= 0.05 * distinct
        for q, value in ((0.5, r.words_p50), (0.9, r.words_p90), (0.99, r.words_p99)):
            below = sum(s < value for s in sizes) / len(sizes)
            upto = sum(s <= value for s in sizes) / len(sizes)
            assert below - 0.03 <= q <= upto + 0.03


def test_counts_of_nulls_and_levels(spark):
    frame = docs_of(spark, [(1, None, None), (2, "a b", "x"), (3, " ", "x")], "doc_id int, text string, source string")
    got = {(r.source, r.level): (r.documents, r.blank, r.words, r.chars) for r in corpus.corpus_stats(frame, ["source"]).collect()}
    assert got == {(None, 0): (1, 1, 0, 0), ("x", 0): (2, 1, 2, 4), (None, 1): (3, 2, 2, 4)}


# Replay


@pytest.mark.parametrize("rate", [0.0, 0.001, 0.1, 0.5, 1.0])
def test_replay_takes_its_share_of_each_stratum(spark, rate):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold") for i in range(6000)] + [(9000, "one"), (9001, "two"), (9002, "two")]
    frame = docs_of(spark, rows, "doc_id int, source string")
    got = corpus.replay_sample(frame, rate, ["source"]).collect()
    sizes, taken = {}, {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + 1
    assert taken == {s: math.ceil(round(rate * n, 6)) for s, n in sizes.items() if rate}
    again = corpus.replay_sample(frame.repartition(7), rate, ["source"]).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in again)


def test_replay_grows_with_its_rate_and_settles_ties(spark):
    frame = docs_of(spark, [(i % 50, str(i)) for i in range(1000)], "doc_id int, text string")
    few, many = (
        {(r.doc_id, r.text) for r in corpus.replay_sample(frame.repartition(n), rate, []).collect()}
        for n, rate in ((3, 0.1), (5, 0.3))
    )
    assert len(few) == 100 and len(many) == 300 and few <= many
    with pytest.raises(ValueError):
        corpus.replay_sample(frame, 1.5, [])


# Licences and categories


def test_licences(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0, all\nrights reserved. All Rights Reserved.", "a"),
        (2, "the MIT license; GNU Lesser General  Public License", "a"),
        (3, "submit licenses, permit license", "b"),
        (4, None, None),
        (5, "Apache License, Version 2.0", "b"),
    ]
    found = corpus.licence_scan(docs_of(spark, rows, "doc_id int, text string, source string"))
    got = {r.doc_id: (r.licences, r.n_notices) for r in found.collect()}
    assert got == {1: (["cc-by-nc", "reserved"], 3), 2: (["mit", "gpl"], 2), 3: ([], 0), 4: ([], 0), 5: (["apache-2.0"], 1)}
    by = {(r.source, r.licence, r.level): (r.documents, r.notices) for r in corpus.licences_by_source(found).collect()}
    assert by[("a", None, 1)] == (2, 5) and by[(None, None, 3)] == (5, 6) and by[("b", "none", 0)] == (1, 0)
    assert by[(None, "none", 0)] == (1, 0) and by[(None, None, 1)] == (1, 0)


def test_categories_by_prefix(spark):
    frame = docs_of(spark, [(1, "a b", "web1"), (2, "c", "web12"), (3, "d", "x"), (4, None, None)], "doc_id int, text string, source string")
    seeds = local_table(spark, [("web", "k", "p"), ("web1", "k", "p"), ("web12", "t", "q")], "prefix string, category string, kind string")
    got = {(r.category, r.kind, r.level): (r.sources, r.documents, r.words) for r in corpus.seed_categories(frame, seeds).collect()}
    assert got[("k", "p", 0)] == (2, 2, 3) and got[("t", "q", 0)] == (1, 1, 1) and got[("none", "none", 0)] == (1, 2, 1)
    assert got[("k", None, 1)] == (2, 2, 3)


# Dialogues


def flags(spark, turns, **more):
    frame = docs_of(spark, turns, "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.validate_conversations(frame, **more).collect()
    return {r.conv_id: {f for f in r.__fields__[2:] if not r[f]} for r in rows}


def test_validation_names_the_broken_rules(spark):
    good = [(0, "system", "s"), (1, "user", "u"), (2, "assistant", "a"), (3, "user", "u"), (4, "assistant", "a")]
    cases = {
        1: (good, set()),
        2: (good[1:], {"contiguous"}),  # does not begin with 0
        3: (good[:3] + good[4:], {"contiguous", "alternates"}),
        4: (good[:4], {"answered"}),
        5: ([(0, "user", " "), (1, "assistant", None)], {"no_blank"}),
        6: ([(0, "user", "u"), (1, "system", "s"), (2, "assistant", "a")], {"system_first", "alternates"}),
        7: ([(0, "user", "u"), (1, "bot", "a")], {"roles_known", "alternates", "answered"}),
        8: ([(0, "user", "u"), (0, "user", "u"), (1, "assistant", "a")], {"contiguous", "alternates"}),
        9: ([(0, "assistant", "a")], {"alternates"}),
        10: ([(None, "user", "u")], {"contiguous", "answered", "alternates"}),
        11: ([(0, None, "u"), (1, "assistant", "a")], {"roles_known", "alternates"}),
        None: (good[1:3], {"contiguous"}),
    }
    got = flags(spark, [(c, *turn) for c, (turns, _) in cases.items() for turn in turns])
    for c, (_, broken) in cases.items():
        assert got[c] - {"valid"} == broken, c
        assert ("valid" in got[c]) == bool(broken)


def test_a_dialogue_over_many_blocks(spark):
    n = 70_000
    turns = spark.range(n).selectExpr(
        "CAST(1 AS BIGINT) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'x' AS text"
    )
    [r] = conversations.validate_conversations(turns).collect()
    assert r.valid and r.n_turns == n
    [r] = conversations.validate_conversations(turns.where("turn != 65536")).collect()
    assert not r.contiguous and not r.alternates
    small = [(1, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(40)]
    assert flags(spark, small, size=7) == {1: set()}
    assert flags(spark, [t for t in small if t[1] != 14], size=7)[1] >= {"contiguous", "alternates"}


# Filters


def greedy(words, phrases):
    n = weight = i = 0
    while i < len(words):
        fits = [p for p in phrases if words[i : i + len(p)] == p]
        if not fits:
            i += 1
            continue
        p = max(fits, key=len)
        n, weight, i = n + 1, weight + phrases[p], i + len(p)
    return n, weight


def test_lexicon_against_a_loop(spark):
    rng = random.Random(4)
    phrases = {("a",): 1, ("a", "b"): 3, ("b", "c", "a"): 7, ("c",): 2, ("a", "b", "c", "d"): 20, ("é", "a"): 5}
    rows = [(i, " ".join(rng.choice(["A", "b", "c", "d", "é", "zz", "b-c"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "a b c d" * 3)]
    listed = [(" ".join(p), w) for p, w in phrases.items()] + [("A", 0), ("", 9)]
    got = filters.domain_filter_lexicon(docs_of(spark, rows), listed, per_thousand=1500).collect()
    for r in got:
        words = (r.text or "").lower().replace("-", " ").split()
        n, weight = greedy(tuple(words), phrases)
        assert (r.n_words, r.n_phrases, r.weight) == (len(words), n, weight), r
        assert r.in_domain == (len(words) > 0 and weight >= 1.5 * len(words))
    assert filters.domain_filter_lexicon(docs_of(spark, []), listed, 1).count() == 0


def test_lexicons_that_cannot_be_used(spark):
    with pytest.raises(ValueError, match="bytes"):
        filters.domain_filter_lexicon(docs_of(spark, []), [("w" * filters.LEXICON_BYTES, 1)], 1)
    with pytest.raises(ValueError, match="without"):
        filters.domain_filter_lexicon(docs_of(spark, []), [("...", 1)], 1)


def test_model_tells_held_out_documents_apart(spark, tmp_path):
    rng = random.Random(5)
    domain, other = [f"d{i}" for i in range(60)], [f"o{i}" for i in range(60)]
    rows = []
    for i in range(900):
        y = i % 2
        words = rng.choices(domain if y else other, k=5) + rng.choices([f"c{j}" for j in range(200)], k=15)
        rows.append((i, " ".join(rng.sample(words, 20)), y))
    rows += [(2000, None, None), (2001, "", None), (2002, "d1 d2", None)]
    frame = docs_of(spark, rows, "doc_id int, text string, label int").withColumn("domain_score", F.lit("old"))
    path = str(tmp_path / "model")
    filters.fit_domain_model(frame.where("doc_id % 3 != 0 OR label IS NULL"), path)
    scored = filters.score_domain_model(frame, path)
    assert scored.count() == len(rows) and scored.columns == ["doc_id", "text", "label", "domain_score", "in_domain"]
    held = scored.where("doc_id % 3 = 0 AND label IS NOT NULL")
    assert held.where("in_domain = (label = 1)").count() >= 0.95 * held.count()
    assert all(0 <= r.domain_score <= 1 for r in scored.collect())
