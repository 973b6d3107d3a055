"""The corpus pipeline: each stage's decisions, whole tables, odd tables."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline as cp
from scoreloom.llm import decontaminate, line_chunks, near_dedup, rows


def stage(name):
    return dict(cp.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage made of the smallest tables, read back."""
    docs = rows.table(spark, SF, "documents")
    found = [docs]
    for name, fn in cp.STAGES:
        found.append(cp.written(fn(spark, found[-1], SF), name))
    return found


def test_columns_and_rows(steps):
    docs = steps[0]
    for out in steps[1:-1]:
        assert out.dtypes == docs.dtypes
        assert out.count() <= docs.count()
        assert out.select("doc_id").distinct().count() == out.count()
    assert steps[-1].count() == steps[-2].count()
    assert cp.run(docs.sparkSession, SF).count() == steps[-1].count()


def test_decisions_take_effect(spark, steps):
    _, clean, lines, near, last, mixed = steps
    changed = clean.select("doc_id", F.col("text").alias("before")).join(lines, "doc_id").filter("before != text")
    assert changed.count() > 0
    assert changed.filter("n_chars != length(text)").count() == 0
    again = line_chunks.remove_repeated(lines.select("doc_id", "text")).filter("n_removed > 0")
    assert again.count() <= changed.count() / 5
    assert near_dedup.near_duplicates(near.select("doc_id", "text")).filter("NOT kept").count() == 0
    benchmark = rows.table(spark, SF, "benchmark")
    assert decontaminate.find_contamination(last, benchmark).filter("contaminated").count() == 0
    total = mixed.agg(F.sum("size"), F.sum("taken")).first()
    assert 0.9 * total[0] <= total[1] <= total[0]


def odd_tables(spark, folder):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    passage = prose(30)
    docs = [(i, prose(60), "en", f"s{i % 3}", 1, "kept", 0.5) for i in range(40)]
    docs += [
        (100, None, None, None, None, None, None),
        (101, "", "en", "s1", 0, "", 1.0),
        (102, docs[0][1], "en", "s1", 1, "x", 1.0),
        (0, docs[0][1], "en", "s0", 1, "kept", 0.5),
        (None, prose(50), "en", "s2", 1, "x", 1.0),
        (103, prose(20) + " " + passage, "en", "s0", 1, "x", 1.0),
        (104, "grumblor " * 3 + prose(50), "en", "s0", 1, "x", 1.0),
        (105, prose(30_000), "en", "s0", 1, "x", 1.0),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, score double"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    toxic = [(i, 1, int(i % 4 == 0)) for i in range(40)] + [(None, 1, 1), (104, None, 1)]
    spark.createDataFrame(toxic, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_and_clashing_names(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    docs = rows.table(spark, str(tmp_path), "documents")
    for name in ("line_dedup", "near_dedup", "decontamination"):
        out = stage(name)(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert {100, 101, None, 105, *range(1, 40)} <= set(ids), name
        assert out.filter("doc_id = 101").select("spans", "score").first() == ("", 1.0)
    near = [r.doc_id for r in stage("near_dedup")(spark, docs, str(tmp_path)).collect()]
    assert near.count(0) == 1 and 102 not in near
    clean = {r.doc_id for r in stage("decontamination")(spark, docs, str(tmp_path)).collect()}
    assert 103 not in clean
    toxic = stage("toxicity")(spark, docs, str(tmp_path))
    assert toxic.dtypes == docs.dtypes and {100, 101} <= {r.doc_id for r in toxic.collect()}
    assert cp.run(spark, str(tmp_path)).count() > 20


def test_empty_tables(spark, tmp_path):
    odd_tables(spark, str(tmp_path / "odd"))
    for t in ("documents", "labels", "benchmark"):
        rows.table(spark, str(tmp_path / "odd"), t).limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_near_duplicates_go_by_row(spark):
    """Null ids, and ids with several texts: one document of each group and every other text stay."""
    rng = random.Random(21)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f, g = (prose() for _ in range(7))
    docs = [
        (1, a), (None, a + " end"), (None, b), (None, c), (None, c), (None, c + " end"),  # nulls: b and one c stay
        (2, a + " more"), (2, d), (3, d + " end"), (9, d + " more"),  # d's group has id 2 as first
        (5, e), (5, f), (5, f), (6, g), (6, g + " end"), (7, None), (7, None), (None, None), (None, None), (8, ""),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, frame, "").collect()]
    assert len(got) == len(set(got)) + 1  # the rows without an id and a text
    last = [x for x in got if x[0] == 6 or (x[0] is None and x[1] and x[1].startswith(c))]
    assert len(last) == 2 and {x[0] for x in last} == {6, None}
    rest = [x for x in got if x not in last]
    want = [(1, a), (None, b), (2, d), (5, e), (5, f), (7, None), (None, None), (None, None), (8, "")]
    assert sorted(rest, key=str) == sorted(want, key=str)
