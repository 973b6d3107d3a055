import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.functions import labels, wording
from scoreloom.operators import prompts, sampling, validation

OPT = "array<struct<key:string,text:string>>"


def built(spark, rows, schema, formatter, **options):
    df = spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], f"task string, item_id long, {schema}")
    checked = prompts.build_prompts(df, formatter, **options)
    good = {r.item_id: r for r in checked.accepted.collect()}
    bad = {int(r.key): (r.reason, list(r.missing)) for r in checked.rejected.collect()}
    return good, bad


def test_listed_mcq_shows_four_options_at_most(spark):
    rows = [
        ("Q", ["a", "b", "c", "d", "e"], "C"),
        ("Q", ["a"], "A"),
        ("Q", [], "A"),
        ("Q", ["a", None], "B"),
        ("Q", ["a"], "c"),
        (None, ["a"], None),
    ]
    good, bad = built(spark, rows, "question string, options array<string>, answer string", "listed_mcq")
    head = wording.LETTERS_ASKED + "\nQuestion: Q\n"
    assert good[0].query == head + "A. a\nB. b\nC. c\nD. d\nAnswer:"
    assert (good[0].gold_index, good[0].gold, good[0].choices) == (2, " C", [" A", " B", " C", " D"])
    assert good[1].query == head + "A. a\nAnswer:"
    assert good[2].query == head + "\nAnswer:"
    assert good[3].query == head + "A. a\nB. None\nAnswer:"
    assert bad == {
        4: ("invalid label", []),
        5: ("missing required value", ["question", "answer"]),
    }


def test_subject_mcq_takes_letters_and_indices(spark):
    rows = [("computer_security", "Q", ["a", "b"], "B"), ("x", "Q", [], "3"), ("x", "Q", ["a"], "E")]
    good, bad = built(
        spark, rows, "subject string, question string, choices array<string>, answer string", "subject_mcq"
    )
    assert good[0].query == (
        "The following are multiple choice questions (with answers) about computer security. "
        "Answer with the option letter from the given choices directly.\n\nQuestion: Q\nA. a\nB. b\nAnswer:"
    )
    assert good[0].instruction.endswith("about computer security. Answer with the option letter from the given choices directly.")
    assert good[0].specific is None
    assert good[1].gold_index == 3 and good[1].query.endswith("Question: Q\nAnswer:")
    assert bad == {2: ("invalid label", [])}


def test_threat_mcq_swaps_the_last_line(spark):
    rows = [(f"P. {wording.THREAT_LAST_LINE} Z", " b\n", "u")]
    schema = "Prompt string, GT string, URL string"
    direct, _ = built(spark, rows, schema, "threat_mcq")
    full, _ = built(spark, rows, schema, "threat_mcq", direct=False)
    assert direct[0].query == f"P. {wording.THREAT_DIRECT} Z" and direct[0].gold_index == 1
    assert direct[0].specific == {"url": "u", "Question": None}
    assert direct[0].instruction == wording.THREAT_ASKED
    assert full[0].query == rows[0][0]


def test_described_prompts(spark):
    schema = "Description string, Prompt string, GT string"
    rows = [("D", f"{wording.WEAKNESS_STORED} more", "CWE-1")]
    direct, _ = built(spark, rows, schema, "weakness")
    full, _ = built(spark, rows, schema, "weakness", direct=False)
    assert direct[0].query == f"{wording.WEAKNESS_ASKED}\n\nCVE Description: D The CWE is"
    assert full[0].query == f"{wording.WEAKNESS_ASKED} more"
    assert (direct[0].choices, direct[0].gold_index, direct[0].gold) == (["CWE-1"], 0, "CWE-1")
    severe, _ = built(spark, rows, schema, "severity")
    assert severe[0].query == f"{wording.SEVERITY_ASKED}\n\nCVE Description: D The CVSS v3.1 vector string is"
    stored, _ = built(spark, rows, schema, "techniques")
    assert stored[0].query == f"{wording.WEAKNESS_STORED} more\n**Extracted Mitre IDs**:"


def test_inline_options_keep_their_order(spark):
    rows = [("Q", [("B", "x"), ("A", "y"), ("E", "z")], "a")]
    good, _ = built(spark, rows, f"question string, answers {OPT}, solution string", "inline_options")
    assert good[0].query == (
        "Question: Q\nOptions: B) x, A) y, E) z\n\nChoose the correct answer (A, B, C, or D) only.\nAnswer:"
    )
    assert good[0].gold_index == 0


def test_boolean(spark):
    rows = [("P", "Q", "X"), ("P", "Q", "x")]
    good, bad = built(spark, rows, "prompt string, question string, answer string", "boolean")
    assert (good[0].query, good[0].gold_index, good[0].choices) == ("P\nAnswer:", 2, [" T", " F", " X"])
    assert good[0].specific == {"question": "Q", "url": None} and list(bad) == [1]
    assert good[0].instruction is None


def test_multi_answer(spark):
    rows = [("Q", ["A: a", "B: b"], " ab\n"), ("Q", [], ""), ("Q", [], "BA")]
    schema = "question string, choices array<string>, answer string"
    good, bad = built(spark, rows, schema, "multi_answer")
    assert good[0].query == f"{wording.ANSWER_SET_ASKED}\n\nQuestion: Q A: a B: b\nAnswer:"
    assert good[0].gold == " AB" and good[1].gold_index == 15 and list(bad) == [2]
    shown, _ = built(spark, rows, schema, "multi_answer", examples="EX")
    assert shown[0].query == f"{wording.ANSWER_SET_ASKED}\n\nEX\nQuestion: Q A: a B: b\nAnswer:"


def test_context_mcq(spark):
    four = [("A", "1"), ("B", "2"), ("C", "3"), ("D", "4")]
    rows = [("Q", four, "D", "C!"), ("Q", four[::-1], "D", ""), ("Q", four[:3], "A", "x"), ("Q", four, "d", None)]
    schema = f"question string, answers {OPT}, solution string, content string"
    good, bad = built(spark, rows, schema, "context_mcq")
    body = "Question: Q\nA. 1\nB. 2\nC. 3\nD. 4\nAnswer:"
    assert good[0].query == f"{wording.LETTERS_ASKED}\nContext: C!\n\n{body}"
    assert good[1].query == f"{wording.LETTERS_ASKED}\n{body}"
    assert bad == {2: ("choice without text", ["D"]), 3: ("invalid label", [])}
    plain, _ = built(spark, rows, schema, "context_mcq", include_context=False)
    assert plain[0].query == f"{wording.LETTERS_ASKED}\n{body}"
    absent, _ = built(spark, [r[:3] for r in rows], schema.rsplit(",", 1)[0], "context_mcq")
    assert absent[0].query == f"{wording.LETTERS_ASKED}\n{body}"


def test_absent_column_fails_before_reading(spark):
    df = spark.createDataFrame([("t", 1, "Q")], "task string, item_id long, question string")
    with pytest.raises(ValueError, match="options.*answer"):
        prompts.build_prompts(df, "listed_mcq")


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([(1, "A"), (2, "Z")], "item_id long, label string")
    checked = validation.require_gold(df, labels.gold_index_strict(F.col("label")))
    with pytest.raises(PySparkException, match="invalid label"):
        validation.raise_on_rejects(checked).collect()
    fine = validation.require_gold(df.where("item_id = 1"), labels.gold_index_strict(F.col("label")))
    assert [r.gold_index for r in validation.raise_on_rejects(fine).collect()] == [0]


def test_register_formatter(spark):
    f = prompts.Formatter(["question"], lambda: F.col("question"), "question", None)
    assert prompts.register_formatter("tests_only", f)
    assert not prompts.register_formatter("tests_only", f)
    good, _ = built(spark, [("Q",)], "question string", "tests_only")
    assert good[0].query == "Q"
    del prompts.FORMATTERS["tests_only"]


def test_limit_per_task_on_a_hot_task(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 10).cast("string"))).alias("task"),
        F.col("id").alias("item_id"),
    )
    for n in (1, 5, 300):
        got = sampling.limit_per_task(df, n).groupBy("task").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect()
        for r in got:
            every = [i for i in range(2000) if (r.task == "hot") == (i % 10 < 7) and (r.task == "hot" or r.task == f"t{i % 10}")]
            assert r.ids == every[:n]


def test_limit_waits_until_it_is_asked_for(spark):
    df = spark.createDataFrame([("t", 1, "q", "a")], "task string, item_id long, query string, answer string")
    spark.sparkContext.setJobGroup("lazy limit", "lazy")
    sampling.attach_few_shots(sampling.limit_per_task(df, 1), df, 2, allow_none=True)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy limit") == []
    spark.sparkContext.setJobGroup("", "")


def test_limit_with_null_ids_and_tasks(spark):
    rows = [("t", None), ("t", 1), ("t", 2), ("t", 3), (None, 5), (None, 4), (None, None), ("u", None), ("u", None)]
    df = spark.createDataFrame(rows, "task string, item_id long")
    for n in (1, 2, 3, 4):
        got = sorted(map(tuple, sampling.limit_per_task(df, n).collect()), key=str)
        want = []
        for task in ("t", None, "u"):
            own = sorted((i for t, i in rows if t == task), key=lambda i: (i is None, i or 0))
            want += [(task, i) for i in own[:n]]
        assert got == sorted(want, key=str)


def test_limit_with_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([("t", 1)] * 5 + [("t", 0), ("u", 7)], "task string, item_id long")
    got = sorted(map(tuple, sampling.limit_per_task(df, 3).collect()))
    assert got == [("t", 0), ("t", 1), ("t", 1), ("u", 7)]
    assert sampling.limit_per_task(df.where("item_id > 99"), 3).count() == 0


def few_shot_rows(spark):
    rows = [("t", i, f"q{i}", f" a{i}") for i in range(4)] + [("u", 9, "q9", " a9")]
    return spark.createDataFrame(rows, "task string, item_id long, query string, answer string")


def test_few_shots_leave_the_item_itself_out(spark):
    pool = few_shot_rows(spark)
    got = {r.item_id: r.query for r in sampling.attach_few_shots(pool, pool, 2, allow_none=True).collect()}
    assert got == {
        0: "q1 a1\n\nq2 a2\n\nq0",
        1: "q0 a0\n\nq2 a2\n\nq1",
        2: "q0 a0\n\nq1 a1\n\nq2",
        3: "q0 a0\n\nq1 a1\n\nq3",
        9: "q9",
    }


def test_few_shots_by_row(spark):
    pool = few_shot_rows(spark)
    asked = pool.withColumn("shots", (F.col("item_id") % 3).cast("int"))
    got = {r.item_id: r.query for r in sampling.attach_few_shots(asked, pool, F.col("shots"), 2).collect()}
    assert got[0] == "q0" and got[1] == "q0 a0\n\nq1" and got[2] == "q0 a0\n\nq1 a1\n\nq2"


def test_shots_without_examples_are_an_error(spark):
    pool = few_shot_rows(spark)
    with pytest.raises(PySparkException, match="no examples for task u"):
        sampling.attach_few_shots(pool, pool, 1).collect()
    with pytest.raises(PySparkException, match="no examples for task t"):
        sampling.attach_few_shots(pool.where("task = 't'"), pool.limit(0), 5).collect()


def test_null_options(spark):
    rows = [("q", [("A", "x"), ("B", None)], "A")]
    schema = "question string, answers array<struct<key:string,text:string>>, solution string"
    good, _ = built(spark, rows, schema, "inline_options")
    assert "Options: A) x, B) None\n" in good[0].query
    good, bad = built(spark, [("q", ["x", None], "A"), ("q", ["x", "y"], "A")], "question string, choices array<string>, answer string", "multi_answer")
    assert len(good) == 1 and bad == {0: ("choice without text", ["1"])}


def test_few_shots_of_zero_change_nothing(spark):
    pool = few_shot_rows(spark)
    assert sampling.attach_few_shots(pool, pool, 0) is pool
