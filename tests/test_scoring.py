import itertools
from decimal import ROUND_CEILING, Decimal

import hashlib

import pytest
from conftest import column
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom.functions.severity import with_base_score
from scoreloom.operators import aggregate, scoring
from scoreloom.plans import evaluation

BARE = "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


def values(spark, scorer, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, t string, g string")
    scored = df.select("i", scorer(F.col("t"), F.col("g")).alias("v")).orderBy("i")
    return column(scored, "v")


def exact_score(av, ac, pr, ui, s, c, i, a):
    """Base score in exact decimals."""
    d = Decimal
    impact = {"H": d("0.56"), "L": d("0.22"), "N": d(0)}
    iss = 1 - (1 - impact[c]) * (1 - impact[i]) * (1 - impact[a])
    changed = s == "C"
    sub = d("7.52") * (iss - d("0.029")) - d("3.25") * (iss - d("0.02")) ** 15
    sub = sub if changed else d("6.42") * iss
    if sub <= 0:
        return 0.0
    privileges = {"N": "0.85", "L": "0.68", "H": "0.5"} if changed else {"N": "0.85", "L": "0.62", "H": "0.27"}
    ease = (
        d("8.22")
        * d({"N": "0.85", "A": "0.62", "L": "0.55", "P": "0.2"}[av])
        * d({"L": "0.77", "H": "0.44"}[ac])
        * d(privileges[pr])
        * d({"N": "0.85", "R": "0.62"}[ui])
    )
    total = min(d(10), (sub + ease) * (d("1.08") if changed else 1))
    return float(total.quantize(d("0.1"), rounding=ROUND_CEILING))


def test_every_severity_vector(spark):
    domains = ["NALP", "LH", "NLH", "NR", "UC", "NLH", "NLH", "NLH"]
    names = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]
    rows = []
    for combo in itertools.product(*domains):
        rows.append(("/".join(f"{n}:{v}" for n, v in zip(names, combo)), exact_score(*combo)))
    assert len(rows) == 2592
    df = spark.createDataFrame(rows, "v string, want double")
    scored = with_base_score(df, "v", "score")
    assert scored.columns == ["v", "want", "score"]
    assert scored.where(~F.col("score").eqNullSafe(F.col("want"))).count() == 0


def test_severity_vector_validity(spark):
    cases = {
        BARE: 9.8,
        BARE.replace("S:U", "S:C"): 10.0,
        "CVSS:3.0/" + BARE: 9.8,
        "CVSS:3.1/" + BARE + "/E:P": 9.8,
        "CVSS:3.2/" + BARE: None,
        "A:H/I:H/C:H/S:U/UI:N/PR:N/AC:L/AV:N": 9.8,
        BARE + "/A:H": None,
        BARE + "/": None,
        BARE.replace("AV:N", "AV:Q"): None,
        BARE.replace("/A:H", ""): None,
        BARE + "\n": None,
        "": None,
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    assert column(with_base_score(df, "v", "s").orderBy("i"), "s") == list(cases.values())


def test_severity_distance(spark):
    odd = BARE.replace("AV:N", "AV:ZZ")
    cases = [
        (None, BARE, 10.0),
        ("nothing", BARE, 10.0),
        (odd, odd, 0.0),
        (odd, BARE, 10.0),
        (BARE, odd, 10.0),
        (f" CVSS:3.0/{BARE} ", BARE, 0.0),
        (BARE.replace("C:H/I:H/A:H", "C:N/I:N/A:N"), BARE, 9.8),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, text string, gold string, want double")
    got = scoring.severity_distance(df).orderBy("i")
    assert column(got, "mad") == [c[2] for c in cases]
    similar = got.select("i", scoring.severity_similarity(F.col("mad")).alias("s")).orderBy("i")
    assert column(similar, "s")[0] == 0.0 and column(similar, "s")[2] == 1.0


def test_letter_and_weakness(spark):
    assert values(spark, scoring.mcq_regex, [("b: B", " B"), ("B", "b "), ("", "A"), (None, "A"), ("?", "A")]) == [
        1.0, 1.0, 0.0, 0.0, 0.0,
    ]
    assert values(spark, scoring.weakness_id, [(" CWE-1 CWE-2\n", "CWE-2"), (" x ", "x"), ("CWE-2", "CWE-2 "), (None, "x")]) == [
        1.0, 1.0, 0.0, 0.0,
    ]


def test_matches(spark):
    pairs = [(" A\n", " A"), ("A because", " A"), ("", ""), (" ", ""), (None, ""), ("B", "A"), ("x", " ")]
    assert values(spark, scoring.exact_match, pairs) == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert values(spark, scoring.prefix_match, pairs) == [1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_technique_f1(spark):
    pairs = [
        ("none", ""),
        ("T1001", ""),
        ("none", "T1001"),
        (None, ""),
        ("T1001 T1002", "T1003"),
        ("T1001.001 T1002 T1003", "T1001, T1002.002, T1001"),
    ]
    p, r = 2 / 3, 2 / 2
    want = [1.0, 0.0, 0.0, 0.0, 0.0, 2 * (p * r) / (p + r)]
    assert values(spark, scoring.technique_f1, pairs) == want


def test_loglikelihood_ties(spark):
    rows = [("m", "t", 1, i, x, g) for i, (x, g) in enumerate([(-2.0, 1), (-1.0, 1), (-1.0, 1)])]
    rows += [("m", "t", 2, i, -1.0, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "model string, task string, item_id long, choice_idx int, logprob double, gold_index int")
    for n in (4, 7, None):
        got = {r.item_id: (r.picked, r.value) for r in scoring.loglikelihood_choice(df, n).collect()}
        assert got == {1: (1, 1.0), 2: (0, 0.0)}
    with pytest.raises(PySparkException, match="choice out of range in t"):
        scoring.loglikelihood_choice(df, 3).collect()
    below = df.withColumn("choice_idx", F.col("choice_idx") - 1)
    holes = df.withColumn("logprob", F.when(F.col("item_id") == 1, F.when(F.col("choice_idx") == 0, -9.0)))
    for n in (4, None):
        with pytest.raises(PySparkException, match="choice out of range in t"):
            scoring.loglikelihood_choice(below, n).collect()
        got = {r.item_id: (r.picked, r.value) for r in scoring.loglikelihood_choice(holes, n).collect()}
        assert got == {1: (0, 0.0), 2: (None, 0.0)}
    arrays = df.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("choice_idx", "logprob"))).alias("c"))
    best = arrays.select("item_id", scoring.best_choice(F.transform("c", lambda x: x["logprob"])).alias("b"))
    assert {r.item_id: r.b for r in best.collect()} == {1: 1, 2: 0}


def test_unknown_scorer_is_an_error(spark):
    df = spark.createDataFrame([("m", "t", 1, "A", "A", ["nope"])], "model string, task string, item_id int, text string, gold string, metrics array<string>")
    with pytest.raises(PySparkException, match="no scorer named nope"):
        scoring.score_multi_metric(df).collect()


def test_register_scorer_keeps_the_first(spark):
    before = scoring.SCORERS["mcq_regex"]
    other = scoring.Scorer("x", lambda t: t, lambda t, g: F.lit(0.0))
    assert not scoring.register_scorer("mcq_regex", other)
    assert scoring.SCORERS["mcq_regex"] is before
    assert scoring.register_scorer("tests_only", other)
    del scoring.SCORERS["tests_only"]


def test_golden_standard_error(spark):
    rows = [("m", "t", "acc", 1.0 if i < 447 else 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "model string, task string, metric string, value double")
    row = aggregate.task_scores(df).first()
    assert row.value == pytest.approx(0.894, abs=1e-12) and row.n == 500
    assert row.stderr == pytest.approx(0.013780704467887733, abs=1e-15)
    assert aggregate.task_scores(df.limit(1)).first().stderr is None


def test_all_is_unweighted(spark):
    rows = [("m", "a", "acc", 1.0)] * 9 + [("m", "b", "acc", 0.0)]
    df = spark.createDataFrame(rows, "model string, task string, metric string, value double")
    total = aggregate.all_rollup(aggregate.task_scores(df)).first()
    assert (total.task, total.value, total.n) == ("all", 0.5, 10)


def test_wide_scores_equal_long_scores(spark):
    rows = [("m", "t", i, float(i % 2), float(i % 3 == 0)) for i in range(30)]
    wide = spark.createDataFrame(rows, "model string, task string, item_id int, acc double, em double")
    long = scoring.to_sample_scores(wide, ["acc", "em"])
    a = {tuple(r) for r in aggregate.task_scores(long).select("metric", "value", "stderr", "n").collect()}
    b = {tuple(r) for r in aggregate.task_scores_wide(wide, ["acc", "em"]).select("metric", "value", "stderr", "n").collect()}
    assert a == b


def test_score_responses_joins_what_was_extracted(spark):
    responses = spark.createDataFrame(
        [("m", "t", 1, ["B\nA"]), ("m", "t", 2, []), ("m", "t", 3, None), ("m", "u", 1, ["see CWE-9"])],
        "model string, task string, item_id long, texts array<string>",
    )
    prompts = spark.createDataFrame(
        [("t", 1, " B"), ("t", 2, " A"), ("t", 3, " A"), ("u", 1, "CWE-9")], "task string, item_id long, gold string"
    )
    tasks = spark.createDataFrame(
        [("t", ["mcq_regex", "exact_match"], ["\n"]), ("u", ["weakness_id"], None)],
        "task string, metrics array<string>, stops array<string>",
    )
    checked = scoring.score_responses(responses, prompts, tasks)
    got = {(r.task, r.item_id, r.metric): r.value for r in checked.accepted.collect()}
    assert checked.rejected.count() == 0
    assert got == {
        ("t", 1, "acc"): 1.0, ("t", 1, "em"): 1.0,
        ("t", 2, "acc"): 0.0, ("t", 2, "em"): 0.0,
        ("t", 3, "acc"): 0.0, ("t", 3, "em"): 0.0,
        ("u", 1, "acc"): 1.0,
    }


def test_what_was_not_answered_scores_zero(spark):
    schema = "model string, task string, item_id long, texts array<string>"
    responses = spark.createDataFrame([("m", "t", 1, ["A"]), ("m", "v", 1, ["A"]), ("m", "t", 9, ["A"]), ("n", "u", 1, ["A"])], schema)
    prompts = spark.createDataFrame([("t", 1, " A"), ("t", 2, " A"), ("u", 1, " A")], "task string, item_id long, gold string")
    tasks = spark.createDataFrame(
        [("t", ["mcq_regex"], None), ("u", ["mcq_regex"], None)], "task string, metrics array<string>, stops array<string>"
    )
    checked = evaluation.evaluate_generated(responses, prompts, tasks)
    got = {(r.model, r.task): (r.value, r.n) for r in checked.accepted.collect()}
    assert got == {("m", "t"): (0.5, 2), ("m", "all"): (0.5, 2), ("n", "u"): (1.0, 1), ("n", "all"): (1.0, 1)}
    assert {tuple(r) for r in checked.rejected.collect()} == {("m", "v", "no such task", 1), ("m", "t", "no such item", 1)}
    wrong = tasks.withColumn("metrics", F.array(F.lit("nope")))
    with pytest.raises(PySparkException, match="no scorer named nope"):
        scoring.score_responses(responses, prompts, wrong).accepted.collect()


def test_two_scorers_of_one_metric(spark):
    df = spark.createDataFrame(
        [("m", "t", 1, "A", "A", ["mcq_regex", "weakness_id"])],
        "model string, task string, item_id int, text string, gold string, metrics array<string>",
    )
    with pytest.raises(PySparkException, match="two scorers of one metric"):
        scoring.score_multi_metric(df).collect()
    rows = [("m", "t", "acc", "a", 1.0), ("m", "t", "acc", "b", 0.0)]
    samples = spark.createDataFrame(rows, "model string, task string, metric string, scorer string, value double")
    assert sorted((r.scorer, r.value) for r in aggregate.task_scores(samples).collect()) == [("a", 1.0), ("b", 0.0)]


def test_delta_and_judged(spark):
    rows = [("a", "s", "acc", 0.5), ("b", "s", "acc", 0.75), ("b", "x", "acc", 1.0)]
    scores = spark.createDataFrame(rows, "model string, suite string, metric string, value double")
    got = {(r.model, r.suite): r.delta for r in aggregate.model_delta(scores, "a").collect()}
    assert got == {("a", "s"): 0.0, ("b", "s"): 25.0, ("b", "x"): None}
    judged = spark.createDataFrame([("a", "d", 1, 4.0), ("a", "d", 2, None), ("a", "d", 3, 8.0)], "model string, dimension string, item_id int, score double")
    row = aggregate.judge_score_rollup(judged).first()
    assert (row.value, row.n, row.n_unjudged) == (6.0, 2, 1)


def test_responses_without_a_model_and_repeated_ones_are_rejects(spark, monkeypatch):
    monkeypatch.setattr(scoring, "STEP", 3)
    rows = [("m", "t", 1, ["A"])] * 9 + [("m", "t", 2, ["B"]), ("m", "t", 2, ["A"]), ("m", "t", 2, None), (None, "t", 1, ["A"])]
    rows += [("m", "t", None, ["A"]), ("m", None, 1, ["A"])]
    responses = spark.createDataFrame(rows, "model string, task string, item_id int, texts array<string>")
    prompts = spark.createDataFrame([("t", 1, "A"), ("t", 2, "A"), ("t", 3, "A")], "task string, item_id int, gold string")
    tasks = spark.createDataFrame([("t", ["exact_match"], [])], "task string, metrics array<string>, stops array<string>")
    checked = scoring.score_responses(responses, prompts, tasks)
    # The least MD5 of A and B is A's; an answer counts once, and a prompt without one too.
    scores = {(r.item_id, r.value) for r in checked.accepted.collect()}
    assert checked.accepted.count() == 3 and {i for i, _ in scores} == {1, 2, 3}
    assert (1, 1.0) in scores and (3, 0.0) in scores
    kept = min(["A", "B"], key=lambda x: hashlib.md5(x.encode()).hexdigest())
    assert (2, float(kept == "A")) in scores
    counts = {(r.model, r.task, r.reason): r.n for r in scoring.count_rejects(checked.rejected).collect()}
    assert counts == {
        ("m", "t", "repeated response"): 10, (None, "t", "no model"): 1, ("m", "t", "no such item"): 1,
        ("m", None, "no such task"): 1,
    }
    assert checked.rejected.count() + 2 == len(rows)
