import pytest
from conftest import column

from scoreloom.plans import evaluation, registry
from scoreloom.sources import write_benchmark


def test_counts(spark):
    tasks = registry.tasks()
    assert len(tasks) == 38 and len({t.task for t in tasks}) == 38
    table = registry.task_registry(spark)
    assert table.count() == 38
    datasets = registry.distinct_datasets(table)
    assert datasets.count() == 19
    first = {(r.repo, r.subset): r.task for r in datasets.collect()}
    for t in reversed(tasks):
        expected = first[(t.repo, t.subset)]
        assert tasks.index(t) >= [x.task for x in tasks].index(expected)


def test_names_agree_with_rows(spark):
    resolved = registry.resolve_variants(registry.task_registry(spark).drop("generation_size"), registry.task_registry(spark))
    for r in resolved.collect():
        task = registry.tasks()[r.position]
        assert r.known
        assert r.generation_size == task.generation_size
        assert (r.mode == "loglikelihood") == (task.metrics == registry.LL)
        assert (task.stops is None) == (r.mode == "loglikelihood")


def test_unknown_names(spark):
    df = spark.createDataFrame([("cti_bench:cti-rcm",), ("secure:kcv",)], "task string")
    got = registry.resolve_variants(df, registry.task_registry(spark)).collect()
    assert [(r.known, r["mode"]) for r in got] == [(False, None), (False, None)]


def test_suites(spark):
    suites = registry.suite_tasks(registry.curated_suites(spark), registry.task_registry(spark))
    rows = suites.collect()
    assert len(rows) == 28 and all(r.known for r in rows)
    shots = {r.suite: r.shots for r in rows}
    assert shots == {"house_base": 0, "house_instruct": 0, "related_base": 5, "related_instruct": 0}


def test_catalogue(spark):
    got = {r.category: r.n_tasks for r in registry.task_catalogue(registry.task_registry(spark)).collect()}
    assert got == {
        "CyberMetrics": 8, "CTI-Bench": 5, "MMLU": 1, "SECURE": 5, "SecBench": 2, "SecEval": 2, "In-house MCQ": 10,
    }


def test_names_are_parameters(spark):
    table = registry.task_registry(spark, owner="lab", house="ours")
    assert "ours_em:cybersecurity_skills" in column(table, "task")
    assert "lab/ours" in column(table, "repo")


def test_metric_catalogue(spark):
    rows = {r.scorer: (r.metric, r.higher_is_better, r.category) for r in evaluation.metric_catalogue(spark).collect()}
    assert rows["mcq_regex"] == ("acc", True, "generative")
    assert rows["loglikelihood"] == ("acc", True, "logprobs")


def test_evaluations_end_to_end(spark):
    responses = spark.createDataFrame([("m", "t", 1, ["A"]), ("m", "t", 2, ["B"])], "model string, task string, item_id long, texts array<string>")
    prompts = spark.createDataFrame([("t", 1, " A"), ("t", 2, " A")], "task string, item_id long, gold string")
    tasks = spark.createDataFrame([("t", registry.FULL, ["\n"])], "task string, metrics array<string>, stops array<string>")
    scores = evaluation.evaluate_generated(responses, prompts, tasks).accepted
    assert {(r.task, r.metric): r.value for r in scores.collect()} == {
        (t, m): 0.5 for t in ("t", "all") for m in ("acc", "em", "pem")
    }
    choices = spark.createDataFrame([("m", "t", 1, 0, -1.0, 0), ("m", "t", 1, 1, -2.0, 0)], "model string, task string, item_id long, choice_idx int, logprob double, gold_index int")
    assert {(r.task, r.value) for r in evaluation.evaluate_choices(choices).collect()} == {("t", 1.0), ("all", 1.0)}


def test_prompts_of_a_task(spark, tmp_path):
    by_name = {t.task: t for t in registry.tasks()}
    task = by_name["secure:maet_em"]
    rows = [(task.repo, task.subset, "test" if i < 5 else "val", i, f"q{i}", ["x", "y"], "AB?"[i % 3]) for i in range(8)]
    rows.append((task.repo, "CWET", "test", 99, "other", ["x"], "A"))
    schema = "repo string, subset string, split string, item_id long, question string, options array<string>, answer string"
    write_benchmark(spark.createDataFrame(rows, schema), str(tmp_path))
    checked = evaluation.task_prompts(spark, str(tmp_path), task, shots=1, max_samples=3)
    got = {r.item_id: r.query for r in checked.accepted.collect()}
    assert sorted(got) == [0, 1, 3] and column(checked.rejected, "key") == ["2"]
    assert got[0].count("Answer:") == 2 and "Question: q6" in got[0] and got[0].endswith("Answer:")
    assert "Answer: A\n\n" in got[0]
    with pytest.raises(ValueError, match="needs its block"):
        evaluation.task_prompts(spark, str(tmp_path), by_name["seceval:mcqa_5s"])


def test_layout_switches():
    options = {t.task: evaluation.formatter_options(t) for t in registry.tasks()}
    assert options["cti_bench:cti-mcq"] == {"direct": True}
    assert options["cti_bench:cti-rcm_em"] == {"direct": False}
    assert options["house_mcq:cybersecurity_skills"] == {"include_context": False}
    assert options["secure:maet"] == {}


def test_subsets_decide_the_layout():
    assert registry.secure_task("vood_em", "VOOD", False).formatter == "boolean"
    assert registry.secure_task("vood_em", "VOOD", False).metrics == registry.MATCHES
    with pytest.raises(ValueError, match="unknown subset"):
        registry.secure_task("x", "X", True)
