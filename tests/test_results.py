import csv
import json
import os

import pytest
from conftest import column
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom import session
from scoreloom.operators import aggregate, results
from scoreloom.plans import evaluation, registry
from scoreloom.sources import benchmark, result_files, sinks, task_lists


def put(root, name, payload):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload), encoding="utf-8")


def run(name, tasks, **extra):
    return {"config_general": {"model_name": name, **extra}, "results": tasks}


def read_csv(path, parts=1):
    names = [f for f in os.listdir(path) if f.endswith(".csv")]
    assert parts is None or len(names) == parts
    rows = []
    for name in names:
        with open(os.path.join(path, name), newline="", encoding="utf-8") as f:
            header, *body = csv.reader(f)
        rows += body
    return [header, *rows]


def sample_folder(root):
    put(root, "o/m1/results_1.json", run("o/m1", {"t|0": {"acc": 0.25, "acc_stderr": 0.5}, "n": 3}))
    put(root, "o/m1/results_2.json", run("o/m1", {"t|0": {"acc": 0.75}, "u|5": {"em": 1}}))
    put(root, "o/m2/deep/er/results_1.json", run("", {"t|0": {"acc": 0.5}}, model_config={"model_name": "o/m2"}))
    put(root, "o/m3/results_1.json", run("o/m3", {"v|0": {}}))
    put(root, "o/bad.json", "{bad")
    put(root, "o/notes.txt", "{}")


def test_pivoted_report(spark, tmp_path):
    sample_folder(tmp_path / "in")
    out = str(tmp_path / "out" / "report.csv")
    report = evaluation.collect_report(spark, str(tmp_path / "in"), out, one_file=True)
    assert report.rows == 3 and report.paths == {"": out}
    assert [tuple(r) for r in report.rejected.collect()] == [(str(tmp_path / "in/o/bad.json"), "not JSON")]
    assert read_csv(out) == [
        ["model", "t|0_acc", "t|0_acc_stderr", "u|5_em"],
        ["m1", "0.75", "0.5", "1"],
        ["m2", "0.5", "", ""],
        ["m3", "", "", ""],
    ]


def test_report_without_stderr_and_by_metric(spark, tmp_path):
    sample_folder(tmp_path / "in")
    out = str(tmp_path / "report.csv")
    evaluation.collect_report(spark, str(tmp_path / "in"), out, include_stderr=False, split=True, one_file=True)
    assert read_csv(str(tmp_path / "report_acc.csv"))[0] == ["model", "t|0_acc"]
    assert read_csv(str(tmp_path / "report_em.csv"))[1] == ["m1", "1"]
    assert not os.path.exists(out)


def test_long_report(spark, tmp_path):
    sample_folder(tmp_path / "in")
    out = str(tmp_path / "long.csv")
    assert evaluation.collect_report(spark, str(tmp_path / "in"), out, pivot=False).rows == 5
    rows = read_csv(out, parts=None)
    assert len(rows) == 6
    assert rows[0] == ["model", "task", "json_path", "acc", "acc_stderr", "em"]
    assert ["m3", "v|0", str(tmp_path / "in/o/m3/results_1.json"), "", "", ""] in rows
    assert ["m1", "u|5", str(tmp_path / "in/o/m1/results_2.json"), "", "", "1"] in rows


def test_no_rows_write_nothing(spark, tmp_path):
    put(tmp_path, "in/x.json", "{}")
    assert evaluation.collect_report(spark, str(tmp_path / "in"), str(tmp_path / "out.csv")).rows == 0
    assert not (tmp_path / "out.csv").exists()


def parsed(spark, *payloads):
    rows = [(f"d/{i}.json", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return result_files.parse_results_tolerant(spark.createDataFrame(rows, "json_path string, value string"))


def test_tolerant_parsing(spark):
    checked = parsed(spark, "{bad", "", '{"results":{"t":{"a":NaN,"b":-Infinity}}}', "[]", '{"results":null}', '{"results":{"t":{"a":{"x":1}}}}')
    assert sorted(column(checked.rejected, "json_path")) == ["d/0.json", "d/1.json"]
    long = results.flatten_results(results.task_entries(checked.accepted)).collect()
    found = {(r.json_path, r.metric): (r.value, r.raw) for r in long}
    assert str(found[("d/2.json", "a")][0]) == "nan" and found[("d/2.json", "b")][0] == float("-inf")
    assert found[("d/5.json", "a")] == (None, '{"x":1}') and len(found) == 3


def test_a_repeated_key_keeps_the_last_value(spark):
    checked = parsed(spark, '{"results":{"t":{"a":1,"a":2}}}')
    assert column(results.flatten_results(results.task_entries(checked.accepted)), "value") == [2.0]


def test_payloads_are_decoded_once(spark):
    files = spark.createDataFrame([("a/b.json", "{}")], "json_path string, value string")
    long = results.flatten_results(results.task_entries(result_files.decode(files)))
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") <= 2 or plan.count("parseJson") <= 2
    assert "Filter" not in plan.split("Generate variant_explode")[-1]


def test_the_later_run_wins_whatever_its_file_is_called(spark, tmp_path):
    for name, time, value in (("z", "2025-01-02", 0.25), ("a", "2025-01-03", 0.75)):
        put(tmp_path, f"{name}.json", run("m", {"t|0": {"acc": value}}, run_time=time))
    files = result_files.scan_result_files(spark, str(tmp_path))
    cells = results.latest_cells(results.flatten_results(results.task_entries(result_files.decode(files))))
    assert column(cells, "value") == [0.75]
    scores = spark.createDataFrame([("m", "t", "acc", 0.5, 0.1, 3)], "model string, task string, metric string, value double, stderr double, shots int")
    sinks.write_result_payloads(scores, str(tmp_path / "p"), "2025-05-05")
    sinks.write_result_payloads(scores.withColumn("value", F.lit(0.1)), str(tmp_path / "p"), "2025-05-04")
    files = result_files.scan_result_files(spark, str(tmp_path / "p"))
    cells = results.latest_cells(results.flatten_results(results.task_entries(result_files.decode(files))))
    assert {(r.task, r.metric): r.value for r in cells.collect()} == {("t|3", "acc"): 0.5, ("t|3", "acc_stderr"): 0.1}


def test_more_names_than_asked_for_are_an_error(spark):
    checked = parsed(spark, {"results": {"t": {f"m{i}": i for i in range(5)}}})
    entries = results.task_entries(checked.accepted)
    with pytest.raises(ValueError, match="more than 4"):
        evaluation.lay_out(entries, most=4)
    assert len(evaluation.lay_out(entries, most=5).columns) == 6


def test_metric_names_with_quotes(spark):
    checked = parsed(spark, {"results": {"t": {'a"b': 1.5, "c'd": 2}}})
    row = results.results_long_table(results.task_entries(checked.accepted)).first()
    assert (row['a"b'], row["c'd"]) == ("1.5", "2")


def test_what_is_written_goes_with_the_application():
    import subprocess
    import sys
    import tempfile

    shared = tempfile.mkdtemp()
    code = (
        "from pyspark.sql import SparkSession\nfrom scoreloom import session\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {shared!r}).getOrCreate()\n"
        "assert session.written(s.range(3), 'x').count() == 3\ns.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert os.listdir(os.path.join(shared, "scoreloom")) == []


def test_model_names(spark):
    one = {"t": {"a": 1}}
    checked = parsed(
        spark,
        {"results": one},
        {"config_general": None, "results": one},
        {"config_general": {"model_name": "", "model_config": {"model_name": "c"}}, "results": one},
        {"config_general": {"model_name": "n", "model_config": {"model_name": "c"}}, "results": one},
    )
    got = results.task_entries(checked.accepted).orderBy("json_path")
    assert column(got, "model") == ["d", "d", "c", "n"]
    paths = spark.createDataFrame([("a/b/c.json",), ("c.json",), ("/c.json",)], "p string")
    assert column(paths.select(results.parent_path(F.col("p")).alias("x")), "x") == ["a/b", ".", "/"]


def test_prefix_trimming(spark):
    cases = [
        (["o/m1", "o/m2"], ["m1", "m2"]),
        (["o/m1", "o/m1"], ["o/m1", "o/m1"]),
        (["o/m1"], ["o/m1"]),
        (["a/b/m1", "a/b/m2", "a/c"], ["b/m1", "b/m2", "c"]),
        (["m1", "o/m2"], ["m1", "o/m2"]),
        (["o/m", "o"], ["m", "o"]),
        (["ab/m1", "abc/m2"], ["ab/m1", "abc/m2"]),
        (["/r/m1", "/r/m2"], ["/r/m1", "/r/m2"]),
        (["/r/m1", "/s/m2"], ["r/m1", "s/m2"]),
    ]
    for before, after in cases:
        df = spark.createDataFrame([(i, m) for i, m in enumerate(before)], "i int, model string")
        assert column(results.trim_model_prefix(df).orderBy("i"), "model") == after, before


def test_groups_by_last_underscore(spark):
    df = spark.createDataFrame([("m", 1, 2, 3, 4)], "model string, `a|0_acc` int, `a|0_acc_stderr` int, `b|0_em_stderr` int, plain int")
    groups = results.split_by_metric(df)
    assert {g: t.columns for g, t in groups.items()} == {
        "acc": ["model", "a|0_acc"],
        "stderr": ["model", "a|0_acc_stderr", "b|0_em_stderr"],
        "plain": ["model", "plain"],
    }


def test_payload_round_trip(spark, tmp_path):
    rows = [(m, t, "acc", float(i % 3 == 0)) for m in ("o/a", "o/b") for t in ("x|0", "y|5") for i in range(7)]
    rows.append(("o/b", "z|0", "acc", 1.0))
    samples = spark.createDataFrame(rows, "model string, task string, metric string, value double")
    scores = aggregate.with_all(aggregate.task_scores(samples))
    path = str(tmp_path / "payloads")
    sinks.write_result_payloads(scores, path)
    files = result_files.scan_result_files(spark, path)
    long = results.flatten_results(results.task_entries(result_files.parse_results_tolerant(files).accepted))
    got = {(r.model, r.task, r.metric): r.value for r in long.collect()}
    for r in scores.collect():
        assert got[(r.model, r.task, "acc")] == r.value
        assert got[(r.model, r.task, "acc_stderr")] == r.stderr
    assert got[("o/b", "z|0", "acc_stderr")] is None
    assert len(got) == 2 * scores.count()


def test_paths_come_back_as_written(spark, tmp_path):
    put(tmp_path, "a b/x+y%20/r 1.json", "{}")
    files = result_files.scan_result_files(spark, str(tmp_path))
    assert column(files, "json_path") == [str(tmp_path / "a b/x+y%20/r 1.json")]


def test_task_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a:b|0\nc:d|5", encoding="utf-8")
    got = task_lists.scan_task_list(spark, str(tmp_path / "list.txt"))
    assert sorted(map(tuple, got.collect())) == [("a:b", 0), ("c:d", 5)]


def test_specifications_become_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(task_lists, "LIST_FOLDER", str(tmp_path))
    (tmp_path / "list.txt").write_text("secure:maet|2\nsecbench:mcq-en|0", encoding="utf-8")
    reg = registry.task_registry(spark)
    got = evaluation.listed_tasks(spark, ["mmlu:cs_security|5, secure:cwet", str(tmp_path / "list.txt")], reg, 1)
    assert sorted((r.task, r.shots) for r in got.collect()) == [
        ("mmlu:cs_security", 5), ("secbench:mcq-en", 0), ("secure:cwet", 1), ("secure:maet", 2),
    ]
    with pytest.raises(PySparkException, match="no task named nope"):
        evaluation.listed_tasks(spark, ["nope"], reg).collect()


def test_task_specs(spark):
    cases = {
        "a, b|5 ,,c|x": ["a|2", "b|5", "c|x|2"],
        " tasks/x.txt ": ["tasks/x.txt"],
        "": [],
        "7": ["7"],
        "a|٣": ["a|٣"],
        "a|5\n": ["a|5"],
    }
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    got = column(df.select("i", task_lists.task_specs(F.col("s"), 2).alias("x")).orderBy("i"), "x")
    assert got == list(cases.values())
    assert task_lists.normalize_task_spec(df, "s").columns == ["i", "s", "position", "task_spec"]


def test_slices_prune_folders(spark, tmp_path):
    rows = [(f"r{i % 2}", f"s{i % 3}", "test" if i % 5 else "val", i) for i in range(60)]
    root = str(tmp_path / "bench")
    benchmark.write_benchmark(spark.createDataFrame(rows, "repo string, subset string, split string, line int"), root)
    part = benchmark.scan_benchmark(spark, root, "r1", "s0", "test")
    assert sorted(column(part, "line")) == [i for i in range(60) if i % 2 == 1 and i % 3 == 0 and i % 5]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan


def test_sample_details(spark, tmp_path):
    samples = spark.createDataFrame([("m", "t", 1, "acc", 1.0)], "model string, task string, item_id int, metric string, value double")
    sinks.write_sample_details(samples, str(tmp_path / "d"))
    assert (tmp_path / "d" / "model=m" / "task=t").is_dir()


def test_csv_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a"b,c', "x\ny", None)], "model string, `p|0` string, q string")
    sinks.write_csv(df, str(tmp_path / "c.csv"), ["model", "p|0", "q"], one_file=True)
    assert read_csv(str(tmp_path / "c.csv")) == [["model", "p|0", "q"], ['a"b,c', "x\ny", ""]]


def test_shared_folder_is_the_named_one(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
