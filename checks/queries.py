"""One query per operator, over whole tables.

Arrays are joined to text and means rounded to six places, so that both engines
can be compared by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom import session
from scoreloom.functions import labels, severity, wording
from scoreloom.functions import text as T
from scoreloom.operators import (
    aggregate,
    conversations,
    corpus,
    filters,
    pages,
    prompts,
    results,
    sampling,
    scoring,
    validation,
)
from scoreloom.plans import evaluation, registry
from scoreloom.sources import benchmark, result_files, sinks, task_lists

from .views import table, view

col = F.col
OPTIONS = ["opt_a", "opt_b", "opt_c", "opt_d"]
STORED_INTRO = "Read the question. "
EXAMPLES = "Question: Which are even? A: 1 B: 2 C: 3 D: 4\nAnswer: BD"
SYSTEM = "Answer in one line."
PHRASES = [
    ("the", 1), ("of the", 3), ("the end of", 4), ("of", 1), ("in the", 2), ("that is", 2), ("is", 1), ("is the", 4),
    ("the of", 2), ("de la", 3), ("la", 1), ("des", 2), ("license", 5), ("License, Version 2", 9),
    ("GNU General Public License", 12), ("general public", 3), ("all rights", 4), ("and to", 2), ("to the", 2),
]
SEEDS = [
    ("src1", "knowledge", "reference"), ("src12", "knowledge", "reference"), ("src2", "skills", "reference"),
    ("src1", "tools", "manual"), ("src3", "tools", "manual"), ("src4", "tools", "reference"),
]
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def items(spark, sf) -> DataFrame:
    return view(spark, sf, "items")


def listed() -> F.Column:
    return F.array(*OPTIONS)


def keyed(order: str) -> F.Column:
    """Options as (key, text) pairs in a stored order."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("key"), col(f"opt_{k.lower()}").alias("text"))
            for k in order
        ]
    )


def prompt_rows(checked) -> DataFrame:
    """Accepted rows with all their cells, rejected ones with their reason."""
    pairs = F.transform(
        F.map_entries("specific"),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))),
    )
    good = checked.accepted.select(
        "item_id",
        "query",
        "instruction",
        F.array_join("choices", ",").alias("choices"),
        "gold_index",
        "gold",
        F.array_join(pairs, ";").alias("specific"),
    )
    bad = checked.rejected.select(col("key").cast("bigint").alias("item_id"), "reason")
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(
        bad, allowMissingColumns=True
    )


def samples(df: DataFrame) -> DataFrame:
    """Model responses scored by the letter they settle on."""
    return df.select(
        "model",
        "task",
        "item_id",
        F.lit("acc").alias("metric"),
        scoring.mcq_regex(col("text"), col("gold")).alias("value"),
    )


def asked_metrics() -> F.Column:
    """Which scorers the tasks of the derived responses ask for."""
    return (
        F.when(F.length("task") % 2 == 0, F.array(F.lit("exact_match"), F.lit("prefix_match")))
        .otherwise(F.array(F.lit("exact_match"), F.lit("prefix_match"), F.lit("mcq_regex")))
    )


def multi(spark, sf) -> DataFrame:
    df = view(spark, sf, "responses").withColumn("metrics", asked_metrics())
    return scoring.score_multi_metric(df)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def used_tasks(spark, sf) -> DataFrame:
    """Documents with the registry row of the task each one uses."""
    reg = registry.task_registry(spark)
    return view(spark, sf, "usage").join(reg, "position")


# Sources and sinks


@query
def scan_benchmark(spark, sf):
    root = session.scratch_path(spark, "benchmark")
    lines = used_tasks(spark, sf).select("doc_id", "repo", "subset", "split")
    benchmark.write_benchmark(lines, root)
    slices = sorted({(t.repo, t.subset, t.evaluation_split) for t in registry.tasks()})
    parts = [benchmark.scan_benchmark(spark, root, *s) for s in slices]
    stored = reduce(lambda a, b: a.unionByName(b), parts)
    return benchmark.evaluation_lines(stored, registry.task_registry(spark)).select("doc_id", "task")


@query
def plan_distinct_datasets(spark, sf):
    requests = used_tasks(spark, sf).select(
        F.col("doc_id").alias("position"), "task", "repo", "subset"
    )
    return registry.distinct_datasets(requests)


def write_payload_files(spark, sf) -> str:
    """Two runs of each model; the later one is written first."""
    path = session.scratch_path(spark, "payloads")
    scores = aggregate.with_all(aggregate.task_scores(samples(view(spark, sf, "responses"))))
    scores = scores.withColumn("shots", F.lit(0))
    sinks.write_result_payloads(scores, path, "2025-02-01T00-00-00.000000")
    earlier = scores.withColumn("value", col("value") / 2)
    sinks.write_result_payloads(earlier, path, "2025-01-31T23-59-59.999999")
    return path


@query
def scan_result_files(spark, sf):
    files = result_files.scan_result_files(spark, write_payload_files(spark, sf))
    parsed = result_files.parse_results_tolerant(files).accepted
    folder = F.regexp_extract("json_path", "model=([^/]+)/", 1)
    return (
        results.task_entries(parsed)
        .groupBy(F.url_decode(folder).alias("folder"), "model")
        .agg(F.count_distinct("json_path").alias("files"), F.count(F.lit(1)).alias("entries"))
    )


@query
def sink_result_payload(spark, sf):
    files = result_files.scan_result_files(spark, write_payload_files(spark, sf))
    parsed = result_files.parse_results_tolerant(files).accepted
    long = results.flatten_results(results.task_entries(parsed))
    return rounded(results.latest_cells(long).select("model", "task", "metric", "value"), "value")


def payload_files(spark, sf) -> DataFrame:
    return view(spark, sf, "payloads").withColumnRenamed("payload", "value")


def parsed_payloads(spark, sf) -> DataFrame:
    return result_files.decode(payload_files(spark, sf))


@query
def parse_results_tolerant(spark, sf):
    checked = result_files.parse_results_tolerant(payload_files(spark, sf))
    good = checked.accepted.select("json_path", F.lit(True).alias("decoded"))
    return good.unionByName(checked.rejected.select("json_path", F.lit(False).alias("decoded")))


@query
def scan_task_list(spark, sf):
    path = session.scratch_path(spark, "task-list")
    lines = table(spark, sf, "documents").select(
        F.concat_ws("|", "source", (col("n_chars") % 6).cast("string"))
    )
    lines.write.text(path)
    found = task_lists.scan_task_list(spark, path)
    return found.groupBy("task", "shots").agg(F.count(F.lit(1)).alias("lines"))


@query
def normalize_task_spec(spark, sf):
    specs = table(spark, sf, "documents").select(
        "doc_id",
        F.when(col("doc_id") % 9 == 0, F.concat(F.lit(" tasks/"), "source", F.lit(".txt")))
        .when(col("doc_id") % 9 == 1, F.concat_ws(",", "text", F.lit(" , a:b|5,c:d|"), "lang"))
        .otherwise(col("text"))
        .alias("spec"),
    )
    return task_lists.normalize_task_spec(specs, "spec", 3).drop("spec")


def payload_report(spark, sf) -> DataFrame:
    return evaluation.lay_out(evaluation.decoded_entries(payload_files(spark, sf)))


@query
def sink_csv(spark, sf):
    path = session.scratch_path(spark, "report") + ".csv"
    sinks.write_csv(payload_report(spark, sf), path, ["model", "all_acc", "t:click|0_acc"], one_file=True)
    return spark.read.option("header", True).csv(path)


@query
def sink_csv_per_metric(spark, sf):
    path = session.scratch_path(spark, "report") + ".csv"
    report = payload_report(spark, sf).persist()
    written = sinks.write_csv_per_metric(report, path)
    report.unpersist()
    tables = []
    for metric, part in sorted(written.items()):
        cells = spark.read.option("header", True).csv(part).unpivot(
            "model", None, "column", "cell"
        )
        tables.append(cells.withColumn("metric", F.lit(metric)))
    union = tables[0]
    for more in tables[1:]:
        union = union.unionByName(more)
    return union


@query
def sink_sample_details(spark, sf):
    path = session.scratch_path(spark, "details")
    sinks.write_sample_details(samples(view(spark, sf, "responses")), path)
    return spark.read.parquet(path).select("model", "task", "item_id", "metric", "value")


# Registry


@query
def task_registry(spark, sf):
    used = view(spark, sf, "usage").groupBy("position").agg(F.count(F.lit(1)).alias("n_items"))
    return (
        registry.task_registry(spark)
        .join(used, "position", "left")
        .select(
            "position",
            "task",
            "repo",
            "subset",
            F.array_join("metrics", ",").alias("metrics"),
            F.array_join("available_splits", ",").alias("available_splits"),
            "few_shot_split",
            "few_shot_rule",
            "generation_size",
            F.size(F.coalesce("stops", F.array().cast("array<string>"))).alias("n_stops"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        )
    )


@query
def task_variant_rules(spark, sf):
    named = used_tasks(spark, sf).select("doc_id", F.concat("task", "defect").alias("task"))
    return registry.resolve_variants(named, registry.task_registry(spark))


@query
def task_catalogue(spark, sf):
    used = used_tasks(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))
    catalogue = registry.task_catalogue(
        registry.task_registry(spark), registry.curated_suites(spark)
    )
    return catalogue.join(used, "category", "left").select(
        "category", "n_tasks", F.array_join("tasks", ",").alias("tasks"), "n_items"
    )


@query
def curated_suites(spark, sf):
    used = used_tasks(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("n_items"))
    suites = registry.suite_tasks(registry.curated_suites(spark), registry.task_registry(spark))
    return (
        suites.join(used, "task", "left")
        .groupBy("suite")
        .agg(
            F.count(F.lit(1)).alias("n_tasks"),
            F.count_if("known").alias("n_known"),
            F.max("shots").alias("shots"),
            F.sum("n_items").alias("n_items"),
        )
    )


# Validation and sampling


@query
def require_columns(spark, sf):
    checked = validation.require_columns(items(spark, sf), ["question", "loose_gold", "set_gold"])
    bad = checked.rejected.select("item_id", "reason", F.array_join("missing", ",").alias("missing"))
    return bad.unionByName(checked.accepted.select("item_id"), allowMissingColumns=True)


@query
def gold_index_strict(spark, sf):
    checked = validation.require_gold(items(spark, sf), labels.gold_index_strict(col("gold")))
    kept = checked.accepted.select("item_id", "gold_index")
    return kept.unionByName(checked.rejected.select("item_id"), allowMissingColumns=True)


@query
def gold_index_normalized(spark, sf):
    index = labels.gold_index_normalized(col("loose_gold"))
    return items(spark, sf).select("item_id", index.alias("gold_index"))


@query
def gold_index_mixed(spark, sf):
    index = labels.gold_index_mixed(col("mixed_gold"))
    return items(spark, sf).select("item_id", index.alias("gold_index"))


@query
def gold_set_or_skip(spark, sf):
    checked = validation.gold_set_or_skip(items(spark, sf), "set_gold")
    good = checked.accepted.select("item_id", "gold_index")
    return good.unionByName(checked.rejected.select("item_id", "reason"), allowMissingColumns=True)


def gappy(spark, sf) -> DataFrame:
    """Items of which some lack a text or a letter."""
    third = F.when(col("n_chars") % 5 != 0, col("opt_c"))
    full = items(spark, sf).withColumn("opt_c", third)
    order = F.when(col("n_chars") % 3 == 0, keyed("DCA")).otherwise(keyed("DCBA"))
    return full.withColumn("options", order)


@query
def require_all_choices(spark, sf):
    checked = validation.require_all_choices(gappy(spark, sf))
    good = checked.accepted.select("item_id", F.lit("").alias("missing"))
    bad = checked.rejected.select("item_id", F.array_join("missing", ",").alias("missing"))
    return good.unionByName(bad)


@query
def limit_per_task(spark, sf):
    """The first rows of each task, and all rows; some have no id, one task no name."""
    holes = items(spark, sf).withColumns(
        {
            "row": col("item_id"),
            "item_id": F.when(col("item_id") >= 20, col("item_id")),
            "task": F.when(col("task") != "src19", col("task")),
        }
    )
    first, every = (sampling.limit_per_task(holes, n) for n in (7, 1_000_000))
    columns = ["row", "item_id", "task", "question"]
    return first.select(F.lit("first").alias("part"), *columns).unionByName(
        every.select(F.lit("every").alias("part"), *columns)
    )


def example_prompts(df: DataFrame) -> DataFrame:
    return df.select(
        "task",
        "item_id",
        prompts.listed_mcq(col("question"), listed(), wording.LETTER_ASKED).alias("query"),
        F.concat(F.lit(" "), "gold").alias("answer"),
    )


@query
def attach_few_shots(spark, sf):
    every = items(spark, sf)
    held_out = sampling.attach_few_shots(
        example_prompts(every.where(col("split") == "test")),
        example_prompts(every.where(col("split") == "val")),
        2,
        allow_none=True,
    )
    own = sampling.attach_few_shots(example_prompts(every), example_prompts(every), 1)
    return held_out.select(F.lit("val").alias("pool"), "item_id", "query").unionByName(
        own.select(F.lit("own").alias("pool"), "item_id", "query")
    )


@query
def apply_stop_sequences(spark, sf):
    df = view(spark, sf, "responses")
    by_row = F.when(col("item_id") % 2 == 0, F.array(F.lit("\n"), F.lit(". "))).otherwise(
        F.array(F.lit(""), F.lit("because"))
    )
    return df.select(
        "model",
        "item_id",
        T.cut_at_stops(col("text"), ["\n"]).alias("one_line"),
        T.cut_at_stops(col("text"), by_row).alias("by_row"),
    )


# Prompts


@query
def prompt_p1_subject_mcq(spark, sf):
    df = items(spark, sf).withColumns(
        {
            "subject": F.concat("subject", F.lit("_"), "task"),
            "choices": listed(),
            "answer": col("mixed_gold"),
        }
    )
    return prompt_rows(prompts.build_prompts(df, "subject_mcq"))


def _both(df, formatter, first, second, name="direct"):
    """Prompts of a layout under both settings of a switch."""
    a = prompt_rows(prompts.build_prompts(df, formatter, **first))
    b = prompt_rows(prompts.build_prompts(df, formatter, **second))
    return a.withColumn(name, F.lit(True)).unionByName(b.withColumn(name, F.lit(False)))


@query
def prompt_p2_cti_mcq(spark, sf):
    stored = F.concat(F.lit(STORED_INTRO), "question", F.lit("\n" + wording.THREAT_LAST_LINE))
    df = items(spark, sf).withColumns({"Prompt": stored, "GT": col("loose_gold")})
    return _both(df, "threat_mcq", {"direct": True}, {"direct": False})


@query
def prompt_p3_weakness(spark, sf):
    df = view(spark, sf, "weakness").withColumnsRenamed(
        {"description": "Description", "prompt": "Prompt", "gold": "GT"}
    )
    return _both(df, "weakness", {"direct": True}, {"direct": False})


@query
def prompt_p4_severity(spark, sf):
    df = view(spark, sf, "severity").withColumnsRenamed(
        {"description": "Description", "gold": "GT"}
    )
    df = df.withColumn("Prompt", F.concat(F.lit(STORED_INTRO), "Description"))
    return _both(df, "severity", {"direct": True}, {"direct": False})


@query
def prompt_p5_techniques(spark, sf):
    df = view(spark, sf, "techniques").withColumnsRenamed({"gold": "GT"})
    df = df.withColumn("Prompt", F.concat(F.lit(STORED_INTRO), "description"))
    return _both(df, "techniques", {"direct": True}, {"direct": False})


@query
def prompt_p6_inline_options(spark, sf):
    df = gappy(spark, sf).withColumns({"answers": keyed("BADC"), "solution": col("loose_gold")})
    return prompt_rows(prompts.build_prompts(df, "inline_options"))


@query
def prompt_p7_mcq_list(spark, sf):
    five = F.array(*OPTIONS, "subject")
    df = items(spark, sf).withColumns({"options": five, "answer": col("gold")})
    return prompt_rows(prompts.build_prompts(df, "listed_mcq"))


@query
def prompt_p8_boolean(spark, sf):
    df = items(spark, sf).withColumns({"prompt": col("question"), "answer": col("bool_gold")})
    return prompt_rows(prompts.build_prompts(df, "boolean"))


@query
def prompt_p9_mcq_list_alt(spark, sf):
    three = F.array(*OPTIONS[:3])
    df = items(spark, sf).withColumns({"answers": three, "label": col("gold")})
    return prompt_rows(prompts.build_prompts(df, "listed_mcq_alt"))


@query
def prompt_p10_multi_answer(spark, sf):
    df = gappy(spark, sf).withColumns({"choices": listed(), "answer": col("set_gold")})
    return _both(df, "multi_answer", {"examples": EXAMPLES}, {}, "examples")


@query
def prompt_p11_context_mcq(spark, sf):
    content = F.when(col("n_chars") % 2 == 0, col("subject")).otherwise("")
    df = gappy(spark, sf).withColumns(
        {"answers": col("options"), "solution": col("gold"), "content": content}
    )
    return _both(
        df, "context_mcq", {"include_context": True}, {"include_context": False}, "context"
    )


# Extraction


@query
def extract_choice_letter(spark, sf):
    return view(spark, sf, "responses").select(
        "model", "item_id", T.extract_choice_letter(col("text")).alias("letter")
    )


@query
def extract_weakness_id(spark, sf):
    return view(spark, sf, "weakness").select(
        "item_id",
        T.extract_weakness_id(col("text")).alias("weakness"),
        T.find_weakness_id(col("text")).isNotNull().alias("found"),
    )


@query
def extract_severity_vector(spark, sf):
    return view(spark, sf, "severity").select(
        "item_id",
        T.extract_severity_vector(col("text")).alias("vector"),
        T.find_severity_vector(col("text")).isNotNull().alias("found"),
    )


@query
def extract_techniques(spark, sf):
    return view(spark, sf, "techniques").select(
        "item_id", F.array_join(T.extract_techniques(col("text")), ",").alias("techniques")
    )


@query
def parse_technique_list(spark, sf):
    return view(spark, sf, "techniques").select(
        "item_id", F.array_join(T.parse_technique_list(col("gold")), ",").alias("techniques")
    )


@query
def cvss_base_score(spark, sf):
    df = view(spark, sf, "severity").select("item_id", "gold")
    return severity.with_base_score(df, "gold", "score")


# Scores


@query
def score_mcq_regex(spark, sf):
    return samples(view(spark, sf, "responses")).select("model", "item_id", "value")


@query
def score_weakness_id(spark, sf):
    return view(spark, sf, "weakness").select(
        "item_id", scoring.weakness_id(col("text"), col("gold")).alias("value")
    )


@query
def score_exact_match(spark, sf):
    return view(spark, sf, "responses").select(
        "model", "item_id", scoring.exact_match(col("text"), col("gold")).alias("value")
    )


@query
def score_prefix_match(spark, sf):
    """With an empty gold text, which any response starts with, marked."""
    df = view(spark, sf, "responses").withColumn(
        "gold", F.when(col("item_id") % 41 == 0, F.lit(" ")).otherwise(col("gold"))
    )
    return df.select(
        "model",
        "item_id",
        scoring.prefix_match(col("text"), col("gold")).alias("value"),
        scoring.matches_anything(col("gold")).alias("empty_gold"),
    )


@query
def score_loglikelihood_choice(spark, sf):
    """Four choices in a hash aggregate, and any number in both forms."""
    of = scoring.loglikelihood_choice
    four, many = view(spark, sf, "choices"), view(spark, sf, "many_choices")
    parts = {
        "four": of(four, len(labels.FOUR_CHOICES)),
        "counted": of(many, len(labels.ANSWER_SETS)),
        "sorted": of(many),
    }
    shown = [
        df.select(F.lit(name).alias("form"), "model", "task", "item_id", "picked", "value")
        for name, df in parts.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), shown)


@query
def score_severity_mad(spark, sf):
    df = scoring.severity_distance(view(spark, sf, "severity"))
    return rounded(df.select("item_id", "mad"), "mad")


@query
def score_severity_similarity(spark, sf):
    df = scoring.severity_distance(view(spark, sf, "severity"))
    value = scoring.severity_similarity(col("mad"))
    return rounded(df.select("item_id", value.alias("similarity")), "similarity")


@query
def score_technique_f1(spark, sf):
    return view(spark, sf, "techniques").select(
        "item_id", scoring.technique_f1(col("text"), col("gold")).alias("value")
    )


@query
def score_multi_metric(spark, sf):
    return multi(spark, sf).select("model", "task", "item_id", "metric", "value")


def scored_run(spark, sf):
    """Scores of a run with gaps and strays: responses are cut at stops and joined to the
    prompts' gold answers."""
    responses = view(spark, sf, "run").select(
        "model",
        "task",
        "item_id",
        F.when(col("text").isNull(), F.array().cast("array<string>"))
        .otherwise(F.array("text", F.lit("second")))
        .alias("texts"),
    )
    tasks = (
        table(spark, sf, "documents").select(col("source").alias("task")).distinct().withColumns(
            {"metrics": asked_metrics(), "stops": F.array(F.lit("\n"))}
        )
    )
    rows = items(spark, sf).withColumns({"options": listed(), "answer": col("gold")})
    built = prompts.build_prompts(rows, "listed_mcq").accepted
    return scoring.score_responses(responses, built, tasks)


@query
def score_responses(spark, sf):
    checked = scored_run(spark, sf)
    good = checked.accepted.select("model", "task", "item_id", "metric", "value")
    return good.unionByName(checked.rejected, allowMissingColumns=True)


# Means


@query
def task_mean(spark, sf):
    """Over all prompts, answered or not."""
    scores = aggregate.task_scores(scored_run(spark, sf).accepted)
    return rounded(scores.select("model", "task", "metric", "scorer", "value", "n"), "value")


@query
def task_stderr(spark, sf):
    scores = aggregate.task_scores(multi(spark, sf))
    return rounded(scores.select("model", "task", "metric", "stderr"), "stderr")


@query
def all_rollup(spark, sf):
    scores = aggregate.with_all(aggregate.task_scores(multi(spark, sf)))
    return rounded(scores, "value", "stderr")


@query
def suite_mean(spark, sf):
    return rounded(suite_means(spark, sf), "value")


def suite_means(spark, sf) -> DataFrame:
    parity = F.when(F.length("source") % 2 == 0, "even").otherwise("odd")
    suites = (
        table(spark, sf, "documents")
        .select(col("source").alias("task"), F.explode(F.array(F.lit("every"), parity)).alias("suite"))
        .distinct()
    )
    return aggregate.suite_mean(aggregate.task_scores(multi(spark, sf)), suites)


@query
def model_delta(spark, sf):
    delta = aggregate.model_delta(suite_means(spark, sf), "org/m1", ("suite", "metric", "scorer"))
    return rounded(delta, "value", "baseline", "delta")


@query
def judge_score_rollup(spark, sf):
    return rounded(aggregate.judge_score_rollup(view(spark, sf, "judged")), "value", "stderr")


@query
def metric_catalogue(spark, sf):
    generated = multi(spark, sf).select("scorer", "value")
    picked = scoring.loglikelihood_choice(view(spark, sf, "choices"), 4).select(
        F.lit("loglikelihood").alias("scorer"), "value"
    )
    used = generated.unionByName(picked).groupBy("scorer").agg(F.count("value").alias("n"))
    known = evaluation.metric_catalogue(spark)
    return known.join(used, "scorer", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


# Reports


@query
def resolve_model_name(spark, sf):
    parsed = result_files.parse_results_tolerant(payload_files(spark, sf)).accepted
    return parsed.select(
        "json_path", results.resolve_model_name(col("payload"), col("json_path")).alias("model")
    )


def entries(spark, sf) -> DataFrame:
    return results.task_entries(parsed_payloads(spark, sf))


@query
def flatten_results(spark, sf):
    return results.flatten_results(entries(spark, sf))


@query
def drop_stderr(spark, sf):
    return results.drop_stderr(results.flatten_results(entries(spark, sf))).drop("raw")


@query
def pivot_by_model(spark, sf):
    return results.pivot_by_model(results.flatten_results(entries(spark, sf)), cell="value")


@query
def results_long_table(spark, sf):
    return results.results_long_table(entries(spark, sf))


@query
def trim_model_prefix(spark, sf):
    placed = entries(spark, sf).withColumn("model", F.concat(F.lit("org//site/"), "model"))
    single = F.regexp_replace("model", "^org//", "org/")
    trimmed = results.trim_model_prefix(placed.withColumn("model", single))
    return trimmed.select("json_path", "task", "model")


@query
def split_by_metric(spark, sf):
    report = results.pivot_by_model(results.flatten_results(entries(spark, sf)), cell="value")
    parts = [
        part.unpivot("model", None, "column", "value").withColumn("metric", F.lit(metric))
        for metric, part in results.split_by_metric(report).items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query
def collect_report(spark, sf):
    """Result files to CSV and back, under each switch."""
    root = write_payload_files(spark, sf)
    parts = []
    for name, switches in {
        "whole": {},
        "plain": {"include_stderr": False, "one_file": True},
        "long": {"pivot": False},
        "split": {"split": True},
    }.items():
        path = session.scratch_path(spark, "report") + ".csv"
        for written in evaluation.collect_report(spark, root, path, **switches).paths.values():
            cells = spark.read.option("header", True).csv(written)
            if name == "long":
                cells = cells.withColumn("json_path", F.regexp_extract("json_path", "run=([^/]*)/", 1))
                cells = cells.unpivot(["model", "task", "json_path"], None, "column", "value")
            else:
                cells = cells.unpivot("model", None, "column", "value")
            cells = cells.withColumn("value", F.round(col("value").cast("double"), 6))
            parts.append(cells.withColumn("part", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query
def accuracy_report(spark, sf):
    """Accuracy of each model on each task, as a table."""
    scores = aggregate.task_scores(samples(view(spark, sf, "responses")))
    tasks = results.distinct_names(table(spark, sf, "documents"), "source")
    report = scores.groupBy("model").pivot("task", tasks).agg(F.first(F.round("value", 6)))
    return report


# Conversations


def chat(spark, sf) -> DataFrame:
    return view(spark, sf, "chat")


def told(messages: str) -> F.Column:
    lines = F.transform(
        messages, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("-")))
    )
    return F.array_join(lines, "\n")


@query
def inject_system_turn(spark, sf):
    return conversations.inject_system_turn(chat(spark, sf), SYSTEM)


@query
def history_at_turn(spark, sf):
    df = conversations.history_at_turn(table(spark, sf, "conversations"))
    return df.select("conv_id", "turn", told("messages").alias("history"))


@query
def long_histories(spark, sf):
    """The same over conversations of 450 turns."""
    df = conversations.history_at_turn(view(spark, sf, "long_chat"))
    return df.select(
        "conv_id", "turn", F.size("messages").alias("n"), told("messages").alias("history")
    )


@query
def history_blocks(spark, sf):
    df = conversations.history_blocks(table(spark, sf, "conversations"), 3)
    return df.select("conv_id", "block", told("messages").alias("history"))


@query
def single_turn_prompts(spark, sf):
    df = conversations.single_turn_prompts(table(spark, sf, "conversations"), SYSTEM)
    return df.select("conv_id", "turn", told("messages").alias("messages"))


@query
def prompt_completion_pairs(spark, sf):
    return conversations.prompt_completion_pairs(chat(spark, sf))


@query
def drop_unanswered_turns(spark, sf):
    df = conversations.drop_unanswered_turns(chat(spark, sf))
    return df.select("conv_id", "turn", "position", "role", "text")


@query
def skip_blank_turns(spark, sf):
    return conversations.skip_blank_turns(chat(spark, sf))


@query
def truncate_at_sentinel(spark, sf):
    return conversations.truncate_at_sentinel(chat(spark, sf))


@query
def chat_history(spark, sf):
    df = conversations.chat_history(chat(spark, sf), SYSTEM)
    return df.select("conv_id", "position", "role", "text")


@query
def reject_empty_replies(spark, sf):
    checked = conversations.reject_empty_replies(chat(spark, sf).where(col("role") == "assistant"))
    return checked.accepted.unionByName(checked.rejected, allowMissingColumns=True)


@query
def reply_failure_rates(spark, sf):
    return conversations.failure_rates(view(spark, sf, "responses"))


# Corpus


@query
def page_text(spark, sf):
    return pages.page_text(table(spark, sf, "pages")).select("page_id", "text", "n_blocks", "n_kept")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents")


@query
def exact_dedup(spark, sf):
    return corpus.exact_dedup(documents(spark, sf))


@query
def exact_classes(spark, sf):
    return corpus.exact_classes(documents(spark, sf))


@query
def dedup_keep_best(spark, sf):
    df = documents(spark, sf)
    members = corpus.exact_dedup(df).select("doc_id", col("class_hash").alias("cluster"))
    return corpus.keep_best(df, members, ["n_chars"])


@query
def corpus_stats(spark, sf):
    stats = corpus.corpus_stats(documents(spark, sf), ["source", "lang"])
    return stats.drop("texts", "words_p50", "words_p90", "words_p99")  # estimates; see the tests


@query
def replay_mix(spark, sf):
    df = documents(spark, sf)
    domain = col("source").startswith("src1")
    mixed = corpus.replay_mix(df.where(domain), df.where(~F.coalesce(domain, F.lit(False))), 0.1, ["source", "lang"])
    return mixed.select("doc_id", "source", "lang", "origin")


@query
def licence_scan(spark, sf):
    found = corpus.licence_scan(documents(spark, sf))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_notices")


@query
def licences_by_source(spark, sf):
    return corpus.licences_by_source(corpus.licence_scan(documents(spark, sf)))


@query
def seed_categories(spark, sf):
    seeds = session.local_table(spark, SEEDS, "prefix string, category string, kind string")
    return corpus.seed_categories(documents(spark, sf), seeds)


@query
def validate_conversations(spark, sf):
    return conversations.validate_conversations(chat(spark, sf))


@query
def domain_filter_lexicon(spark, sf):
    found = filters.domain_filter_lexicon(documents(spark, sf), PHRASES, per_thousand=90)
    return found.select("doc_id", "n_words", "n_phrases", "weight", "in_domain")


@query
def domain_filter_model(spark, sf):
    """Learned from four fifths of the labelled documents, applied to all."""
    df = documents(spark, sf)
    held_out = F.crc32(col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf, "labels").select("doc_id", col("quality").alias("label"))
    path = session.scratch_path(spark, "domain-model")
    filters.fit_domain_model(df.where(~held_out).join(labels, "doc_id"), path)
    scored = filters.score_domain_model(df, path)
    return scored.select("doc_id", held_out.alias("held_out"), "domain_score", "in_domain")


# Extension


@query
def register_scorer(spark, sf):
    mentions = scoring.Scorer(
        "mentions", lambda t: t, lambda t, gold: F.coalesce(F.contains(t, gold).cast("double"), F.lit(0.0)),
        aggregate=F.max,
    )
    assert scoring.register_scorer("mentions", mentions)
    try:
        df = view(spark, sf, "responses").withColumn("metrics", F.array(F.lit("mentions")))
        scored = scoring.score_multi_metric(df)
    finally:
        del scoring.SCORERS["mentions"]  # the other queries list what the library brings
    return aggregate.task_scores(scored, {"mentions": mentions.aggregate}).select(
        "model", "task", "metric", "value", "n"
    )


@query
def register_formatter(spark, sf):
    prompts.register_formatter(
        "shouted",
        prompts.Formatter(
            ["question", "gold"], lambda mark="!": F.concat(F.upper("lang"), F.lit(mark), "question"), "gold"
        ),
    )
    df = items(spark, sf).withColumnRenamed("subject", "lang")
    return prompt_rows(prompts.build_prompts(df, "shouted", mark="?"))
