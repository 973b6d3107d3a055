"""Whole jobs: benchmark lines to prompts, responses to task scores, result files
to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..operators import aggregate, prompts, results, sampling, scoring
from ..operators.validation import Checked
from ..sources import benchmark, result_files, sinks, task_lists
from . import registry

# Metrics reported by each scorer, with their direction and what they are read from.
LOGLIKELIHOOD = ("loglikelihood", "acc", True, "logprobs")


def metric_catalogue(spark: SparkSession, scorers=None) -> DataFrame:
    scorers = scoring.SCORERS if scorers is None else scorers
    rows = [
        (name, s.metric, s.higher_is_better, s.category) for name, s in scorers.items()
    ] + [LOGLIKELIHOOD]
    return session.local_table(
        spark, rows, "scorer string, metric string, higher_is_better boolean, category string"
    )


def formatter_options(task: registry.Task) -> dict:
    """Switches of a task's layout."""
    if task.formatter in ("threat_mcq", "weakness", "severity", "techniques"):
        return {"direct": task.variant == "direct"}
    if task.formatter == "context_mcq":
        return {"include_context": task.variant != "no_context"}
    return {}


def task_prompts(
    spark: SparkSession,
    root: str,
    task: registry.Task,
    shots: int = 0,
    max_samples: int | None = None,
    **options,
) -> Checked:
    """Prompts of one task from the benchmark lines stored below ``root``.

    Reads the evaluation split; examples come from the few-shot split, or from the
    evaluation split where the task names none or one it does not have. No example at all
    for a prompt is an error. ``options`` go to the layout; the variant with fixed examples
    needs them as ``examples``.
    """
    if task.variant == "examples" and "examples" not in options:
        raise ValueError(f"{task.task} needs its block of examples")

    def built(split: str) -> Checked:
        lines = benchmark.scan_benchmark(spark, root, task.repo, task.subset, split)
        named = lines.withColumn("task", F.lit(task.task))
        return prompts.build_prompts(named, task.formatter, **formatter_options(task), **options)

    checked = built(task.evaluation_split)
    chosen = checked.accepted
    if max_samples is not None:
        chosen = sampling.limit_per_task(chosen, max_samples)
    if shots:
        own = task.few_shot_split in task.available_splits
        pool = built(task.few_shot_split if own else task.evaluation_split).accepted
        chosen = sampling.attach_few_shots(
            chosen, pool.withColumnRenamed("gold", "answer"), shots
        )
    return Checked(accepted=chosen, rejected=checked.rejected)


def evaluate_generated(
    responses: DataFrame, asked: DataFrame, tasks: DataFrame, scorers=None
) -> Checked:
    """Task scores of the responses to what was asked, with the ``all`` rows.

    Accepted are the scores, over every prompt of a task for each model that was run on it;
    rejected the responses that belong to no task or prompt, counted by reason. Where
    ``tasks`` has a column ``shots``, the scores carry it.
    """
    scorers = scoring.SCORERS if scorers is None else scorers
    checked = scoring.score_responses(responses, asked, tasks, scorers)
    special = {n: s.aggregate for n, s in scorers.items() if s.aggregate is not F.avg}
    scores = aggregate.with_all(aggregate.task_scores(checked.accepted, special))
    if "shots" in tasks.columns:
        scores = scores.join(tasks.select("task", "shots"), "task", "left")
    return Checked(accepted=scores, rejected=scoring.count_rejects(checked.rejected))


def evaluate_choices(choices: DataFrame, n_choices: int | None = None) -> DataFrame:
    """Task scores from choice log-probabilities, with the ``all`` rows."""
    picked = scoring.loglikelihood_choice(choices, n_choices)
    samples = picked.withColumns({"metric": F.lit("acc"), "scorer": F.lit("loglikelihood")})
    return aggregate.with_all(aggregate.task_scores(samples))


def listed_tasks(spark: SparkSession, specs: list[str], reg: DataFrame, default_shots: int = 0):
    """Task specifications to the registry rows they name, each with its ``shots``.

    A specification that is the path of a list file stands for the lines of that file. A
    name of no task is an error when the rows are read.
    """
    frame = session.local_table(spark, [(s,) for s in specs], "spec string")
    paths = [s.strip() for s in specs if s.strip().startswith(task_lists.LIST_FOLDER)]
    plain = task_lists.normalize_task_spec(
        frame.where(~task_lists.is_list_path(F.col("spec"))), "spec", default_shots
    )
    named = plain.select(
        F.substring_index("task_spec", "|", 1).alias("task"),
        F.substring_index("task_spec", "|", -1).cast("int").alias("shots"),
    )
    for path in paths:
        named = named.unionByName(task_lists.scan_task_list(spark, path))
    known = reg.withColumn("_known", F.lit(True))
    found = named.join(known, "task", "left")
    missing = F.raise_error(F.concat(F.lit("no task named "), "task")).cast("string")
    return found.withColumn("task", F.when(F.col("_known"), F.col("task")).otherwise(missing)).drop("_known")


def lay_out(
    entries: DataFrame,
    pivot: bool = True,
    include_stderr: bool = True,
    cell: str = "raw",
    most: int = results.MAX_REPORT_COLUMNS,
) -> DataFrame:
    """Task entries to a report: trim names, drop errors, then make columns, ``most`` at
    most."""
    trimmed = results.trim_model_prefix(entries)
    if not pivot:
        metrics = results.distinct_names(results.flatten_results(entries), "metric", most)
        return results.results_long_table(trimmed, metrics, include_stderr)

    def in_long_form(df: DataFrame) -> DataFrame:
        long = results.flatten_results(df, keep_empty=True)
        return long if include_stderr else results.drop_stderr(long)

    # Column names do not depend on the trimming, so this pass goes without it.
    columns = results.distinct_names(
        in_long_form(entries).select(results.report_column().alias("column")), "column", most
    )
    return results.pivot_by_model(in_long_form(trimmed), columns, cell)


def decoded_entries(files: DataFrame) -> DataFrame:
    """Task entries of result files, decoded once and kept for the passes over them."""
    return session.written(results.task_entries(result_files.decode(files)), "entries")


@dataclass(frozen=True)
class Report:
    """What ``collect_report`` did: rows written, and the files that are not JSON."""

    rows: int
    rejected: DataFrame
    paths: dict[str, str]


def collect_report(
    spark: SparkSession,
    root: str,
    output: str,
    pivot: bool = True,
    include_stderr: bool = True,
    split: bool = False,
    one_file: bool = False,
    most: int = results.MAX_REPORT_COLUMNS,
) -> Report:
    """Result files below ``root`` to CSV, at ``output`` or with ``split`` at one path per
    metric. With no rows nothing is written."""
    parsed = session.scratch_path(spark, "payloads")
    result_files.decode(result_files.scan_result_files(spark, root)).write.parquet(parsed)
    payloads = spark.read.parquet(parsed)
    entries = results.task_entries(payloads)
    bad = payloads.where(F.col("payload").isNull())
    rejected = bad.select("json_path", F.lit("not JSON").alias("reason"))
    if entries.isEmpty():
        return Report(0, rejected, {})
    report = lay_out(entries, pivot, include_stderr, most=most).persist()
    rows = report.count()
    if split:
        paths = sinks.write_csv_per_metric(report, output, one_file)
    else:
        sinks.write_csv(report, output, one_file=one_file)
        paths = {"": output}
    report.unpersist()
    return Report(rows, rejected, paths)
