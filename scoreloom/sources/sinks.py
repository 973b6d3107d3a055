"""Writers for reports, sample details and result payloads."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import quoted, result_payloads, split_by_metric


def write_csv(report: DataFrame, path: str, columns=None, one_file: bool = False) -> None:
    """Header and rows, missing cells empty; columns not asked for are left out.

    Written in parts, each with a header. ``one_file`` suits a report with a row per model:
    it is sorted by its first column and written by one task.
    """
    if columns is not None:
        report = report.select(*map(quoted, columns))
    if one_file:
        report = report.repartition(1).sortWithinPartitions(quoted(report.columns[0]))
    report.write.option("header", True).option("nullValue", "").option(
        "emptyValue", ""
    ).option("escape", '"').csv(path)


def write_csv_per_metric(report: DataFrame, path: str, one_file: bool = False) -> dict[str, str]:
    """One table per metric, at ``<stem>_<metric><suffix>``; returns the paths."""
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    if not stem:
        stem, dot, suffix = name, "", ""
    paths = {}
    for metric, table in split_by_metric(report).items():
        target = f"{stem}_{metric}{dot}{suffix}"
        paths[metric] = f"{folder}/{target}" if folder else target
        write_csv(table, paths[metric], one_file=one_file)
    return paths


def write_sample_details(samples: DataFrame, path: str) -> None:
    """Per-sample values, in folders by model and task.

    Rows are first brought together by folder; rebalancing splits a folder that
    holds many rows over several tasks.
    """
    gathered = samples.hint("rebalance", "model", "task")
    gathered.write.partitionBy("model", "task").parquet(path)


def write_result_payloads(scores: DataFrame, path: str, run_time: str | None = None) -> None:
    """One JSON object per model, in folders by run and model.

    ``run_time`` (now, unless given) sorts as time does; a later run below the same path
    adds its folders, and readers take the latest cell of each model and task.
    """
    run = run_time or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H-%M-%S.%f")
    payloads = result_payloads(scores, run).withColumn("run", F.lit(run))
    payloads.write.mode("append").partitionBy("run", "model").option(
        "ignoreNullFields", False
    ).json(path)
