"""Means of sample scores per task, over all tasks and per suite.

Each is a partial aggregate before the shuffle, so neither a long task nor a busy
model makes a long partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_TASKS = "all"


def standard_error(value: Column) -> Column:
    """Sample standard deviation over the root of n; null for one sample."""
    return F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))


def task_scores(samples: DataFrame, aggregates: dict | None = None) -> DataFrame:
    """Value, standard error and count per (model, task, metric), and per scorer where the
    samples name theirs: scorers that report one metric are never averaged together.

    The value is the mean, or for a scorer named in ``aggregates`` what that
    function makes of its values; ``samples`` then has a scorer column.
    """
    value = F.avg("value")
    keys = ["model", "task", "metric"]
    if aggregates or "scorer" in samples.columns:
        keys.append("scorer")
    if aggregates:
        cases = F
        for name, aggregate in aggregates.items():
            cases = cases.when(F.col("scorer") == name, aggregate(F.col("value")))
        value = cases.otherwise(value)
    return (
        samples.groupBy(*keys)
        .agg(
            value.alias("value"),
            standard_error(F.col("value")).alias("stderr"),
            F.count("value").alias("n"),
        )
        .select(*keys, "value", "stderr", "n")
    )


def task_scores_wide(wide: DataFrame, metrics) -> DataFrame:
    """The same from one column per metric.

    Aggregates first and turns metrics into rows afterwards, so the samples are
    never multiplied by the number of metrics.
    """
    aggregates = [
        F.struct(
            F.lit(m).alias("metric"),
            F.avg(m).alias("value"),
            standard_error(F.col(m)).alias("stderr"),
            F.count(m).alias("n"),
        ).alias(m)
        for m in metrics
    ]
    grouped = wide.groupBy("model", "task").agg(*aggregates)
    return grouped.select(
        "model", "task", F.explode(F.array(*metrics)).alias("score")
    ).select("model", "task", "score.*")


def _over_tasks(scores: DataFrame) -> DataFrame:
    scorer = [c for c in ("scorer",) if c in scores.columns]
    return scores.groupBy("model", "task", "metric", *scorer).agg(
        F.avg("value").alias("value"), F.avg("stderr").alias("stderr"), F.sum("n").alias("n")
    )


def all_rollup(scores: DataFrame) -> DataFrame:
    """The pseudo-task: the unweighted mean of a model's task means."""
    return _over_tasks(scores.withColumn("task", F.lit(ALL_TASKS)))


def with_all(scores: DataFrame) -> DataFrame:
    """Task scores and the pseudo-task, from one pass over the task scores."""
    both = F.explode(F.array(F.col("task"), F.lit(ALL_TASKS)))
    return _over_tasks(scores.withColumn("task", both))


def suite_mean(scores: DataFrame, suites: DataFrame) -> DataFrame:
    """Mean of the task means over the tasks of each suite (suite, task)."""
    return (
        scores.join(suites.select("suite", "task"), "task")
        .groupBy("model", "suite", "metric", *(c for c in ("scorer",) if c in scores.columns))
        .agg(F.avg("value").alias("value"), F.count("value").alias("n_tasks"))
    )


def model_delta(scores: DataFrame, baseline: str, by=("suite", "metric")) -> DataFrame:
    """How far each model's value is above the baseline model's, in points of 100; null
    where the baseline has none. ``scores`` has model, value and the columns ``by``."""
    base = scores.where(F.col("model") == baseline).select(*by, F.col("value").alias("baseline"))
    return scores.join(base, list(by), "left").select(
        "model", *by, "value", "baseline",
        (100 * (F.col("value") - F.col("baseline"))).alias("delta"),
    )


def judge_score_rollup(judged: DataFrame) -> DataFrame:
    """Means of given judge scores per model and rubric dimension.

    ``judged`` has model, dimension, item_id and score; a null score counts as not judged.
    """
    return judged.groupBy("model", "dimension").agg(
        F.avg("score").alias("value"),
        standard_error(F.col("score")).alias("stderr"),
        F.count("score").alias("n"),
        F.count_if(F.col("score").isNull()).alias("n_unjudged"),
    )
