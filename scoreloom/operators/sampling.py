"""First rows per task, and worked examples put before a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def _ranked(df: DataFrame, by: list[str], order: str, n: int, ties: list[Column] = []) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), *ties))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _place(order: str) -> Column:
    """Sorts as the order does, null after all else."""
    return F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at"))


def limit_per_task(
    df: DataFrame, n: int, task: str = "task", order: str = "item_id", salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows of each task by ``order``; a null order comes last, rows without a
    task are a task, and of rows that are equal in ``order`` those whose values hash lowest stay.

    The last place to keep is found per task from two columns alone, ranked first
    within salted parts of a task and then over the survivors; Spark drops what can't
    be among the first n before it is shuffled. Whole rows are then joined to the one
    row per task that holds its last place. Nothing runs before the result is asked for.
    """
    salted = df.select(task, order).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(salts)))
    survivors = _ranked(_ranked(salted, [task, "_salt"], order, n), [task], order, n)
    lasts = survivors.groupBy(F.col(task).alias("_task")).agg(F.max(_place(order)).alias("_last"))
    near = df.join(lasts, F.col(task).eqNullSafe(F.col("_task")))
    kept = near.where(_place(order) <= F.col("_last")).select(*df.columns)
    # Ids that repeat are all that can still make more than n. Which of them stay is settled by
    # the rows themselves, so that reruns agree.
    comparable = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return _ranked(kept, [task], order, n, [F.xxhash64(*comparable)])


def attach_few_shots(
    prompts: DataFrame,
    pool: DataFrame,
    shots: int | Column,
    max_shots: int | None = None,
    separator: str = "\n\n",
    allow_none: bool = False,
) -> DataFrame:
    """Put the first examples of the task's pool before each query.

    ``pool`` has task, item_id, query and answer. An item never serves as its own
    example, so one more than asked is kept per task. ``shots`` may differ by row;
    then ``max_shots`` bounds it. A prompt whose pool holds no example for it is an
    error, or with ``allow_none`` stays as it is.
    """
    if isinstance(shots, Column):
        if max_shots is None:
            raise ValueError("max_shots is needed when shots differ by row")
        wanted = shots
    else:
        wanted, max_shots = F.lit(shots), shots
    if max_shots < 1:
        return prompts
    kept = limit_per_task(pool.select("task", "item_id", "query", "answer"), max_shots + 1)
    examples = kept.groupBy(F.col("task").alias("_task")).agg(
        F.array_sort(F.collect_list(F.struct("item_id", "query", "answer"))).alias("_examples")
    )
    joined = prompts.join(examples, F.col("task").eqNullSafe(F.col("_task")), "left")
    none = F.array().cast(examples.schema["_examples"].dataType)
    others = F.filter(
        F.coalesce("_examples", none), lambda e: ~e["item_id"].eqNullSafe(F.col("item_id"))
    )
    shown = F.transform(
        F.slice(others, F.lit(1), wanted), lambda e: F.concat(e["query"], e["answer"])
    )
    whole = F.array_join(F.concat(shown, F.array("query")), separator)
    if not allow_none:
        missing = F.concat(F.lit("no examples for task "), F.coalesce("task", F.lit("null")))
        whole = F.when((wanted > 0) & (F.size(others) == 0), F.raise_error(missing)).otherwise(whole)
    return joined.withColumn("query", whole).drop("_task", "_examples")
