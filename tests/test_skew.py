"""One key holds most rows: the work must be split and the results unchanged."""

import contextlib

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import conversations, scoring


@contextlib.contextmanager
def settings(spark, **values):
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for k, n in names.items():
            spark.conf.unset(n) if before[k] is None else spark.conf.set(n, before[k])


@pytest.fixture
def tiny_partitions(spark):
    """Thresholds scaled down to test data, joins by sorting."""
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        shuffle__partitions="8",
    ):
        yield


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_task_is_split(spark, tiny_partitions):
    n = 30000
    ids = spark.range(0, n, 1, 8)
    task = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    prompts = ids.select(task.alias("task"), F.col("id").alias("item_id"), F.lit(" A").alias("gold"))
    responses = prompts.where("item_id % 7 > 0").select(
        F.lit("m").alias("model"),
        "task",
        "item_id",
        F.array(F.when(F.col("item_id") % 2 == 0, "A").otherwise("B")).alias("texts"),
    )
    tasks = spark.createDataFrame(
        [(t, ["mcq_regex"], ["\n"]) for t in ["hot", *(f"t{i}" for i in range(50))]],
        "task string, metrics array<string>, stops array<string>",
    )
    rows, plan = final_plan(scoring.score_responses(responses, prompts, tasks).accepted)
    assert len(rows) == n
    assert sum(r.value for r in rows) == sum(1 for i in range(n) if i % 7 and i % 2 == 0)
    assert "skew=true" in plan


def test_a_hot_conversation_is_split(spark, tiny_partitions):
    n = 60000
    turns = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") / 10).cast("long") + 1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.lit("user").alias("role"),
        F.when(F.col("id") == 30000, "quit").when(F.col("id") == 29999, "exit").otherwise("x").alias("text"),
    )
    cut = {0: 30000, 3000: 29999}
    want = sum(1 for i in range(n) if i < cut.get(0 if i % 3 == 0 else i // 10 + 1, n))
    rows, plan = final_plan(conversations.truncate_at_sentinel(turns))
    assert len(rows) == want and "skew=true" in plan


def test_long_conversations_are_cut_into_blocks(spark):
    n = 3000
    turns = spark.range(n).select(
        F.floor(F.col("id") / n).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    pairs = conversations.prompt_completion_pairs(turns, 100)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(conv_id" in plan and "_block" in plan
    assert pairs.where(F.col("prompt").cast("int") + 1 == F.col("completion").cast("int")).count() == n / 2
