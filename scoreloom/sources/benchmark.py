"""Benchmark slices, kept as a dataset partitioned by repo, subset and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["repo", "subset", "split"]


def scan_benchmark(
    spark: SparkSession, root: str, repo: str, subset: str, split: str
) -> DataFrame:
    """One slice; only its folders are listed and read."""
    df = spark.read.parquet(root)
    return df.where(
        (F.col("repo") == repo) & (F.col("subset") == subset) & (F.col("split") == split)
    )


def write_benchmark(lines: DataFrame, root: str) -> None:
    gathered = lines.hint("rebalance", *PARTITIONS)
    gathered.write.partitionBy(*PARTITIONS).mode("append").parquet(root)


def evaluation_lines(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """Lines scored by each task: its repo and subset, its evaluation split only.

    A line serves every task that names its slice.
    """
    wanted = registry.select("task", "repo", "subset", F.col("evaluation_split").alias("split"))
    return lines.join(wanted, PARTITIONS)
