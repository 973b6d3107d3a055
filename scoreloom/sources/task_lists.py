"""Task lists and task specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

LIST_FOLDER = "tasks/"


def scan_task_list(spark: SparkSession, path: str) -> DataFrame:
    """(task, shots) from lines ``task|shots``."""
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    return lines.select(
        F.split_part("value", F.lit("|"), F.lit(1)).alias("task"),
        F.split_part("value", F.lit("|"), F.lit(2)).try_cast("int").alias("shots"),
    )


def is_list_path(spec: Column) -> Column:
    """A specification that names a list file instead of tasks."""
    return F.startswith(strip(spec), F.lit(LIST_FOLDER))


def task_specs(spec: Column, default_shots: int = 0) -> Column:
    """Tasks of a comma list, each with its number of shots, in order."""
    entries = F.filter(F.transform(F.split(spec, ","), strip), lambda entry: entry != "")
    numbered = F.transform(
        entries,
        lambda entry: F.when(
            F.substring_index(entry, "|", -1).rlike(r"^\p{Nd}+\z"), entry
        ).otherwise(F.concat(entry, F.lit(f"|{default_shots}"))),
    )
    return F.when(is_list_path(spec), F.array(strip(spec))).otherwise(numbered)


def normalize_task_spec(df: DataFrame, spec: str, default_shots: int = 0) -> DataFrame:
    """One row per task of a specification, with its place in it."""
    return df.select("*", F.posexplode(task_specs(F.col(spec), default_shots))).withColumnsRenamed(
        {"pos": "position", "col": "task_spec"}
    )
