"""Result files: every ``*.json`` at any depth below a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.results import parse_payload
from ..operators.validation import Checked


def plain_path(uri: Column) -> Column:
    """A file URI as the path a user would write; other schemes keep theirs."""
    local = F.regexp_replace(uri, r"^file:/+", "/")
    return F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))


def scan_result_files(spark: SparkSession, root: str) -> DataFrame:
    """(json_path, value), one row per file."""
    return (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(root)
        .select(plain_path(F.col("_metadata.file_path")).alias("json_path"), "value")
    )


def decode(files: DataFrame) -> DataFrame:
    """(json_path, payload), the payload null for a file that is not JSON.

    An object that repeats a key keeps the last value, which this session's reader of
    variants is set to.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return files.select("json_path", parse_payload(F.col("value")).alias("payload"))


def parse_results_tolerant(files: DataFrame) -> Checked:
    """Decode each file; those that are not JSON are set apart, not fatal.

    What goes on to ``task_entries`` needs no filter and is better taken from ``decode``:
    the condition would decode every payload a second time.
    """
    parsed = decode(files)
    return Checked(
        accepted=parsed.where(F.col("payload").isNotNull()),
        rejected=parsed.where(F.col("payload").isNull()).select(
            "json_path", F.lit("not JSON").alias("reason")
        ),
    )
