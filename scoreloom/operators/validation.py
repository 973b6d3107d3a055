"""Checks on incoming rows. A bad row goes to a reject table with its reason;
``strict`` callers turn any reject into an error instead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels


@dataclass(frozen=True)
class Checked:
    """Rows that passed and rows that did not (``reason``, ``missing``)."""

    accepted: DataFrame
    rejected: DataFrame


def missing_columns(required) -> Column:
    """Names of the required columns that are null in a row."""
    names = [F.when(F.col(f"`{name}`").isNull(), F.lit(name)) for name in required]
    return F.array_compact(F.array(*names))


def require_present(df: DataFrame, required) -> None:
    """Fail at once, before any row is read, if a column is absent."""
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise ValueError(f"missing required columns: {absent}")


def require_columns(df: DataFrame, required) -> Checked:
    """Absent columns are an error; rows with null cells are set apart."""
    require_present(df, required)
    marked = df.withColumn("missing", missing_columns(required))
    return Checked(
        accepted=marked.where(F.size("missing") == 0).drop("missing"),
        rejected=marked.where(F.size("missing") > 0).withColumn(
            "reason", F.lit("missing required value")
        ),
    )


def require_gold(df: DataFrame, gold_index: Column, reason: str = "invalid label") -> Checked:
    """Keep rows whose label has an index, adding it as ``gold_index``."""
    marked = df.withColumn("gold_index", gold_index)
    no_names = F.array().cast("array<string>")
    return Checked(
        accepted=marked.where(F.col("gold_index").isNotNull()),
        rejected=marked.where(F.col("gold_index").isNull())
        .drop("gold_index")
        .withColumns({"missing": no_names, "reason": F.lit(reason)}),
    )


def gold_set_or_skip(df: DataFrame, label: str) -> Checked:
    """Multi-answer labels: rows whose answer set is unknown are skipped."""
    index = labels.gold_index_normalized(F.col(label), labels.ANSWER_SETS)
    return require_gold(df, index, reason="unknown answer set")


def choice_text(options: Column, key: str) -> Column:
    """Text under a key in an array of (key, text) pairs; null when absent."""
    at = F.array_position(options["key"], key) - 1
    return F.get(options, at.cast("int"))["text"]


def missing_choices(options: Column, letters=labels.FOUR_CHOICES) -> Column:
    """Letters that have no text among the options."""
    with_text = F.filter(options, lambda option: option["text"].isNotNull())
    return F.array_except(
        labels.domain(letters), F.coalesce(with_text["key"], F.array().cast("array<string>"))
    )


def require_all_choices(df: DataFrame, options: str = "options") -> Checked:
    """Every letter A-D must have a text."""
    marked = df.withColumn("missing", missing_choices(F.col(options)))
    return Checked(
        accepted=marked.where(F.size("missing") == 0).drop("missing"),
        rejected=marked.where(F.size("missing") > 0).withColumn(
            "reason", F.lit("choice without text")
        ),
    )


def raise_on_rejects(checked: Checked) -> DataFrame:
    """Strict mode: the first reject met stops the job with its reason."""
    bad = checked.rejected.select(
        F.raise_error(
            F.concat_ws(" ", F.col("reason"), F.array_join("missing", ","))
        ).alias("_stop")
    )
    failing = bad.where(F.col("_stop").isNotNull())
    good = checked.accepted
    return good.unionByName(failing.drop("_stop"), allowMissingColumns=True)
