"""Label domains and the position of a label in its domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The legal labels, in the order that gives each its index.
FOUR_CHOICES = ("A", "B", "C", "D")
TRUE_FALSE_UNKNOWN = ("T", "F", "X")
ANSWER_SETS = (
    "A", "B", "C", "D", "AB", "AC", "AD", "BC", "BD", "CD",
    "ABC", "ABD", "ACD", "BCD", "ABCD", "",
)


def domain(labels) -> Column:
    return F.array(*[F.lit(label) for label in labels])


def choices(labels) -> Column:
    """Scored choices as a model sees them: a space, then the label."""
    return F.array(*[F.lit(" " + label) for label in labels])


def gold_index_strict(label: Column, labels=FOUR_CHOICES) -> Column:
    """Index of a label written exactly as in the domain; null otherwise."""
    position = F.array_position(domain(labels), label)
    return F.when(position > 0, (position - 1).cast("int"))


def gold_index_normalized(label: Column, labels=FOUR_CHOICES) -> Column:
    """Index of a label after stripping and upper-casing; null otherwise."""
    return gold_index_strict(F.upper(strip(label)), labels)


def gold_index_mixed(label: Column, labels=FOUR_CHOICES) -> Column:
    """Index of a label that is a letter, or already an index and taken as it is."""
    return F.when(label.rlike(r"^-?[0-9]+$"), label.try_cast("int")).otherwise(
        gold_index_strict(label, labels)
    )
