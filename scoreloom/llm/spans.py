"""Places of pattern matches in a text, as columns of Spark's own functions.

The pieces between matches come from a split at the pattern, the matches from an
extraction by it; a match starts where the lengths so far add up to. Lengths are code
points. Sums run in blocks of the square root of their number, so that a text with very
many matches stays far from quadratic work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a neighbouring piece that count as context.
CONTEXT = 48


def _whole(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda total, n: total + n)


def sums_before(sizes: Column) -> Column:
    """For each element, the sum of those before it."""
    width = F.greatest(F.ceil(F.sqrt(F.size(sizes))), F.lit(1)).cast("int")

    def of(packed: Column) -> Column:
        n, width, before = packed["n"], packed["width"], packed["before"]
        return F.transform(
            n,
            lambda _, i: before[(i / width).cast("int")]
            + _whole(F.slice(n, (i / width).cast("int") * width + 1, i % width)),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(sizes) - 1) / width).cast("int")),
        lambda b: _whole(F.slice(sizes, b * width + 1, width)),
    )
    before = F.aggregate(
        blocks, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n))
    )
    packed = F.struct(sizes.alias("n"), width.alias("width"), before.alias("before"))
    filled = F.transform(F.array(packed), of)[0]
    return F.when(F.size(sizes) > 0, filled).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0, context: bool = False) -> Column:
    """Matches of a pattern that never matches nothing: ``start``, ``end`` (code points from
    0, the end exclusive) and ``value`` (of the group); with ``context`` also what stands
    ``left`` and ``right`` of them, up to the next match."""

    def of(given: Column) -> Column:
        pieces, whole, value, starts = (given[k] for k in ("pieces", "whole", "value", "starts"))

        def one(at: Column, i: Column) -> Column:
            start = at + F.length(pieces[i])
            parts = [
                start.alias("start"),
                (start + F.length(whole[i])).alias("end"),
                value[i].alias("value"),
            ]
            if context:
                left, right = pieces[i], pieces[i + 1]
                parts += [
                    F.substring(left, -CONTEXT, CONTEXT).alias("left"),
                    F.substring(right, 1, CONTEXT).alias("right"),
                ]
            return F.struct(*parts)

        return F.transform(starts, one)

    expression = F.lit(pattern)
    cut = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, expression, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, expression, F.lit(group)).alias("value"),
    )

    def measured(c: Column) -> Column:
        sizes = F.transform(c["whole"], lambda m, i: F.length(m) + F.length(c["pieces"][i]))
        return F.struct(
            c["pieces"].alias("pieces"),
            c["whole"].alias("whole"),
            c["value"].alias("value"),
            sums_before(sizes).alias("starts"),
        )

    # Arrays of one element stand for "let": what is bound is worked out once.
    some = F.transform(F.transform(F.array(cut), measured), of)[0]
    none = F.filter(F.array(_empty(context)), lambda _: F.lit(False))
    return F.when(F.regexp_like(text, expression), some).otherwise(none)


def _empty(context: bool) -> Column:
    parts = [F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("value")]
    if context:
        parts += [F.lit("").alias("left"), F.lit("").alias("right")]
    return F.struct(*parts)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
