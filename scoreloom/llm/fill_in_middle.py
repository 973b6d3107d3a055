"""Fill-in-middle: texts cut in three at token boundaries and put together in another order.

Each batch is a pipeline of ``pyarrow.compute`` calls over columns, without a loop over texts:
a mark is put behind every unit (``[A-Za-z]+`` or one other code point), texts are split at
the marks into list arrays, the lists are flattened beside the indices of their parents, a
unit's ordinal is its place less its parent's first place, its role follows from the ordinal
and the two cut points, units of one role are filtered out and put back into lists by running
sums of their numbers, and the lists and sentinels are joined.

The mark is a byte that no UTF-8 text has, so texts are treated as bytes there; the pattern
spells out what one code point is in bytes.

Cut points, form and order come from hashes of the key that Spark computes, so a row's result
depends on nothing but the row. A task holds one piece of a batch at a time, of
``PIECE_BYTES`` or one text.

Defined cases: a null text counts as empty; an empty text and one with a sentinel in it are
plain, the output is the text. A null key hashes as empty text. Rows that repeat a key and
text give the same output. ``prefix_chars`` and ``middle_chars`` are null if plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those, percent with the suffix in front.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text that are cut at once.
PIECE_BYTES = 4 << 20

#: One unit in the bytes of a UTF-8 text: letters, or any other code point.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC2-\xF4][\x80-\xBF]+"
_MARK = b"\xff"


def hashed(key: Column, nth: int) -> Column:
    """The nth group (from 1) of 8 digits of the hash of a key, as a number."""
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * nth - 7, 8), 16, 10).cast("bigint")


def _modulo(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """All units, the index of the text and the ordinal of each, and how many a text has."""
    data = texts.cast(pa.large_binary())
    marked = pc.replace_substring_regex(data, UNIT, rb"\0" + _MARK)
    lists = pc.split_pattern(marked, _MARK)  # and an empty piece behind the last mark
    parents, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    sizes = pc.list_value_length(lists).cast(pa.int64())
    first = pc.subtract(pc.cumulative_sum(sizes), sizes)
    place = pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(flat))), 1)
    ordinal = pc.subtract(place, pc.take(first, parents))
    real = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(real), parents.filter(real), ordinal.filter(real), pc.subtract(sizes, 1)


def _rebuilt(units: pa.Array, numbers: pa.Array) -> pa.Array:
    """Units as one text per list, given how many belong to each list."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(numbers)])
    lists = pa.LargeListArray.from_arrays(offsets, units)
    return pc.binary_join(lists, pa.scalar(b"", units.type)).cast(pa.large_string())


def transform(texts: pa.Array, hashes: list[pa.Array], cut: int, suffix_first: int) -> list[pa.Array]:
    """Number of units, form, output, code points of prefix and of middle."""
    hundred = pa.scalar(100, pa.int64())
    units, parents, ordinal, n = _units(texts)
    places = [_modulo(h, pc.add(n, 1)) for h in hashes[:2]]
    a, b = pc.min_element_wise(*places), pc.max_element_wise(*places)
    before_a = pc.less(ordinal, pc.take(a, parents))
    before_b = pc.less(ordinal, pc.take(b, parents))
    prefix = _rebuilt(units.filter(before_a), a)
    middle = _rebuilt(units.filter(pc.and_not(before_b, before_a)), pc.subtract(b, a))
    suffix = _rebuilt(units.filter(pc.invert(before_b)), pc.subtract(n, b))
    has_sentinel = pc.match_substring_regex(texts, "|".join((PREFIX, SUFFIX, MIDDLE)))
    plain = pc.or_(
        pc.or_(pc.equal(n, 0), has_sentinel), pc.greater_equal(_modulo(hashes[2], hundred), cut)
    )
    spm = pc.less(_modulo(hashes[3], hundred), suffix_first)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))

    def put(*parts) -> pa.Array:
        parts = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts]
        return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))

    output = pc.if_else(
        plain,
        texts,
        pc.if_else(
            spm,
            put(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle),
            put(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle),
        ),
    )
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [n, form.cast(pa.string()), output.cast(pa.string()), *chars]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in turn, of PIECE_BYTES of text together or one row."""
    sizes = pc.binary_length(batch.column("text")).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > PIECE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size + 1
    yield batch.slice(start)


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    cut: int = CUT,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """The kept columns (all unless named) with ``n`` (units), ``form`` (plain, psm or spm),
    ``output``, ``prefix_chars`` and ``middle_chars``; these replace columns of their names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            done = []
            for piece in _pieces(batch):
                texts = piece.column("text").cast(pa.large_string())
                done.append(transform(texts, [piece.column(f"h{i}") for i in range(1, 5)], cut, suffix_first))
            yield [pa.concat_arrays(column) for column in zip(*done)]

    given = {"text": F.coalesce(F.col(text), F.lit(""))}
    given |= {f"h{i}": hashed(F.col(key), i) for i in range(1, 5)}
    made = "n bigint, form string, output string, prefix_chars bigint, middle_chars bigint"
    return rows.through_arrow(docs, given, work, made, keep)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text has no sentinel in it, so an output
    has one of each, in the order that its form says."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
