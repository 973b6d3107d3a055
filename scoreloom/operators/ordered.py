"""Next row and row number within a key, for keys of any length.

A window over a key puts all its rows into one task. Here rows are cut into blocks of
``size`` consecutive order values, and windows run within a block. Usual keys lie in block
0 whole. Only for keys with rows in other blocks is the one row per block that links it to
its neighbour carried over by a join; those rows are asked for by their order values, which
file statistics answer, and where there are none the joins fall away at run time. Nothing
runs before the result is asked for.

Order values tell the rows of a key apart; one that is null belongs to block 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def block_of(order: str, size: int) -> Column:
    """Block 0 begins at -1, where an added system message stands."""
    return F.coalesce(F.floor((F.col(order) + 1) / size), F.lit(0).cast("long"))


def _elsewhere(order: str, size: int) -> Column:
    return (F.col(order) >= size - 1) | (F.col(order) < -1)


def _in_blocks(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Rows shuffled by key and block. Said outright, since Spark would count rows
    that arrive partitioned by the key alone as good enough."""
    return df.withColumn("_block", block_of(order, size)).repartition(key, "_block")


def _cut_keys(df: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """All rows of the keys that lie in more than block 0, with their block."""
    cut = df.where(_elsewhere(order, size)).select(key).distinct()
    return df.withColumn("_block", block_of(order, size)).join(cut, key, "left_semi")


def with_next(df: DataFrame, key: str, order: str, columns, size: int = BLOCK) -> DataFrame:
    """Add ``next_<column>``: the value in the key's following row, by ``order``."""
    values = F.struct(*columns)
    in_block = Window.partitionBy(key, "_block").orderBy(order)
    inner = _in_blocks(df, key, order, size).withColumn("_next", F.lead(values).over(in_block))

    # The first row of every block but the first, filed under the block before it.
    heads = (
        _cut_keys(df, key, order, size)
        .groupBy(key, "_block")
        .agg(F.min_by(values, F.col(order)).alias("_head"))
    )
    before = F.lag("_block").over(Window.partitionBy(key).orderBy("_block"))
    links = heads.withColumn("_block", before).where(F.col("_block").isNotNull())
    joined = inner.join(links, [key, "_block"], "left")
    # Only the last row of a block lacks a neighbour inside it.
    found = F.coalesce("_next", "_head")
    return joined.withColumns({f"next_{c}": found[c] for c in columns}).drop(
        "_block", "_next", "_head"
    )


def number_in_order(
    df: DataFrame, key: str, order: str, out: str, size: int = BLOCK
) -> DataFrame:
    """Add the zero-based position of a row among its key's rows, by ``order``."""
    position = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        _cut_keys(df, key, order, size)
        .groupBy(key, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.sum("_rows").over(earlier))
        .where(F.col("_offset").isNotNull())
        .drop("_rows")
    )
    return (
        _in_blocks(df, key, order, size)
        .withColumn("_position", position.cast("long") - 1)
        .join(offsets, [key, "_block"], "left")
        .withColumn(out, F.col("_position") + F.coalesce("_offset", F.lit(0)))
        .drop("_block", "_position", "_offset")
    )
