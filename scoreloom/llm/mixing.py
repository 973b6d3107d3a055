"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents, shuffled by a hash, repeated at most
``repeats`` times (each time in the same order). A document's virtual finish time is the
words of its source up to and including it, divided by the source's target. All copies
are sorted by that time, as ranges, and taken until the budget is reached: at any time all
sources have advanced equally towards their targets.

Targets share the budget by weight; one above ``repeats`` times its source's size stops
there and the rest is shared again, until none is above.

Sums along an order are made in two steps: totals per bucket (of a source's hash, then of
the finish time), summed up over the buckets, and a window within a bucket. There are as
many buckets as the square root of the number of rows, so a source that holds most rows is
split like the others and no task gets more than about that many rows; one row per source
and one per bucket meet in one task. Documents are carried as (key, size), never with their
texts.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a
source, the last one; sources without words have target 0. Ties in the order go by source,
key and size; rows equal in all of them are numbered, and spread by the number like other rows.
Null keys are keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.session import written

from . import rows

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Rows that are alike which are numbered at once.
STEP = 10_000


def targets(sizes: DataFrame, budget: float, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source: one row a source.

    ``sizes`` has ``source`` and ``source_size``. Weights go round in order of code points,
    null last. What stops at its limit is found by the order of limit over weight: a source
    is above the share per weight that the rest would get exactly if it comes early enough.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth + 1).cast("int"))
    limit = F.col("source_size") * float(repeats)
    own = sizes.withColumn("weight", weight).withColumn("limit", limit)
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, W.unboundedFollowing)
    left = F.lit(float(budget)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    share = left / F.sum("weight").over(after)
    own = own.withColumn("share", share).withColumn("stops", F.col("limit") <= F.col("share") * F.col("weight"))
    # The first source below its limit sets the share; shares only fall after it.
    level = F.max(F.when(~F.col("stops"), F.col("share"))).over(W.partitionBy())
    target = F.least(F.col("limit"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return own.select("source", "source_size", target.alias("target"))


def _sum_before(df: DataFrame, within: list[Column], bucket: str, order: list[Column], size: str) -> DataFrame:
    """``df`` with ``sum_before``: the sizes that stand before a row, in the order of
    ``bucket`` and then ``order``, for each group ``within``."""
    names = [f"_w{i}" for i in range(len(within))]
    keyed = df.withColumns(dict(zip(names, within)))
    totals = keyed.groupBy(*names, bucket).agg(F.sum(size).alias("_total"))
    earlier = W.partitionBy(*names).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *(F.col(n).alias(f"{n}t") for n in names),
        F.col(bucket).alias("_bt"),
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy(*names, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    same = reduce(
        lambda a, b: a & b,
        [F.col(n).eqNullSafe(F.col(f"{n}t")) for n in names],
        F.col(bucket) == F.col("_bt"),
    )
    return placed.join(totals, same).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias("sum_before")
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    budget: int | None = None,
    weights=WEIGHTS,
    repeats: int = REPEATS,
    seed: int = 10,
) -> DataFrame:
    """One row per document: ``key``, ``source``, ``size``, ``source_size``, ``target`` and
    ``taken``, the words the mix takes of it, repeats counted. ``size`` defaults to the
    number of words of ``text``, ``budget`` to the sum of all sizes."""
    size = F.size(rows.words(F.col("text"))) if size is None else size
    sized = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"),
    )
    # Rows that are alike are told apart by a number, so that they spread as others do.
    alike = sized.groupBy("key", "source", "size").agg(F.count("*").alias("_rows"))
    last = F.floor((F.col("_rows") - 1) / STEP)
    steps = alike.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    upto = F.least(F.col("_rows"), (F.col("_step") + 1) * STEP) - 1
    each = steps.withColumn("nth", F.explode(F.sequence(F.col("_step") * STEP, upto)))
    shuffled = F.xxhash64("key", "size", F.lit(seed))
    shuffled = F.when(F.col("nth") == 0, shuffled).otherwise(F.xxhash64("key", "size", F.lit(seed), "nth"))
    sized = written(each.select("key", "source", "size", "nth", shuffled.alias("hash")), "mix-sizes")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, total if budget is None else budget, weights, repeats)
    buckets = math.isqrt(n) + 1
    ordered = [F.col("hash"), F.col("key"), F.col("size"), F.col("nth")]
    queued = sized.withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 20), F.lit(buckets)))
    queued = _sum_before(queued, [F.col("source")], "bucket", ordered, "size")
    queued = queued.withColumnRenamed("source", "own")
    joined = queued.join(goal, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    # Every row has its own place in its queue once it is written; its copies go by that.
    placed = written(joined.drop("bucket"), "mix-queues")
    copies = placed.filter("size > 0 AND target > 0").select(
        "key", "source", "size", "source_size", "target", "sum_before",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"),
    )
    finish = (F.col("turn") * F.col("source_size") + F.col("sum_before") + F.col("size")) / F.col("target")
    begin = (F.col("turn") * F.col("source_size") + F.col("sum_before")) / F.col("target")
    limit = total if budget is None else budget
    # By time 1 each source has its target, together the budget: no copy begins later.
    copies = copies.withColumn("finish", finish).filter(begin < 1)
    slot = F.floor(F.least("finish", F.lit(2.0)) * F.lit(float(buckets))).cast("bigint")
    copies = copies.withColumn("bucket", slot)
    ordered = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("place")]
    copies = copies.withColumnRenamed("sum_before", "place")
    copies = _sum_before(copies, [], "bucket", ordered, "size")
    within = copies.filter(F.col("sum_before") + F.col("size") <= limit)
    taken = within.groupBy(F.col("source").alias("_source"), F.col("place").alias("_place")).agg(
        F.sum("size").alias("taken")
    )
    same = (
        F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("sum_before") == F.col("_place"))
        & (F.col("size") > 0)
    )
    return placed.join(taken, same, "left").select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )
