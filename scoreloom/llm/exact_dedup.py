"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each input partition takes the fingerprints of its texts (the high bits of a 64-bit hash,
   ``ceil(log2(rows)) + SPARE`` of them), in blocks of ``BLOCK`` rows, sorts the distinct ones
   and cuts them at the ranges of the owners. Each piece goes to its owner as one row: the
   gaps between neighbours, Golomb-Rice coded, some ``SPARE + 1 + log2(blocks)`` bits a text.
2. An owner decodes the pieces of its range and answers each with a bitmap: which of its
   fingerprints other blocks have too. Ranges are even, since hashes are, and a text that a
   third of all rows share is one fingerprint per block.
3. A row is suspect if its block held its fingerprint twice, or if the bitmap says so; its
   place in the bitmap was noted with it. Rows and bitmaps meet by block and owner.
4. Texts of suspects alone are shuffled: grouped by fingerprint and the whole text, which
   compares their bytes, and combined before the shuffle, so that a hot text is sent once per
   task. Each group says which row stays and how many rows it has.

A shorter fingerprint costs false suspects (about one text in ``2 ** SPARE``), which step 4
finds to be single, and never a wrong result. Rows and pieces are written to the shared folder
by step 1 and read by later ones, so block numbers are settled there and a lost executor's
tasks can be run again anywhere. Suspect fingerprints go to every task if they are at most
``BROADCAST_ROWS`` by count; beyond that the same join is shuffled.

Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal
texts the row with the largest key stays; null keys come first. Rows that repeat key and text
are one document, and all say that it stays, or not. Each row gives one row. Two
different texts with one SHA-256 would be an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import rows

#: Rows of a block, whose fingerprints a task holds at once.
BLOCK = 1 << 18
#: Fingerprints that an owner is to hold, on average.
OWNED = 1 << 20
#: Bits of a fingerprint beyond those that number the rows.
SPARE = 10
#: Suspect fingerprints that may be sent to every task, 16 MB at most.
BROADCAST_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def rice_bits(n: int, span: int) -> int:
    """Low bits that are written as they are, for ``n`` values spread over ``span``."""
    return max(0, int(math.log2(max(1.0, span / max(n, 1) * math.log(2)))))


def encode(values: np.ndarray, low: int, k: int) -> bytes:
    """Rising distinct values from ``low`` on, as gaps: first all high parts, each as many ones
    as it counts and a zero, filled up to a byte, then all low parts of ``k`` bits."""
    gaps = np.diff(values.astype(np.int64), prepend=low - 1) - 1
    zeros = np.cumsum((gaps >> k) + 1) - 1
    high = np.ones(int(zeros[-1]) + 1 if len(zeros) else 0, dtype=np.uint8)
    high[zeros] = 0
    below = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return np.packbits(high).tobytes() + np.packbits(below.astype(np.uint8)).tobytes()


def decode(code: bytes, n: int, low: int, k: int) -> np.ndarray:
    """The ``n`` values of :func:`encode`."""
    data = np.frombuffer(code, dtype=np.uint8)
    zeros = np.flatnonzero(np.unpackbits(data) == 0)[:n]
    split = int(zeros[-1]) // 8 + 1
    high = np.diff(zeros, prepend=-1) - 1
    below = np.unpackbits(data[split:], count=n * k).reshape(n, k).astype(np.int64)
    gaps = (high << k) + below @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) + low - 1


def range_starts(bits: int, owners: int) -> list[int]:
    """The least fingerprint of each owner, and one past the last."""
    return [(o << bits) // owners for o in range(owners + 1)]


_ROWS = "row struct<{key} sha:binary,print:bigint,block:bigint,owner:int,place:int,again:boolean>"
_PIECE = "piece struct<block:bigint,owner:int,n:int,k:int,code:binary>"


def _block(held: list[pa.RecordBatch], number: int, bits: int, owners: int, cuts: np.ndarray):
    """Rows and pieces of one block."""
    batch = pa.Table.from_batches(held).combine_chunks()
    prints = np.asarray(batch.column("hash").combine_chunks()).view(np.uint64) >> np.uint64(64 - bits)
    prints = prints.astype(np.int64)
    distinct, place, times = np.unique(prints, return_inverse=True, return_counts=True)
    edge = np.searchsorted(distinct, cuts)
    owner = np.searchsorted(cuts, prints, side="right") - 1
    columns = {
        "key": batch.column("key").combine_chunks(),
        "sha": batch.column("sha").combine_chunks(),
        "print": pa.array(prints),
        "block": pa.array(np.full(len(prints), number)),
        "owner": pa.array(owner.astype(np.int32)),
        "place": pa.array((place - edge[owner]).astype(np.int32)),
        "again": pa.array(times[place] > 1),
    }
    struct = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    pieces = []
    for o in range(owners):
        own = distinct[edge[o] : edge[o + 1]]
        if len(own):
            low = int(cuts[o])
            k = rice_bits(len(own), int(cuts[o + 1]) - low)
            pieces.append((number, o, len(own), k, encode(own, low, k)))
    kind = pa.struct(
        [("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary())]
    )
    names = [f.name for f in kind]
    coded = pa.array([dict(zip(names, p)) for p in pieces], kind)
    return struct, coded


def _sent(batches: Iterator[pa.RecordBatch], bits: int, owners: int, block: int) -> Iterator[pa.RecordBatch]:
    """A partition's rows, and its pieces for the owners, in one table of two columns."""
    cuts = np.array(range_starts(bits, owners), dtype=np.int64)
    first = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    count = done = 0

    def out():
        struct, coded = _block(held, first + done, bits, owners, cuts)
        for start in range(0, len(struct), 1 << 14):
            part = struct.slice(start, 1 << 14)
            yield pa.RecordBatch.from_arrays([part, pa.nulls(len(part), coded.type)], names=["row", "piece"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(coded), struct.type), coded], names=["row", "piece"])

    for batch in batches:
        for start in range(0, batch.num_rows, block):
            held.append(batch.slice(start, block))
            count += held[-1].num_rows
            if count >= block:
                yield from out()
                held, count, done = [], 0, done + 1
    if count:
        yield from out()


def _answered(pieces: pd.DataFrame, bits: int, owners: int) -> pd.DataFrame:
    """An owner's bitmaps: bit i of a block's is set if its i-th fingerprint is in other blocks."""
    low = range_starts(bits, owners)[int(pieces["owner"].iloc[0])]
    lists = [decode(p.code, p.n, low, p.k) for p in pieces.itertuples()]
    _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = times[place] > 1
    ends = np.cumsum([len(x) for x in lists])
    maps = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])]
    return pd.DataFrame({"block": pieces["block"], "owner": pieces["owner"], "bitmap": maps})


def suspects(
    docs: DataFrame, key: str, text: str, spare: int = SPARE, owned: int = OWNED, block: int = BLOCK
) -> tuple[DataFrame, int]:
    """Each row's ``key``, ``sha`` (of the normalised text), ``print`` and ``suspect``; and the
    number of bits of a print."""
    spark = docs.sparkSession
    rows.ship(spark)
    n = docs.count()
    bits = min(62, max(1, math.ceil(math.log2(max(n, 2)))) + spare)
    owners = min(1 << bits, math.ceil(max(n, 1) / owned))
    # The array of one element stands for "let": a text is normalised once.
    plain = F.transform(F.array(normalised(F.col(text))), lambda t: F.struct(
        F.xxhash64(t).alias("hash"), F.unhex(F.sha2(t, 256)).alias("sha")
    ))[0]
    given = docs.select(F.col(key).alias("key"), plain.alias("p")).select("key", "p.hash", "p.sha")
    kind = given.schema["key"].dataType.simpleString()
    made = f"{_ROWS.format(key=f'key:{kind},')}, {_PIECE}"
    sent = given.mapInArrow(partial(_sent, bits=bits, owners=owners, block=block), made)
    sent = written(sent, "fingerprints")
    noted = sent.filter("row IS NOT NULL").select("row.*")
    pieces = sent.filter("piece IS NOT NULL").select("piece.*")

    def answer(own: pd.DataFrame) -> pd.DataFrame:
        return _answered(own, bits, owners)

    answers = pieces.groupBy("owner").applyInPandas(answer, "block bigint, owner int, bitmap binary")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.getbit(byte.cast("int"), 7 - F.col("place") % 8) == 1
    met = noted.join(answers, ["block", "owner"])
    return met.select("key", "sha", "print", (F.col("again") | bit).alias("suspect")), bits


def exact_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    spare: int = SPARE,
    owned: int = OWNED,
    block: int = BLOCK,
) -> DataFrame:
    """Per row its ``key``, ``keep_id`` (key of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` (hexadecimal, of the normalised text)."""
    marked, bits = suspects(docs, key, text, spare, owned, block)
    marked = written(marked, "marked")
    prints = written(marked.filter("suspect").select("print").distinct(), "suspects")
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    plain = docs.select(F.col(key).alias("key"), normalised(F.col(text)).alias("plain"))
    high = F.shiftrightunsigned(F.xxhash64("plain"), 64 - bits)
    texts = plain.select("key", "plain", high.alias("print")).join(prints, "print", "left_semi")
    # Grouping by the text compares bytes.
    groups = texts.groupBy("print", "plain").agg(F.max("key").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("print", F.unhex(F.sha2("plain", 256)).alias("sha"), "keep_id", "group_size")
    one = groups.filter("group_size > 1").groupBy("sha").agg(
        F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size")
    )
    wrong = F.raise_error(F.lit("two different texts have one SHA-256"))
    sizes = F.when(F.col("texts") > 1, wrong.cast("bigint")).otherwise(F.col("group_size"))
    one = one.select(F.col("sha").alias("_sha"), "keep_id", sizes.alias("group_size")).hint("rebalance")
    found = marked.filter("suspect").join(one, F.col("sha") == F.col("_sha"), "left")
    alone = F.col("group_size").isNull()
    found = found.select(
        "key",
        F.when(alone, F.col("key")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        "sha",
    )
    single = marked.filter("NOT suspect").select(
        "key", F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha"
    )
    return found.unionByName(single).select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
