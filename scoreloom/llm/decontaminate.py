"""Benchmark decontamination: an FM-index per shard of training text.

Texts are cut into words (ASCII letters lower-cased; runs of digits, letters a-z
and all characters beyond ASCII). Each task gathers documents into shards. A
shard's words become symbols: one code for each word that some benchmark item
uses, and a separator, different from every other one, for each stretch of other
words and for each end of a document. Over the sorted suffixes of the shard stands
the index: the preceding symbols as a wavelet matrix with counted 64-bit blocks,
and text positions sampled every 16 symbols and at the start of each stretch. All
phrases of the benchmark (windows of 13 words; a shorter item is one phrase) are
searched backward at once, their occurrences located by walking to the next
sampled position, and the hit words of a document merged to spans.

The phrases are held by every task, in blocks of at most ``block_bytes`` of
benchmark text (a single longer item makes a block of its own): one pass per
block, with a written table between passes. Documents are never shuffled, so a hot
source or group of copies costs nothing more.

Defined cases: a null or empty text has no words and is not contaminated; a null or
wordless item has no phrase; items that repeat an id count once; an item without
an id hits but is not listed. Each row of documents gives one row, repeated rows
too. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import rows

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 20
SAMPLED_EVERY = 16
FINDINGS = "n_words bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"

#: Letters to lower case, other characters that form no word to a space.
_FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLDED).split() if text else []


@dataclass
class Phrases:
    """Distinct phrases of a block of items, as word codes from 1."""

    codes: dict[bytes, int]
    matrix: np.ndarray  # a row for each phrase, padded with 0
    lengths: np.ndarray
    items: list[list[str]]  # the items of each phrase


def phrases(items: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Phrases:
    codes: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str]] = {}
    for name, text in items:
        own = [codes.setdefault(w, len(codes) + 1) for w in words_of(text)]
        for i in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[i : i + window]), set()).update([] if name is None else [name])
    matrix = np.zeros((len(owners), window), np.int64)
    for i, phrase in enumerate(owners):
        matrix[i, : len(phrase)] = phrase
    lengths = np.array([len(p) for p in owners], np.int64)
    return Phrases(codes, matrix, lengths, [sorted(x) for x in owners.values()])


class Ranks:
    """A wavelet matrix: how often a symbol stands before a place, and which stands at it."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = max(1, int(largest).bit_length())
        self.blocks, self.before, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            blocks = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.bitwise_count(blocks).astype(np.int64)
            self.blocks.append(blocks)
            self.before.append(np.cumsum(counts) - counts)
            self.zeros.append(len(bits) - int(counts.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _ones(self, depth: int, place: np.ndarray) -> np.ndarray:
        block, rest = place >> 6, (place & 63).astype(np.uint64)
        low = self.blocks[depth][block] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[depth][block] + np.bitwise_count(low)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for depth in range(self.levels):
            one = (symbol >> (self.levels - 1 - depth)) & 1 == 1
            ones, ones_start = self._ones(depth, place), self._ones(depth, start)
            place = np.where(one, self.zeros[depth] + ones, place - ones)
            start = np.where(one, self.zeros[depth] + ones_start, start - ones_start)
        return place - start

    def symbol_and_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, symbol = np.zeros_like(place), np.zeros_like(place)
        for depth in range(self.levels):
            block, rest = place >> 6, (place & 63).astype(np.uint64)
            one = (self.blocks[depth][block] >> rest) & np.uint64(1) == 1
            symbol = symbol * 2 + one
            ones, ones_start = self._ones(depth, place), self._ones(depth, start)
            place = np.where(one, self.zeros[depth] + ones, place - ones)
            start = np.where(one, self.zeros[depth] + ones_start, start - ones_start)
        return symbol, place - start


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order of symbols, where each 0 is a symbol of its own, in order of place,
    below all others; the text ends with one. Doubles the compared length each round and
    sorts again only what is still tied."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, int(ends.sum()) + text)
    base = int(rank.max()) + 2
    second = np.append(np.where(ends[:-1], 0, rank[1:] + 1), 0)
    key = rank * base + second
    known = 2
    if base < 2_000_000:
        beyond = np.append(np.where(ends[:-1] | ends[1:], 0, np.append(rank[2:] + 1, 0)), 0)
        key = key * base + beyond
        known = 3
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    tied = np.arange(n)
    key = key[order]
    while len(tied):
        first = np.append(True, key[1:] != key[:-1])
        group = tied[np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))]
        rank[order[tied]] = group
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        if not len(tied):
            break
        suffixes = order[tied]
        key = rank[suffixes] * (n + 1) + rank[suffixes + known]
        again = np.argsort(key, kind="stable")
        order[tied] = suffixes[again]
        key = key[again]
        known *= 2
    return order


class Index:
    """FM-index over the symbols of a shard (see the module)."""

    def __init__(self, text: np.ndarray, largest: int):
        order = sorted_suffixes(text)
        preceding = np.where(order > 0, text[order - 1], 0)
        self.ranks = Ranks(preceding, largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        begins = np.append(True, text[:-1] == 0)
        sampled = (begins | (np.arange(len(text)) % SAMPLED_EVERY == 0))[order]
        self.sampled, self.places = sampled, order[sampled]
        self.nth = np.cumsum(sampled) - 1

    def search(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases; an empty range where a phrase doesn't occur."""
        low, high = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            active = np.flatnonzero(lengths == length)
            last = matrix[active, length - 1]
            lo, hi = self.first[last], self.first[last + 1]
            for i in range(length - 2, -1, -1):
                live = lo < hi
                active, lo, hi = active[live], lo[live], hi[live]
                symbol = matrix[active, i]
                lo = self.first[symbol] + self.ranks.rank(symbol, lo)
                hi = self.first[symbol] + self.ranks.rank(symbol, hi)
            low[active], high[active] = lo, hi
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text places of rows."""
        place, steps = np.empty_like(row), np.zeros_like(row)
        open_, row = np.arange(len(row)), row.copy()
        while len(open_):
            done = self.sampled[row[open_]]
            at = open_[done]
            place[at] = self.places[self.nth[row[at]]] + steps[at]
            open_ = open_[~done]
            if len(open_):
                symbol, rank = self.ranks.symbol_and_rank(row[open_])
                row[open_] = self.first[symbol] + rank
                steps[open_] += 1
        return place


def coded(found: Phrases, words: list[bytes]) -> np.ndarray:
    """The codes of the words, 0 for a word of no item: 4 bytes each while a shard is gathered."""
    return np.fromiter((found.codes.get(w, 0) for w in words), np.int32, len(words))


def search_shard(found: Phrases, texts: list[list[bytes]]) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """For each document of a shard: the items found and the merged spans of hit words."""
    return search_coded(found, [coded(found, t) for t in texts])


def search_coded(found: Phrases, texts: list[np.ndarray]) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """``search_shard`` of coded words."""
    out: list = [([], []) for _ in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    codes = np.zeros(starts[-1], np.int64)
    for t, a in zip(texts, starts.tolist()):
        codes[a : a + len(t)] = t
    inside = codes > 0
    if not len(found.lengths) or not inside.any():
        return out
    kept = np.flatnonzero(inside | np.append(False, inside[:-1]))
    index = Index(codes[kept], len(found.codes))
    low, high = index.search(found.matrix, found.lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    if not len(phrase):
        return out
    row = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts) + low[phrase]
    begin = kept[index.locate(row)]
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + found.lengths[phrase], -1)
    hit = np.append(False, np.cumsum(change) > 0).astype(np.int8)
    edges = np.diff(hit)
    firsts, lasts = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(starts, firsts, side="right") - 1
    for d, a, b in zip(owner.tolist(), firsts.tolist(), lasts.tolist()):
        out[d][1].append((a - int(starts[d]), b - int(starts[d])))
    of = np.searchsorted(starts, begin, side="right") - 1
    names: dict[int, set[str]] = {}
    for pair in np.unique(of * len(counts) + phrase).tolist():
        names.setdefault(pair // len(counts), set()).update(found.items[pair % len(counts)])
    for d, those in names.items():
        out[d] = (sorted(those), out[d][1])
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(
    df: DataFrame, text: str, found: Phrases, shard_words: int, again: bool, keep: list[str]
) -> DataFrame:
    """One block of phrases against all documents."""
    held = df.sparkSession.sparkContext.broadcast(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        waiting: list[tuple[list[np.ndarray], pa.RecordBatch]] = []
        size = 0

        def flush() -> Iterator[list[pa.Array]]:
            results = iter(search_coded(held.value, [t for texts, _ in waiting for t in texts]))
            for texts, batch in waiting:
                own = [next(results) for _ in texts]
                if again:
                    old = zip(batch["items"].to_pylist(), batch["spans"].to_pylist())
                    own = [
                        (sorted({*i, *j}), _merged([*s, *((x["start"], x["end"]) for x in t)]))
                        for (i, s), (j, t) in zip(own, old)
                    ]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield [
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([i for i, _ in own], pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s in own], span),
                ]

        for batch in batches:
            texts = [coded(held.value, words_of(t)) for t in batch["text"].cast(pa.binary()).to_pylist()]
            waiting.append((texts, batch.drop_columns("text")))
            size += sum(map(len, texts))
            if size >= shard_words:
                yield from flush()
                waiting, size = [], 0
        if waiting:
            yield from flush()

    inputs = {"text": text}
    if again:
        inputs |= {c: c for c in ("items", "spans")}
    return rows.through_arrow(df, inputs, work, FINDINGS, keep)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    phrase: str = "text",
    window: int = WINDOW,
    percent: int = 5,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents (the columns ``keep``, else all) with ``n_words``, the ``items`` found, ``spans`` of hit words (first
    and one past the last), ``n_hit`` and ``contaminated``: whether the hit words are at
    least ``percent`` of all."""
    own = benchmark.select(
        F.col(item).cast("string").alias("name"), F.col(phrase).cast("binary").alias("text")
    ).filter(F.col("text").isNotNull()).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    block = F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks))
    keep = docs.columns if keep is None else keep
    found = docs
    for i in range(n_blocks):
        items = own.filter(block == i).collect()
        if i:
            found = written(found, "contamination")
        block_of = phrases([(r["name"], bytes(r["text"])) for r in items], window)
        still = [*keep, *({text} - {*keep} if i < n_blocks - 1 else ())]
        found = _pass(found, text, block_of, shard_words, i > 0, still)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)
    )


def digest(found: DataFrame) -> DataFrame:
    """One row per document with its counts and the hash of its sorted items."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )
