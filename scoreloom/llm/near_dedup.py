"""Near duplicates: MinHash signatures and a multi-index Hamming join.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal
sets form one class, so copies of a text, however many, are one node from then on.

A signature has ``CHUNKS * CHUNK`` symbols of 32 bits, the least values of as many random
orders of the shingles. Two sets of similarity s agree in a symbol with probability s.
Signatures whose distance (symbols that differ) is at most ``DISTANCE`` differ, by the
pigeonhole principle, in at most ``ERRORS`` symbols of some chunk. So each signature is
entered under every way to leave out ``ERRORS`` symbols of every chunk, and all pairs within
the distance meet under some entry. A pair of similarity 0.75 is further apart with
probability 4e-6 and meets nowhere with 9e-9, which is 0.15625 ** 10.

Pairs that meet are passed on if their sizes allow the similarity and ``BITS`` one-bit
signature values differ in at most ``FAR`` places (a pair of similarity 0.75 exceeds it with
probability 2e-9). Then their full sets of word shingles are compared, as words.

No group of an entry is turned into pairs as a whole:

1. each member is compared with one pivot only, the nearest of the first and last members
   of its entries; the links give components;
2. entries of at most ``SMALL`` members give their pairs of different components;
3. in a larger entry, members still in different components are compared in blocks of about
   ``BLOCK`` shingles, each task holding two blocks; the members of the largest component are
   not compared with each other. A task returns links that join components, fewer than its
   rows.

So a large group of near copies costs its size, not its square; what remains are texts that
share an entry and are not linked, which no index can tell apart before they are compared.
Links and components are tables throughout.

Defined cases: a document of fewer words than a shingle has its whole sequence as one; one
without words has an empty set, is its own component and is kept. Rows that repeat an id
and a text have the same result; a null id takes part, and is never a component's least
unless it is alone. Each row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import rows
from .components import components

SHINGLE = 5
PERCENT = 75
CHUNKS, CHUNK, ERRORS = 10, 3, 1
SYMBOLS = CHUNKS * CHUNK
DISTANCE = CHUNKS * (ERRORS + 1) - 1
BITS, FAR = 192, 52
SMALL, BLOCK = 16, 300_000
#: Rows of (id, hash) that may be sent to every task, about 8 MB.
BROADCAST_ROWS = 200_000
#: Words whose hash a task remembers.
REMEMBERED = 250_000

_random = np.random.default_rng(5)
_FACTORS = _random.integers(1 << 62, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _random.integers(0, 1 << 63, BITS, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

SKETCH = "n_shingles bigint, class binary, signature binary, b0 bigint, b1 bigint, b2 bigint"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def similar(a: set, b: set, percent: int = PERCENT) -> bool:
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class Hasher:
    """Hashes of words, remembered, and of shingles."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        values = list(map(known.get, words))
        if None in values:
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            values = list(map(known.get, words))
        return np.array(values, np.uint64)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        if not words:
            return np.zeros(0, np.uint64)
        own = self.words(words)
        width = min(SHINGLE, len(words))
        value = np.full(len(own) - width + 1, width, np.uint64)
        for i in range(width):
            value = (value ^ own[i : len(own) - width + 1 + i]) * _P1
            value ^= value >> np.uint64(29)
        value *= _P2
        return np.unique(value ^ (value >> np.uint64(32)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, order]: the least 32-bit values under each of BITS random orders."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), BITS), np.uint32)
    for k in range(BITS):
        value = ((every ^ _SALTS[k]) * _FACTORS[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(value, starts)
    return out


def sketch(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        hasher = Hasher()
        for batch in batches:
            sets = [hasher.shingles(words_of(t)) for t in batch["text"].to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            found = signatures([sets[i] for i in some]) if some else np.zeros((0, BITS), np.uint32)
            packed = np.packbits((found & 1).astype(np.uint8), axis=1).view("<i8")
            at = np.full(len(sets), -1)
            at[some] = np.arange(len(some))
            column = lambda values, kind: pa.array(
                [values[i] if i >= 0 else None for i in at.tolist()], kind
            )
            yield [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(
                    [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    pa.binary(),
                ),
                column([r.tobytes() for r in found[:, :SYMBOLS].astype("<u4")], pa.binary()),
                *(column(packed[:, i].tolist(), pa.int64()) for i in range(3)),
            ]

    return rows.through_arrow(docs, {"text": F.col(text).cast("binary")}, work, SKETCH, keep)


def entries() -> Column:
    """The keys of a signature: for each chunk, every choice of the symbols left in."""
    found = []
    for chunk in range(CHUNKS):
        for left_in in combinations(range(chunk * CHUNK, (chunk + 1) * CHUNK), CHUNK - ERRORS):
            symbols = [F.substring("signature", 4 * i + 1, 4) for i in left_in]
            found.append(F.xxhash64(F.lit(len(found)), *symbols))
    return F.array(*found)


def _sizes_allow(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _differing(a: str, b: str) -> Column:
    return sum(
        (F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(3)), F.lit(0)
    )


def near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of nodes ``u``, ``v`` that may be similar, with their ``distance`` in bits."""
    own = classes.select("node", "n_shingles", "b0", "b1", "b2")
    side = lambda x: own.select(
        F.col("node").alias(x), F.col("n_shingles").alias(f"{x}_n"),
        *(F.col(f"b{i}").alias(f"{x}{i}") for i in range(3)),
    )
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    both = both.withColumn("distance", _differing("u", "v"))
    return both.filter(_sizes_allow("u_n", "v_n") & (F.col("distance") <= FAR)).select(
        *pairs.columns, "distance"
    )


class _Texts:
    """Texts of nodes, read again from the documents."""

    def __init__(self, docs: DataFrame, key: str, text: str, classes: DataFrame):
        self.docs = docs.select(
            F.col(key).alias("_id"), F.xxhash64(text).alias("_version"), F.col(text).alias("text")
        )
        self.first = classes.select("node", "shown.*")

    def of(self, nodes: DataFrame) -> DataFrame:
        wanted = written(nodes.distinct().join(self.first, "node"), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        same = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version"))
        # Rows that repeat an id and a text are one.
        return self.docs.join(wanted, same).groupBy("node").agg(F.max("text").alias("text"))


def confirmed(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """The pairs ``u``, ``v`` whose full sets are similar."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    found = written(texts.of(nodes), "texts")
    side = lambda x: found.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            known: dict[bytes, set] = {}

            def of(text: bytes, known=known) -> set:
                if text not in known:
                    known[text] = shingles_of(words_of(text))
                return known[text]

            texts = zip(batch["u"].to_pylist(), batch["v"].to_pylist())
            yield [pa.array([similar(of(u), of(v)) for u, v in texts], pa.bool_())]

    inputs = {x: F.col(f"{x}_text").cast("binary") for x in ("u", "v")}
    checked = rows.through_arrow(both, inputs, work, "linked boolean", ["u", "v"])
    return checked.filter("linked").select("u", "v")


def _compare_blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Links between members of different components, as many as join them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up] if up in root else up
            x = root[x]
        return x

    group = group.sort_values(["n_shingles", "node"], ignore_index=True)
    n = group["n_shingles"].to_numpy()
    bits = group[["b0", "b1", "b2"]].to_numpy().view(np.uint64)
    symbols = np.frombuffer(b"".join(group["signature"]), "<u4").reshape(-1, CHUNKS, CHUNK)
    nodes, component = group["node"].to_numpy(), group["component"].to_numpy()
    chunk, family = divmod(int(group["family"].iloc[0]), len(_LEFT_IN))
    major = group["major"].to_numpy()
    texts = group["text"].tolist()
    sets: dict[int, set] = {}
    links = []

    def of(i: int) -> set:
        if i not in sets:
            sets[i] = shingles_of(words_of(texts[i].encode()))
        return sets[i]

    for i in range(len(n)):
        others = np.arange(i + 1, int(np.searchsorted(n, 100 * n[i] // PERCENT, side="right")))
        others = others[(component[others] != component[i]) & ~(major[others] & major[i])]
        others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(1) <= FAR]
        if not len(others):
            continue
        # A pair is compared under the first of its entries only.
        same = symbols[others] == symbols[i]
        earlier = (same[:, :chunk].sum(2) >= CHUNK - ERRORS).any(1)
        for own in _LEFT_IN[:family]:
            earlier |= same[:, chunk][:, list(own)].all(1)
        for j in others[~earlier].tolist():
            a, b = find(int(component[i])), find(int(component[j]))
            if a != b and similar(of(i), of(j)):
                root[max(a, b)] = min(a, b)
                links.append((int(nodes[i]), int(nodes[j])))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


_LEFT_IN = list(combinations(range(CHUNK), CHUNK - ERRORS))


def _large_entries(active: DataFrame, classes: DataFrame, texts: _Texts) -> DataFrame:
    """Links found in large entries. ``active`` has ``key``, ``family``, ``node``,
    ``n_shingles`` and ``component``."""
    per = active.groupBy("key", "component").agg(F.sum("n_shingles").alias("n"))
    per = per.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all")
    )
    per = per.select(
        "key",
        F.col("most.component").alias("largest"),
        F.ceil(F.col("most.n") / BLOCK).alias("majors"),
        F.ceil((F.col("all") - F.col("most.n")) / BLOCK).alias("minors"),
    )
    placed = active.join(per.hint("rebalance"), "key").withColumn("major", F.col("component") == F.col("largest"))
    spread = F.xxhash64("node", F.lit(3))
    block = F.when(F.col("major"), F.pmod(spread, "majors")).otherwise(F.pmod(spread, "minors"))
    placed = placed.withColumn("block", block)
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    across = F.when(
        F.col("major"),
        F.transform(to("minors"), lambda j: F.struct(F.lit(True).alias("across"), F.col("block").alias("a"), j.alias("b"))),
    ).otherwise(
        F.concat(
            F.transform(to("majors"), lambda i: F.struct(F.lit(True).alias("across"), i.alias("a"), F.col("block").alias("b"))),
            F.transform(
                to("minors"),
                lambda j: F.struct(
                    F.lit(False).alias("across"),
                    F.least(F.col("block"), j).alias("a"),
                    F.greatest(F.col("block"), j).alias("b"),
                ),
            ),
        )
    )
    own = classes.select("node", "signature", "b0", "b1", "b2")
    found = written(texts.of(active.select("node")).join(own, "node"), "texts")
    dealt = placed.select(
        "key", "family", "node", "n_shingles", "component", "major", F.explode(across).alias("pair")
    ).join(found, "node")
    return dealt.groupBy("key", "pair").applyInPandas(_compare_blocks, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The documents (``key`` and the columns ``keep``) with ``n_shingles``,
    ``component_id`` (the least key reachable) and ``kept`` (whether it is its own)."""
    return grouped(docs, key, text, keep).drop("_version", "_component")


def grouped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The same with ``_version``, the hash of the text, and ``_component``, a number that no
    two components share, whatever their ids; null for a document without words."""
    keep = [key, *(c for c in keep or () if c != key)]
    own = docs.select(*keep, F.xxhash64(text).alias("_version"), F.col(text).alias("_text"))
    sketched = written(sketch(own, "_text", [*keep, "_version"]), "sketches")
    classes = (
        sketched.filter("class IS NOT NULL")
        .groupBy("class", "n_shingles", "signature", "b0", "b1", "b2")
        .agg(
            F.min(key).alias("least"),
            F.min(F.struct(F.col(key).alias("id"), F.col("_version").alias("version"))).alias("shown"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = written(classes, "classes")
    texts = _Texts(docs, key, text, classes)

    keys = classes.select("node", "n_shingles", F.posexplode(entries()).alias("family", "key"))
    ends = keys.groupBy("key").agg(
        F.count("*").alias("members"), F.min("node").alias("low"), F.max("node").alias("high")
    )
    # Apart from its aggregate, so that the join can be split where an entry is large.
    shared = written(keys.join(ends.filter("members > 1").hint("rebalance"), "key"), "entries")

    pivots = shared.select("node", F.explode(F.array("low", "high")).alias("pivot")).filter("node != pivot")
    pairs = pivots.select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    nearest = near_pairs(pairs, classes).groupBy("u").agg(F.min(F.struct("distance", "v")).alias("best"))
    tested = nearest.select(F.least("u", "best.v").alias("u"), F.greatest("u", "best.v").alias("v")).distinct()
    tested = written(tested, "pivots")
    links = written(confirmed(tested, texts), "links")

    def open_entries(links: DataFrame) -> DataFrame:
        """Members of the entries that still hold more than one component."""
        found = components(links)
        labelled = shared.select("key", "family", "node", "n_shingles", "members")
        labelled = labelled.join(found, "node", "left")
        labelled = labelled.withColumn("component", F.coalesce("component", "node"))
        ends = labelled.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
        return written(labelled.join(ends.filter("a != b").select("key").hint("rebalance"), "key"), "open")

    active = open_entries(links)
    small = active.filter(F.col("members") <= SMALL).select("key", "node", "component")
    other = small.select("key", F.col("node").alias("v"), F.col("component").alias("v_component"))
    met = small.withColumnRenamed("node", "u").join(other, "key")
    met = met.filter("u < v AND component != v_component").select("u", "v").distinct()
    met = near_pairs(met.join(tested, ["u", "v"], "left_anti"), classes).select("u", "v")
    links = written(links.unionByName(confirmed(written(met, "met"), texts)), "links")

    large = open_entries(links).filter(F.col("members") > SMALL)
    if not large.isEmpty():
        links = written(links.unionByName(_large_entries(large, classes, texts)), "links")

    found = components(links)
    labelled = classes.select("node", "class", "least").join(found, "node", "left")
    number = F.coalesce("component", "node").alias("_component")
    least = labelled.filter("component IS NOT NULL").groupBy("component").agg(
        F.min("least").alias("component_least")
    )
    labelled = labelled.join(least, "component", "left").select(
        F.col("class"), F.coalesce("component_least", "least").alias("_least"), number
    )
    component = F.when(F.col("class").isNull(), F.col(key)).otherwise(F.col("_least"))
    return (
        sketched.join(labelled, "class", "left")
        .withColumn("component_id", component)
        .select(
            *keep, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"),
            "_version", "_component",
        )
    )
