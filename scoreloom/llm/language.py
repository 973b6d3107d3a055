"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point; a letter trigram
is the product of its letters' vectors, rolled by two, one and no places; a text is the sum
of the vectors of its trigrams (runs of other characters count as one gap, drawn as a
letter), and a language is the sum of its learned texts, each at length one. A text gets
the language of the greatest cosine.

Learned from at most ``per_language`` texts a language, the distinct ones with the smallest
hashes, whole; a text that many rows share counts once. Prototypes are one vector a language. Documents are not shuffled; a very
long text is read piece by piece.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any
learned language all are ``und``. Ties go to the first language by name. A null key is
held out like the empty text and never learned from. Each row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.session import written

from . import rows

DIMENSIONS = 2048
PER_LANGUAGE = 1500
#: Characters of one piece of work.
CHARACTERS = 1 << 20
TRIGRAMS = 4096
#: Rows of (language, hash) that may be sent to every task, about 8 MB: 130 languages.
BROADCAST_ROWS = 200_000

_letters: dict[tuple[int, int], np.ndarray] = {}
_kinds: list[np.ndarray] = []


def letter(code: int, dimensions: int) -> np.ndarray:
    """The random vector of a code point; 0 stands for a gap."""
    if (code, dimensions) not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        drawn = np.random.default_rng([7, code]).integers(0, 2, dimensions, dtype=np.int8)
        _letters[code, dimensions] = drawn * 2 - 1
    return _letters[code, dimensions]


def _letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with 0 for what is no letter, one 0 in a row."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if not _kinds:
        _kinds.append(np.zeros(0x110000, np.int8))  # 0: not asked yet, 1: a letter, 2: none
    kinds = _kinds[0]
    present = np.flatnonzero(np.bincount(codes, minlength=1))
    for c in present[kinds[present] == 0].tolist():
        kinds[c] = 1 if chr(c).isalpha() else 2
    codes = np.where(kinds[codes] == 1, codes, 0).astype(np.int64)
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))] if len(codes) else codes


def _sums(texts: list[str], dimensions: int) -> np.ndarray:
    """The trigram sums of texts, one row each."""
    out = np.zeros((len(texts), dimensions), np.float32)
    codes, owner = [], []
    for i, text in enumerate(texts):
        own = _letters_of(text)
        if own.any():
            own = np.concatenate([[0] * int(own[0] != 0), own, [0] * int(own[-1] != 0)]).astype(np.int64)
            codes.append(own)
            owner.append(np.full(len(own), i))
    if not codes:
        return out
    codes, owner = np.concatenate(codes), np.concatenate(owner)
    alphabet, small = np.unique(codes, return_inverse=True)
    size = len(alphabet)
    if len(codes) < 3:
        return out
    trigram = (small[:-2] * size + small[1:-1]) * size + small[2:]
    whole = owner[:-2] == owner[2:]
    trigram, owner = trigram[whole], owner[:-2][whole]
    kinds, nth = np.unique(trigram, return_inverse=True)
    vectors = np.stack([letter(int(c), dimensions) for c in alphabet])
    first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for start in range(0, len(kinds), TRIGRAMS):
        part = kinds[start : start + TRIGRAMS]
        bound = first[part // (size * size)] * second[part // size % size] * vectors[part % size]
        inside = (nth >= start) & (nth < start + TRIGRAMS)
        counts = np.bincount(
            owner[inside] * len(part) + nth[inside] - start, minlength=len(texts) * len(part)
        ).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def profiles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of texts; zero for a text without a trigram."""
    out = np.zeros((len(texts), dimensions), np.float32)
    batch: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) > CHARACTERS:
            for a in range(0, len(text), CHARACTERS):
                out[i] += _sums([text[a : a + CHARACTERS]], dimensions)[0]
            continue
        batch.append(i)
        size += len(text)
        if size > CHARACTERS:
            out[batch] = _sums([texts[j] for j in batch], dimensions)
            batch, size = [], 0
    if batch:
        out[batch] = _sums([texts[j] for j in batch], dimensions)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def learn(
    docs: DataFrame,
    key: str,
    learn_from: Column,
    text: str = "text",
    language: str = "lang",
    per_language: int = PER_LANGUAGE,
    dimensions: int = DIMENSIONS,
) -> dict[str, np.ndarray]:
    """The prototype of each language, over the rows where ``learn_from`` holds."""
    usable = docs.filter(
        learn_from & F.col(key).isNotNull() & F.col(language).isNotNull() & F.col(text).isNotNull()
    )
    own = usable.select(F.col(language).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    # Of each language the distinct texts that hash lowest; tasks keep no more than these
    # before they are shuffled, as hashes alone.
    distinct = own.select("_lang", "_hash").distinct()
    least = F.row_number().over(W.partitionBy("_lang").orderBy("_hash"))
    first = distinct.withColumn("_nth", least).filter(F.col("_nth") <= per_language).drop("_nth")
    first = written(first, "learned-texts")
    # Texts of few languages, as nearly always, are found without a shuffle. A text that very
    # many rows share is combined before its shuffle.
    few = first.count() <= BROADCAST_ROWS
    chosen = own.join(F.broadcast(first) if few else first, ["_lang", "_hash"], "left_semi")
    chosen = chosen.groupBy("_lang", "_hash").agg(F.first("_text").alias("_text")).select("_lang", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch["_lang"].to_pylist()
            vectors = profiles(batch["_text"].to_pylist(), dimensions).astype(np.float64)
            for name, vector in zip(names, vectors):
                sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])],
                names=["_lang", "_sum"],
            )

    rows.ship(docs.sparkSession)
    found: dict[str, np.ndarray] = {}
    parts = chosen.mapInArrow(work, "_lang string, _sum array<double>").collect()
    for r in sorted(parts, key=lambda r: (r[0], r[1])):
        found[r[0]] = found.get(r[0], 0) + np.array(r[1])
    return {n: v / norm for n, v in sorted(found.items()) if (norm := np.linalg.norm(v)) > 0}


def identify(
    docs: DataFrame,
    prototypes: dict[str, np.ndarray],
    text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """The documents with ``lang_pred`` and its cosine (0 at least) as ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(prototypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        names = [*held.value, "und"]
        matrix = np.stack([*held.value.values()]).T.astype(np.float32) if held.value else None
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            if matrix is None:
                best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            else:
                vectors = profiles(texts, len(matrix))
                cosines = vectors @ matrix
                lettered = vectors.any(1)
                best = np.where(lettered, cosines.argmax(1), len(names) - 1)
                score = np.where(lettered, np.clip(cosines.max(1), 0, 1), 0)
            yield [
                pa.array([names[i] for i in best.tolist()], pa.string()),
                pa.array(score.astype(np.float64), pa.float64()),
            ]

    return rows.through_arrow(
        docs, {"text": F.col(text)}, work, "lang_pred string, score double", keep
    )
