"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word (ASCII and other letters and digits, lower-cased) is the bag of its character
n-grams, marked at both ends, each hashed to a row of an embedding table. A passage (a
stretch of ``PASSAGE`` words) is the average of its words, a word the average of its
n-grams; a linear softmax over the average gives the classes. Table and softmax are
trained together in numpy by gradient steps. A document is as toxic as its most toxic
passage: a few words among thousands would vanish in one average over all. Training
follows this: after a first round on all passages, only the most toxic passages of a
toxic document count as toxic. Two last parameters turn the highest logit into a
probability, set on the documents learned from.

Learned from at most ``max_rows`` labelled documents with a word of each class, the ones with
the smallest hash of their key, whole. A class has half of ``max_chars`` characters at least;
texts longer than ``1 / LONG`` of that half come after all others, and a text that doesn't fit
beside those before it is passed over. If none of a class fits, pieces spread over its shortest
text are learned from. They are chosen by key and length, and only then read. The table
(2 ** BITS rows) is sent to every task; since all is linear, only the difference of the
two classes per row is needed there. Documents are not shuffled, and each word is scored
once per task's memory.

Defined cases: null and empty texts have no words and get the score of the bias alone,
below one half; without labels of both classes every score is 0. A null key is held out
like the empty text and never learned from. A key with several labels is toxic if one
says so. Each row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rows

BITS = 17
WIDTH = 8
PASSAGE = 16
SIZES = (3, 4, 5, 6)
MAX_ROWS = 2500
MAX_CHARS = 12_000_000
LONG = 20
ROUNDS = 4
#: Passages of a gradient step; a round goes over its passages until it made so many steps.
BATCH, STEPS = 128, 300
#: Where one half lies in the gap between clean and toxic documents.
GAP = 0.4
#: Words whose score a task remembers, and words whose n-grams are taken at once.
REMEMBERED = 400_000
AT_ONCE = 20_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the n-grams of all words, and how many each word has (one at least)."""
    parts = [_grams(words[a : a + AT_ONCE]) for a in range(0, len(words), AT_ONCE)]
    return np.concatenate([r for r, _ in parts]), np.concatenate([n for _, n in parts])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>".encode() for w in words]
    lengths = np.array([len(m) for m in marked], np.int64)
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(text))
    found, of = [], []
    value = np.zeros(len(text), np.uint64)
    for size in range(1, max(SIZES) + 1):
        begin = place[place + size <= ends]
        value[begin] = value[begin] * np.uint64(1_000_003) + text[begin + size - 1] + np.uint64(size)
        if size in SIZES:
            mixed = value[begin] * np.uint64(0x9E3779B97F4A7C15)
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
            of.append(word[begin])
    rows_, of_ = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of_, kind="stable")
    return rows_[order], np.bincount(of_, minlength=len(words))


@dataclass
class Model:
    weights: np.ndarray  # of each table row: logit of toxic less that of clean
    bias: float
    slope: float
    shift: float


class Scorer:
    """Logits of words, remembered; the highest passage of a text."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def document(self, words: list[str]) -> float:
        if not words:
            return self.model.bias
        known = self.known
        values = list(map(known.get, words))
        if None in values:
            new = list({w for w, v in zip(words, values) if v is None})
            if len(known) > REMEMBERED:
                known.clear()
                new = list(set(words))
            rows_, counts = grams(new)
            sums = np.add.reduceat(self.model.weights[rows_], np.cumsum(counts) - counts)
            known.update(zip(new, (sums / counts).tolist()))
            values = list(map(known.get, words))
        return self.highest(words, np.array(values))

    def highest(self, words: list, values: np.ndarray) -> float:
        """Over all stretches of PASSAGE words, each begun half a stretch after the last. A
        word that stands again within a stretch counts once."""
        seen: dict = {}
        for i in np.flatnonzero(values > 0).tolist():
            if i - seen.get(words[i], -PASSAGE) < PASSAGE:
                values[i] = 0
            else:
                seen[words[i]] = i
        sums = np.append(0, np.cumsum(values))
        begin = np.arange(0, max(1, len(values) - PASSAGE // 2), PASSAGE // 2)
        end = np.minimum(begin + PASSAGE, len(values))
        return float(((sums[end] - sums[begin]) / PASSAGE).max()) + self.model.bias

    def probability(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit * self.model.slope + self.model.shift, -40, 40))))


def train(texts: list[str], toxic: list[bool], seed: int = 11) -> Model | None:
    """The model, or None unless both classes are there."""
    if len(set(toxic)) < 2:
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [
        np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32)
        for t in texts
    ]
    if not vocabulary:
        return None
    rows_, counts = grams(list(vocabulary))
    first = np.cumsum(counts) - counts
    passages, owner = [], []
    for d, own in enumerate(ids):
        for a in range(0, len(own), PASSAGE):
            passages.append(np.unique(own[a : a + PASSAGE]))
            owner.append(d)
    owner, label = np.array(owner), np.array(toxic, np.int64)
    table = rng.normal(0, 0.1, (1 << BITS, WIDTH))
    softmax = rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.zeros(2)
    squares = [np.full(table.shape, 1e-6), np.full(softmax.shape, 1e-6), np.full(2, 1e-6)]

    def batch_of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows, their weights and their passage, for the chosen passages."""
        words = np.concatenate([passages[i] for i in chosen])
        which = np.repeat(np.arange(len(chosen)), [len(passages[i]) for i in chosen])
        n = counts[words]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[words], n)
        return rows_[at], np.repeat(1 / (n * PASSAGE), n), np.repeat(which, n)

    def step(chosen: np.ndarray, rate: float) -> None:
        nonlocal bias
        r, w, p = batch_of(chosen)
        begin = np.searchsorted(p, np.arange(len(chosen)))
        mean = np.add.reduceat(table[r] * w[:, None], begin)
        logits = mean @ softmax + bias
        odds = np.exp(logits - logits.max(1, keepdims=True))
        error = odds / odds.sum(1, keepdims=True)
        error[np.arange(len(chosen)), label[owner[chosen]]] -= 1
        back = error @ softmax.T
        touched, nth = np.unique(r, return_inverse=True)
        slope = np.zeros((len(touched), WIDTH))
        for k in range(WIDTH):
            slope[:, k] = np.bincount(nth, back[p, k] * w, minlength=len(touched))
        squares[0][touched] += slope**2
        table[touched] -= rate * slope / np.sqrt(squares[0][touched])
        for value, change, square in ((softmax, mean.T @ error, squares[1]), (bias, error.sum(0), squares[2])):
            square += change**2
            value -= rate * change / np.sqrt(square)

    clean = np.flatnonzero(label[owner] == 0)
    positive = np.flatnonzero(label[owner] == 1)
    if not len(clean) or not len(positive):
        return None
    hardest = clean[:0]
    for turn in range(ROUNDS):
        # Clean passages, twice as many as toxic ones, drawn anew, and the hardest ones.
        drawn = np.append(rng.permutation(clean)[: max(4096, 2 * len(positive))], hardest)
        drawn = np.concatenate([positive, drawn])
        for _ in range(max(1, STEPS * BATCH // len(drawn))):
            chosen = rng.permutation(drawn)
            for a in range(0, len(chosen), BATCH):
                step(chosen[a : a + BATCH], 0.15 if turn < 2 else 0.08)
        weights = table @ (softmax[:, 1] - softmax[:, 0])
        word_logit = np.add.reduceat(weights[rows_], first) / counts
        logit = np.array([word_logit[own].sum() / PASSAGE for own in passages])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logit)
        hardest = clean[logit[clean] >= best[owner[clean]]]
        tox = np.flatnonzero(label[owner] == 1)
        logit = logit[tox]
        # From now on, the passages nearly as toxic as the most toxic one of their document.
        positive = tox[logit >= np.minimum(best[owner[tox]], np.maximum(best[owner[tox]] * 0.5, 0))]
    model = Model(weights, float(bias[1] - bias[0]), 1.0, 0.0)
    scorer = Scorer(model)
    highest = np.array(
        [scorer.highest(own.tolist(), word_logit[own]) if len(own) else model.bias for own in ids]
    )
    model.slope, model.shift = _calibrate(highest, label)
    return model


def _calibrate(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability. Where nearly all clean documents lie below nearly
    all toxic ones, one half lies in the gap, nearer to the clean: a document with one toxic
    word only is to be found. Else the logistic fit, by Newton steps with a little shrinkage."""
    low, high = np.quantile(logit[label == 0], 0.995), np.quantile(logit[label == 1], 0.05)
    if high > low:
        slope = 8 / (high - low)
        return float(slope), float(-slope * (low + GAP * (high - low)))
    scale = max(float(np.abs(logit).max()), 1e-9)
    x = np.stack([logit / scale, np.ones(len(logit))], 1)
    weight = np.where(label == 1, len(label) / (2 * label.sum()), len(label) / (2 * (1 - label).sum()))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        gradient = x.T @ (weight * (p - label)) + 1e-3 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(curve, gradient)
    return float(beta[0] / scale), float(beta[1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
) -> Model | None:
    """Fit on a bounded sample of labelled rows; ``learn_from`` is over the key ``_key``."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_toxic")).filter(
        F.col("_key").isNotNull() & F.col("_toxic").isNotNull()
    )
    known = known if learn_from is None else known.filter(learn_from)
    known = known.groupBy("_key").agg((F.max("_toxic") > 0).alias("_toxic")).hint("rebalance")
    given = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    some = given.filter(F.regexp_like("_text", F.lit(r"[\p{L}\p{N}]")))
    # Of a key with several texts, one of the shortest.
    sizes = some.select("_key", F.struct(F.length("_text").alias("n"), F.xxhash64("_text").alias("version")).alias("_is"))
    known = sizes.join(known, "_key").groupBy("_key", "_toxic").agg(F.min("_is").alias("_is"))
    known = known.select("_key", "_toxic", F.col("_is.n").alias("_n"), F.col("_is.version").alias("_version"))
    half = max_chars // 2
    order = [F.col("_n") > half // LONG, F.xxhash64("_key", F.lit(5)), F.col("_key")]
    parts = []
    for side in (True, False):  # no texts: max_rows small rows at most
        part = known.filter(F.col("_toxic") == side)
        drawn = part.orderBy(*order).limit(max_rows).collect()
        if not drawn:
            return None
        parts.append((part, drawn))
    needed = [sum(r["_n"] for r in drawn) for _, drawn in parts]
    wanted, cut = [], {}
    for (part, drawn), other in zip(parts, reversed(needed)):
        room, chosen = max(half, max_chars - other), []
        whole = room
        for r in drawn:
            if r["_n"] <= room:
                chosen.append(r)
                room -= r["_n"]
        if not chosen:
            chosen = part.orderBy("_n", *order[1:]).limit(1).collect()
            cut[chosen[0]["_key"]] = whole
        wanted += chosen
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in wanted], known.schema)
    found = given.join(F.broadcast(wanted), "_key").filter(F.xxhash64("_text") == F.col("_version"))
    for k, whole in cut.items():
        found = found.withColumn("_text", F.when(F.col("_key") == k, _spread(F.col("_text"), whole)).otherwise(F.col("_text")))
    sample = found.groupBy("_key", "_toxic").agg(F.min("_text").alias("_text")).collect()
    sample.sort(key=lambda r: r["_key"])
    return train([r["_text"] for r in sample], [r["_toxic"] for r in sample])


def _spread(text: Column, chars: int) -> Column:
    """Pieces of a text, evenly spread over it, of so many characters together."""
    n = max(1, chars // 1000)
    step = (F.length(text) / n).cast("int")
    return F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(text, i * step + 1, F.lit(chars // n))), " "
    )


def score(
    docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from one half on)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        scorer = Scorer(held.value) if held.value else None
        for batch in batches:
            found = [
                scorer.probability(scorer.document(words_of(t))) if scorer else 0.0
                for t in batch["text"].to_pylist()
            ]
            yield [
                pa.array(found, pa.float64()),
                pa.array([int(s >= 0.5) for s in found], pa.int32()),
            ]

    return rows.through_arrow(
        docs, {"text": text}, work, "score double, predicted int", keep
    )
