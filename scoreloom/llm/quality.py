"""Quality rules whose cutoffs keep the risk of rejecting a good document bounded.

Base counts are taken of every text in its own row. The rules compare ratios of them with
cutoffs; a rule rejects above its cutoff. Cutoffs come from labelled documents, all of
them a holdout since the grid is fixed beforehand. The grid is a chain of settings, from loose
to strict, with one cutoff per rule each. For each stratum (band of length) and setting, the
distinct good texts ``n`` and the rejected ones among them ``k`` are counted, and the setting
holds if the exact binomial upper bound of the false rejection rate is below ``limit``, that
is if P(Binomial(n, limit) <= k) is at most ``alpha`` divided by the number of strata. Settings
are tested in their order until one fails, which needs no further correction; the last that
held is used, and where none does, for want of labels, no rule rejects. So with probability
1 - alpha, no stratum loses more than ``limit`` of its good documents.

All of it is column expressions, one join with the labels and one sum with a row per
stratum. Texts are not shuffled. Windows of five words are told apart by 64-bit hashes.

Defined cases: null, empty and blank texts have no words and fail the base rule; a null
key has no label; labels that disagree count as not good; a null quality is no label. Each
row gives one row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import rows

WINDOW = 5
#: Most good documents a stratum may lose, and the chance that it loses more.
LIMIT = 0.05
ALPHA = 0.05
#: Words at which the next stratum begins.
BANDS = (100, 300, 1000)
#: Cutoffs tried for each rule, fixed before any label is seen.
GRID = {
    "symbols": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "marks": (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "capitals": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeats": (0.19, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05, 0.03),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "word_chars": (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0),
}


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash stands more than once."""

    def covered(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda s, i: F.coalesce(F.get(ordered, i - 1)["h"] == s["h"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["h"] == s["h"], F.lit(False)),
        )
        places = F.array_sort(F.transform(again, lambda s: s["i"]))
        state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            state,
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n")
            ),
            lambda a: a["n"],
        )

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.transform(F.array(F.array_sort(pairs)), covered)[0]
    alone = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(alone, F.lit(0)).otherwise(some)


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with the base counts and ``features``, the ratio of each rule."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("words", rows.words(F.col("text")))
    word = lambda i: F.col("words")[i]
    window = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*(word(i + j) for j in range(WINDOW))),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    own = own.select(
        "key",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        _without(F.col("text"), r"[#*$%&|<>]").cast("bigint").alias("n_symbols"),
        _without(F.col("text"), r"[!?]").alias("_marks"),
        _without(F.col("text"), r"[A-Z]").alias("_capitals"),
        lines.alias("_lines"),
        F.when(F.size("words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        F.xxhash64("text").alias("text_hash"),
    )
    own = own.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    own = own.withColumn("n_repeat_words", _repeat_words(F.col("_h")).cast("bigint"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    features = {
        "symbols": F.col("n_symbols") / n,
        "marks": F.col("_marks") / n,
        "capitals": F.col("_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "word_chars": F.col("word_chars") / n,
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    band = sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))
    return own.select(
        "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        band.alias("stratum"),
        F.struct(*(v.alias(k) for k, v in features.items())).alias("features"),
        "text_hash",
    )


def log_at_most(k: Column, n: Column, rate: float) -> Column:
    """Logarithm of P(Binomial(n, rate) <= k), summed term by term in logarithms."""
    odds = math.log(rate) - math.log1p(-rate)

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(term, state["sum"]), F.least(term, state["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = n * math.log1p(-rate)
    steps = F.filter(F.sequence(F.lit(0), k.cast("int")), lambda j: j > 0)
    state = F.struct(first.alias("term"), first.alias("sum"))
    return F.aggregate(steps, state, add, lambda s: s["sum"])


def held_out(counted: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``stratum`` and ``features`` of each distinct text that is labelled good: copies of a text
    and rows that repeat one are no trials of their own."""
    good = labels.select(F.col(key).alias("key"), F.col(label).alias("good")).dropna()
    good = good.groupBy("key").agg(F.min("good").alias("good")).filter("good = 1").select("key")
    held = counted.filter("NOT base_failed").select("key", "stratum", "features", "text_hash").join(good, "key")
    return held.groupBy("stratum", "text_hash").agg(F.first("features").alias("features"))


def chained_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    limit: float = LIMIT,
    alpha: float = ALPHA,
    grid: dict[str, tuple[float, ...]] = GRID,
) -> DataFrame:
    """One row per stratum with labels: ``stratum`` and ``cutoff``, a struct with a cutoff for
    each rule, all null where not even the loosest setting holds.

    Setting ``i`` has the ``i``-th cutoff of every rule. What all its rules reject together is
    tested at the whole ``limit``, loosest setting first, and the first that fails ends the
    chain: its order is fixed beforehand, so each test may use the stratum's whole share of
    ``alpha``, and only the strata divide it.
    """
    settings = range(min(len(c) for c in grid.values()))
    held = held_out(counted, labels, key, label)

    def over(i: int) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"features.{r}") > c[i] for r, c in grid.items()])

    summed = held.groupBy("stratum").agg(
        F.count("*").alias("n"), *(F.sum(over(i).cast("bigint")).alias(f"t{i}") for i in settings)
    )
    n, level = F.col("n").cast("double"), math.log(alpha / (len(BANDS) + 1))

    def holds(i: int) -> Column:
        k = F.col(f"t{i}")
        possible = F.when(k <= n * limit, k).otherwise(0)
        return (k <= n * limit) & (log_at_most(possible, n, limit) <= level)

    last = F.lit(-1)
    for i in reversed(settings):  # settings before the first that fails
        last = F.when(~holds(i), i - 1).otherwise(F.lit(i) if i == settings[-1] else last)
    chosen = summed.select("stratum", last.alias("last"))
    at = [F.get(F.array(*(F.lit(x) for x in c)), F.col("last")).alias(r) for r, c in grid.items()]
    return chosen.select("stratum", F.struct(*at).alias("cutoff"))


def cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    label: str = "quality",
    limit: float = LIMIT,
    alpha: float = ALPHA,
    grid: dict[str, tuple[float, ...]] = GRID,
) -> DataFrame:
    """As :func:`chained_cutoffs`, but each rule has its own strictest cutoff, tested at its part
    of ``limit`` and of ``alpha``: fairer to single rules, and in want of far more labels."""
    held = held_out(counted, labels, key, label)
    tests = [(r, c) for r, cs in grid.items() for c in cs]
    rejected = [
        F.sum((F.col(f"features.{r}") > c).cast("bigint")).alias(f"t{i}") for i, (r, c) in enumerate(tests)
    ]
    summed = held.groupBy("stratum").agg(F.count("*").alias("n"), *rejected)
    share, level = limit / len(grid), math.log(alpha / (len(tests) * (len(BANDS) + 1)))
    n = F.col("n").cast("double")

    def holds(i: int) -> Column:
        k = F.col(f"t{i}")
        possible = F.when(k <= n * share, k).otherwise(0)
        return (k <= n * share) & (log_at_most(possible, n, share) <= level)

    def strictest(rule: str) -> Column:
        own = [F.when(holds(i), F.lit(c)) for i, (r, c) in enumerate(tests) if r == rule]
        return F.array_min(F.array(*own))

    return summed.select(
        "stratum", F.struct(*(strictest(r).alias(r) for r in grid)).alias("cutoff")
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: float = LIMIT,
    alpha: float = ALPHA,
    grid: dict[str, tuple[float, ...]] = GRID,
) -> DataFrame:
    """One row per document: ``key``, the base counts, ``base_failed``, ``rejected_by`` (the
    rules above their cutoff) and ``kept``."""
    counted = written(counts(docs, key, text), "quality")
    # One row per band of length, four at most.
    own = F.broadcast(chained_cutoffs(counted, labels, key, "quality", limit, alpha, grid))
    over = [
        F.when(F.col(f"features.{r}") > F.col(f"cutoff.{r}"), F.lit(r)) for r in grid
    ]
    rejected = F.filter(F.array(*over), lambda r: r.isNotNull())
    return counted.join(own, "stratum", "left").select(
        F.col("key").alias(key),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        rejected.alias("rejected_by"),
        (~F.col("base_failed") & (F.size(rejected) == 0)).alias("kept"),
    )
