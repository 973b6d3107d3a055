"""Personal data: base patterns, and identifiers found by the contexts of known ones.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Looser
forms of each (a card number whose check digit is wrong, a phone number without its plus,
an address written with "at") are candidates only. Each candidate is an instance with up
to three lexical patterns around it: the word before, the two words before, the word
after. Base matches are the seeds. In each turn a pattern's score is the share of its
distinct instances that are trusted (one more counted as not), for patterns with at least
``support`` trusted instances, and an untrusted instance takes the best score of its
patterns. After ``turns`` turns, instances of at least ``confidence`` are added where they
touch no base match. What a base match of another kind covers is never trusted.

All of it is column expressions, joins and sums. The graph has one edge per pattern and
distinct instance, so copies of a document add nothing; patterns are summed before they
are shuffled, and the joins are plain ones that adaptive execution splits where a pattern
is frequent.

Defined cases: a null text is empty and has no spans. Rows with the same key and text are
one document to the graph; each gives one row. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import spans

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENCE = 0.75
TURNS = 3

#: The contract's patterns, written so that no start in a run is tried twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What only a context can tell from other text.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:\x20?\.\x20?[0-9]++){3}+(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]?+[0-9][\x20().0-9/-]{5,20}[0-9](?![0-9A-Za-z])",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + doubled(i)
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), passes_luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid base matches by kind as listed, then start."""

    def of(kind: str) -> Column:
        found = F.filter(spans.matches(text, BASE[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(
            found,
            lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
        )

    return F.concat(*(of(kind) for kind in KINDS))


def _plausible(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    return {"card": n.between(12, 19), "phone": n.between(7, 15)}.get(kind, F.lit(True))


def _word(text: Column, pattern: str) -> Column:
    return F.lower(F.regexp_extract(text, pattern, 1))


def _patterns(s: Column) -> Column:
    """The lexical patterns around a candidate; a side without a word gives none."""
    one = _word(s["left"], r"(\p{L}+)[^\p{L}]*\z")
    two = _word(s["left"], r"(\p{L}+[^\p{L}]+\p{L}+)[^\p{L}]*\z")
    after = _word(s["right"], r"\A[^\p{L}]*(\p{L}+)")
    two = F.regexp_replace(two, r"[^\p{L}]+", " ")
    made = F.array(
        F.when(one != "", F.concat(F.lit("< "), one)),
        F.when(two != "", F.concat(F.lit("<< "), two)),
        F.when(after != "", F.concat(F.lit("> "), after)),
    )
    return F.filter(made, lambda p: p.isNotNull())


def candidates(text: Column) -> Column:
    """Loose matches with their instance and patterns."""

    def of(kind: str) -> Column:
        found = F.filter(
            spans.matches(text, LOOSE[kind], context=True), lambda s: _plausible(kind, s["value"])
        )
        instance = F.lower if kind == "email" else _digits
        return F.transform(
            found,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                instance(s["value"]).alias("instance"),
                _patterns(s).alias("patterns"),
            ),
        )

    return F.concat(*(of(kind) for kind in KINDS))


def score_instances(
    edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, turns: int = TURNS
) -> DataFrame:
    """Trusted instances of a pattern-instance graph: ``kind``, ``instance``.

    ``edges`` has ``kind``, ``pattern``, ``instance`` once each, and ``state``: 1 for a seed,
    -1 for what is known to be something else, 0 for the open ones.
    """
    key = ["kind", "instance"]
    trust = F.when(F.col("state") == 1, 1.0).otherwise(0.0)
    known = edges.withColumn("trust", trust)
    for turn in range(turns):
        pattern = known.groupBy("kind", "pattern").agg(
            F.sum("trust").alias("trusted"), F.count("*").alias("n")
        )
        pattern = pattern.filter(F.col("trusted") >= support).select(
            "kind", "pattern", (F.col("trusted") / (F.col("n") + 1)).alias("score")
        )
        # Apart from its aggregate, so that the join can be split where a pattern is frequent.
        pattern = pattern.hint("rebalance")
        open_ = edges.filter("state = 0").select("kind", "pattern", "instance")
        best = open_.join(pattern, ["kind", "pattern"]).groupBy(*key).agg(F.max("score").alias("best"))
        if turn == turns - 1:
            return best.filter(F.col("best") >= confidence).select(*key)
        known = edges.join(best.hint("rebalance"), key, "left").withColumn(
            "trust", F.when(F.col("state") == 0, F.coalesce("best", F.lit(0.0))).otherwise(trust)
        )
    raise ValueError("at least one turn")


def find_personal_data(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    support: int = SUPPORT,
    confidence: float = CONFIDENCE,
    turns: int = TURNS,
) -> DataFrame:
    """One row per document: ``key``, ``base`` and ``added`` spans (kind, start, end)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = written(
        docs.select(
            F.col(key).alias("key"),
            F.xxhash64(whole).alias("version"),
            base_spans(whole).alias("base"),
            candidates(whole).alias("loose"),
        ),
        "personal-data",
    )
    touching = F.filter("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    same = F.exists("touching", lambda b: b["kind"] == F.col("kind"))
    state = F.when(same, 1).when(F.size("touching") > 0, -1).otherwise(0)
    # Only documents with a candidate go on; a document's own base spans are looked through.
    loose = (
        found.filter(F.size("loose") > 0)
        .select("key", "version", "base", F.explode("loose").alias("c"))
        .withColumn("touching", touching)
        .select("key", "version", "c.*", "touching")
        .select("key", "version", "kind", "start", "end", "instance", "patterns", state.alias("state"))
    )
    edges = (
        loose.select("kind", "instance", "state", F.explode("patterns").alias("pattern"))
        .groupBy("kind", "pattern", "instance")
        .agg(F.max("state").alias("best"), F.min("state").alias("worst"))
        .select(
            "kind", "pattern", "instance",
            F.when(F.col("best") == 1, 1).otherwise(F.col("worst")).alias("state"),
        )
    )
    edges = written(edges, "pattern-graph")
    trusted = score_instances(edges, support, confidence, turns)
    open_ = loose.filter("state = 0").select("key", "version", "kind", "start", "end", "instance")
    span = F.struct("kind", "start", "end")
    added = (
        open_.join(trusted.hint("rebalance"), ["kind", "instance"], "left_semi")
        .groupBy(F.col("key").alias("_key"), F.col("version").alias("_version"))
        .agg(F.collect_set(span).alias("added"))
    )
    same_row = F.col("key").eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_version"))
    none = F.filter("base", lambda _: F.lit(False))
    return found.join(added, same_row, "left").select(
        F.col("key").alias(key), "base", F.coalesce("added", none).alias("added")
    )


def in_order(found: Column) -> Column:
    """By kind as listed, then start."""
    return F.concat(*(F.array_sort(spans.of_kind(found, kind)) for kind in KINDS))


def digest(found: DataFrame) -> DataFrame:
    count = {k: F.size(spans.of_kind(F.col("base"), k)).cast("bigint") for k in KINDS}
    return found.select(
        "doc_id",
        *(n.alias(f"n_{k}") for k, n in count.items()),
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(in_order(F.concat("base", "added"))).alias("spans"),
    )
