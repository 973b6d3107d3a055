"""Curation of a corpus: exact duplicates, the best of a cluster, counts, replay, licences,
categories.

Keys and hashes travel, texts do not. What is known per class or stratum is an aggregate,
combined before its shuffle, and set apart from the joins over its own key, so that adaptive
execution can split these where one class holds a large part of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markup import BLANK

#: Digits of a hash that number the buckets a bottom-k is first looked for in.
BUCKET_DIGITS = 4


def folded(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(text, BLANK + "+", " ")))


def exact_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per class of equal folded texts: ``class_hash``, ``keep_id`` (least key) and
    ``class_size``. A null text is in no class."""
    hashed = docs.select(key, F.md5(folded(F.col(text))).alias("class_hash"))
    return (
        hashed.where(F.col("class_hash").isNotNull())
        .groupBy("class_hash")
        .agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("class_size"))
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Membership: each row's ``key`` with its class and ``kept``, true for the least key.

    Rows without a text are kept and are in no class; rows that repeat a key and a text
    share the answer. A class is joined to its members as one row, whatever its size.
    """
    own = docs.select(key, F.md5(folded(F.col(text))).alias("class_hash"))
    classes = exact_classes(docs, key, text).hint("rebalance")
    found = own.join(classes, "class_hash", "left")
    kept = F.col("class_hash").isNull() | F.col(key).eqNullSafe(F.col("keep_id"))
    return found.select(key, "class_hash", "keep_id", "class_size", kept.alias("kept"))


def keep_best(
    docs: DataFrame, members: DataFrame, better: list[str], key: str = "doc_id", cluster: str = "cluster"
) -> DataFrame:
    """Of each cluster the row that has most of ``better`` (numbers, the first counts most, null
    least); ties go to the least key. Rows of ``docs`` in no cluster stay.

    ``members`` has ``key`` and ``cluster``; a null cluster is none. The choice is made from
    keys and numbers; whole rows are joined to what is not chosen, and never gathered.
    """
    ranks = [x for b in better for x in (F.col(b).isNull().alias(f"_no_{b}"), (-F.col(b)).alias(f"_{b}"))]
    narrow = docs.select(F.col(key).alias("_key"), *ranks)
    own = members.select(F.col(key).alias("_member"), F.col(cluster).alias("_cluster"))
    own = own.where(F.col("_cluster").isNotNull() & F.col("_member").isNotNull()).distinct()
    rated = own.join(narrow, F.col("_member") == F.col("_key"))
    place = F.struct(*(c for b in better for c in (f"_no_{b}", f"_{b}")), "_key")
    first = rated.groupBy("_cluster").agg(F.min(place)["_key"].alias("_best")).hint("rebalance")
    lost = own.join(first, "_cluster").where(F.col("_member") != F.col("_best")).select("_member").distinct()
    return docs.join(lost, F.col(key) == F.col("_member"), "left_anti")


def text_cells(docs: DataFrame, levels: list[str], text: str = "text") -> DataFrame:
    """One row per combination of ``levels``: exact counts, and sketches that can be merged.

    ``words_sketch`` (KLL) holds the distribution of words per document, ``texts_sketch``
    (HLL) the distinct folded texts. Null texts count as blank documents of no words.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(own, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = docs.select(*levels, words.alias("w"), F.length(own).cast("bigint").alias("c"), F.xxhash64(folded(own)).alias("h"))
    return rows.groupBy(*levels).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.when(F.col("w") == 0, 1).otherwise(0)).alias("blank"),
        F.sum("w").alias("words"),
        F.sum("c").alias("chars"),
        F.min("w").alias("fewest"),
        F.max("w").alias("most"),
        F.kll_sketch_agg_bigint("w").alias("words_sketch"),
        F.hll_sketch_agg("h", F.lit(14)).alias("texts_sketch"),
    )


def corpus_stats(docs: DataFrame, levels: list[str], text: str = "text", quantiles=(0.5, 0.9, 0.99)) -> DataFrame:
    """Counts for all combinations of ``levels``, for each level alone, and so on to the whole.

    ``level`` tells them apart: a bit per column, the first the highest, is set where the row is
    about all values of it. The table is read and grouped once, into cells; the cells, as many as
    combinations occur, are grouped by all sets. ``texts`` (distinct folded ones) is an estimate
    within about 1 %, ``words_p50`` and so on are quantiles within about 1 % of rank.
    """
    cells = text_cells(docs, levels, text)
    total = cells.cube(*levels).agg(
        F.grouping_id(*levels).alias("level"),
        *(F.sum(c).alias(c) for c in ("documents", "blank", "words", "chars")),
        F.min("fewest").alias("fewest"),
        F.max("most").alias("most"),
        F.kll_merge_agg_bigint("words_sketch").alias("_words"),
        F.hll_union_agg("texts_sketch").alias("_texts"),
    )
    named = [
        F.kll_sketch_get_quantile_bigint("_words", F.lit(float(q))).alias(f"words_p{round(100 * q)}") for q in quantiles
    ]
    return total.select(
        *levels, "level", "documents", "blank", "words", "chars", "fewest", "most",
        F.hll_sketch_estimate("_texts").alias("texts"), *named,
    )


def _number(key: Column) -> Column:
    """60 bits of the key's hash, the same in any run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def replay_sample(docs: DataFrame, rate: float, strata: list[str], key: str = "doc_id") -> DataFrame:
    """Of each stratum the ``ceil(rate * rows)`` rows whose keys hash lowest; nulls are a stratum.

    Reruns choose the same rows, and a higher rate keeps those of a lower one. Hashes are
    counted by stratum and bucket; sums over the buckets of a stratum, whose number is fixed,
    say which buckets are taken whole and how many rows the next gives. Only rows of these one
    bucket a stratum are ranked. Ties, rows that repeat a key, are taken by a hash of the row.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate is a share")
    own = docs.withColumn("_hash", _number(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    own = own.withColumn("_bucket", F.shiftright("_hash", 60 - 4 * BUCKET_DIGITS))
    counts = own.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*strata)
    order = by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    wanted = F.ceil(F.lit(rate).cast("decimal(20,10)") * F.sum("_n").over(by)).cast("bigint")
    edges = counts.withColumn("_wanted", wanted).where(
        (F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") >= F.col("_wanted"))
    )
    edges = edges.select(
        *(F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)),
        F.col("_bucket").alias("_edge"),
        (F.col("_wanted") - F.col("_before")).alias("_left"),
    ).hint("rebalance")
    same = F.lit(True)
    for i, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    near = own.join(edges, same)
    whole = near.where(F.col("_bucket") < F.col("_edge"))
    hashable = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rank = F.row_number().over(by.orderBy("_hash", F.xxhash64(*hashable)))
    some = near.where(F.col("_bucket") == F.col("_edge")).withColumn("_rank", rank)
    some = some.where(F.col("_rank") <= F.col("_left")).drop("_rank")
    return whole.unionByName(some).select(*docs.columns)


def replay_mix(domain: DataFrame, general: DataFrame, rate: float, strata: list[str], key: str = "doc_id") -> DataFrame:
    """The domain's rows, and a share of each stratum of the general ones, by ``origin``."""
    replay = replay_sample(general, rate, strata, key)
    return domain.withColumn("origin", F.lit("domain")).unionByName(replay.withColumn("origin", F.lit("replay")))


#: Licence ids and their wordings, as patterns that need no look around.
LICENCES = {
    "apache-2.0": r"apache license,? version 2(?:\.0)?",
    "cc-by-nc": r"cc[ -]by-nc(?:-(?:sa|nd))?(?: [0-9]\.[0-9])?",
    "cc-by-sa": r"cc[ -]by-sa(?: [0-9]\.[0-9])?",
    "cc-by": r"cc[ -]by(?: [0-9]\.[0-9])?",
    "cc0": r"cc0|public domain dedication",
    "gpl": r"gnu (?:lesser |affero )?general public license",
    "mit": r"mit license",
    "bsd": r"bsd (?:[234]-clause )?license",
    "mpl-2.0": r"mozilla public license",
    "reserved": r"all rights reserved",
    "terms": r"terms of (?:service|use)",
}


def licence_scan(docs: DataFrame, text: str = "text", licences: dict[str, str] | None = None) -> DataFrame:
    """Add ``licences``, the ids whose wording occurs, in the order of their first place, and
    ``n_notices``.

    All wordings are one pattern with a group each, so a text is read once; what it finds is
    short, and only that is told apart, by the first wording that matches it whole. Where
    wordings overlap the one that begins first counts, then the one listed first.
    """
    listed = LICENCES if licences is None else licences
    # White space between words of a notice may be any.
    spaced = {i: p.replace(" ", r"[\x20\x09-\x0D]+") if "[ -]" not in p else p for i, p in listed.items()}
    every = "(?i)(?:\\A|[^A-Za-z0-9])(" + "|".join(f"(?:{p})" for p in spaced.values()) + ")(?:\\z|[^A-Za-z0-9])"

    def named(notice: Column) -> Column:
        out = F.lit(None).cast("string")
        for i, p in reversed(spaced.items()):
            out = F.when(F.regexp_like(notice, F.lit(rf"(?i)\A(?:{p})\z")), F.lit(i)).otherwise(out)
        return out

    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(every), F.lit(1))
    df = docs.withColumn("_notices", F.transform(found, named))
    return df.withColumns(
        {"licences": F.array_distinct("_notices"), "n_notices": F.size("_notices").cast("bigint")}
    ).drop("_notices")


def licences_by_source(scanned: DataFrame, source: str = "source") -> DataFrame:
    """Documents per source and licence, per source, and in all (``level`` 0, 1, 3); ``none``
    where a document has no notice. A document with several licences counts for each, and
    once in the totals."""
    listed = F.when(F.size("licences") > 0, F.col("licences")).otherwise(F.array(F.lit("none")))
    # A document is counted in a total at its first licence.
    rows = scanned.select(source, F.posexplode(listed).alias("_at", "licence"), "n_notices")
    first = F.when(F.col("_at") == 0, 1).otherwise(0)
    cells = rows.groupBy(source, "licence").agg(
        F.count(F.lit(1)).alias("each"), F.sum(first).alias("once"),
        F.sum(F.when(F.col("_at") == 0, F.col("n_notices")).otherwise(0)).alias("notices"),
    )
    return cells.rollup(source, "licence").agg(
        F.grouping_id(source, "licence").alias("level"),
        F.when(F.grouping_id(source, "licence") == 0, F.sum("each")).otherwise(F.sum("once")).alias("documents"),
        F.sum("notices").alias("notices"),
    )


def seed_categories(
    docs: DataFrame, seeds: DataFrame, source: str = "source", text: str = "text"
) -> DataFrame:
    """Documents and words per category, kind and both, by ``cube``.

    ``seeds`` maps prefixes of sources to categories, many to many (``prefix``, ``category``,
    ``kind``); it is a list kept by hand. Documents are first counted per source, so the join by
    prefix meets one row per source, and texts are read once. A source under several prefixes
    of a category counts once for it; one under none is in category ``none``.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    sizes = docs.select(F.col(source).alias("source"), words.alias("w")).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("w").alias("words")
    )
    named = sizes.join(seeds, F.startswith("source", "prefix"), "left")
    cells = named.select(
        "source", "documents", "words",
        F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("kind", F.lit("none")).alias("kind"),
    ).distinct()
    return cells.cube("category", "kind").agg(
        F.grouping_id("category", "kind").alias("level"),
        F.count_distinct("source").alias("sources"),
        F.sum("documents").alias("documents"),
        F.sum("words").alias("words"),
    )
