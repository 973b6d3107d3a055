"""Line dedup: content-defined chunks of words and words that stand elsewhere already are removed.

Passages begin and end at any word, so what is looked for are seeds of two kinds:

* chunks of ``WORDS`` words that open where the content says: a dip is a word whose hash is not
  above those beside it, and a chunk opens at a dip whose hash is not above those of the dips
  beside it, one word in nine on average. So a passage holds a whole chunk that is the same
  whatever stands around it: one of 51 words lacks one with a chance of about 3e-6, one of 35
  words 0.6 %, one of 30 words 4 % and one of 25 words 18 % at most (simulated);
* words of ``WIDE`` bytes with the next word, or alone from ``ALONE`` bytes on: addresses, and
  scripts without blanks.

Of documents with the same text (by SHA-256) the first has seeds and stands for the others,
which are one passage that stands there. Seeds are shuffled once, by their hash. A seed whose hash
occurs more than once is repeated; its first occurrence (by key, then place) stays. A seed that
overlaps or touches an equal one before it, as where a few words are said again and again, stands
there, at that distance, and not at the first place: so all of such a stretch is one run.
Repeated seeds with the same earlier document and distance that overlap or touch form a run. Its words are compared with those there by SHA-256, and it is extended word by
word on both sides until they differ, ``REACH`` words at most (a passage that goes on is long
enough by then). Stretches that continue each other in the same earlier document are one
passage, and it is removed, with the white space after each word, if it has ``MIN_BYTES`` bytes
or ``MIN_WORDS`` words by itself: short phrases that stand in several earlier documents stay,
also where they follow each other. White space between words is not compared. What is removed
equals words at an earlier place, so the first copy of any passage stays.

All of it is column expressions, joins, aggregates and windows, by document or by seed. The
places of a seed meet in one window, some 40 bytes each; a document has a seed there once unless
it says it again at a distance. Whole texts are shuffled only of documents that hold a run, a first
occurrence of one, or words to remove: a bitmap of their hashes, which goes to every task, tells
nearly all others apart, and an exact join decides. Joins by first occurrence are plain ones, which
adaptive execution splits where a passage is in very many documents; a document's words are never
grouped with another's.

Defined cases: a null text stays null and an empty one empty; rows with the same key and
text are one document and lose the same words; a null key comes first. A document may be
left with an empty text. Each row gives one row. ``n_removed`` counts lines as they are written:
up to a line feed or the end of a sentence (``.``, ``!`` or ``?`` and a space, with ``SENTENCE``
other characters before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.session import written

from . import rows

#: Bytes, or words, that are worth removing together: 150 bytes are about 25 words.
MIN_BYTES, MIN_WORDS = 150, 50
#: Words of a chunk.
WORDS = 13
#: A word of so many bytes is a seed together with the next one, and of ALONE bytes by itself.
WIDE, ALONE = 25, 75
#: Words that are compared on each side of a run. A passage may have seeds that stand in a still
#: earlier document too; with so many words it is found whole by any seed that does not.
REACH = MIN_WORDS
#: Elements of lists that may be sent to every task together, about 2 MB.
BROADCAST_ELEMENTS = 50_000
#: Bits for each document that a bitmap holds, and the most words of 64 bits that it has, about 12 MB.
BITS_EACH, MOST_SLOTS = 16, 1 << 18
#: Seeds before a seed among which an equal one is looked for: one for each word of a chunk.
BEHIND = WORDS

#: A sentence that ends a line has so many characters at least since the one before.
SENTENCE = 16
_END = (
    r"(?<=[\n\x20])(?:(?<=\n)(?=[^\n])"
    rf"|(?<=[.!?]\x20)(?=[^\x20\n])(?<=[^.!?\n]{{{SENTENCE}}}[.!?]\x20))"
)
_MOST = (1 << 63) - 1
_BLANK = " \t\n\x0b\f\r"
_WORD_END = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"


def pieces(text: Column) -> Column:
    """The lines of a text with all their white space; together they are the text."""
    return F.split(text, _END, -1)


def lines(text: Column) -> Column:
    return F.transform(pieces(text), lambda p: F.btrim(p, F.lit(_BLANK)))


def _words(trimmed: Column) -> Column:
    """The words of a line or text without white space around it."""
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, rows.SPACES, -1))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, n: a + n)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an array of one element stands for "let"."""
    return F.transform(F.array(value), body)[0]


def _dips(hashes: Column, last: Column | None = None) -> Column:
    """The places, up to the ``last`` one if it is given, whose hash is not above those beside it: all
    places of a stretch that says one word only."""
    none = F.array(F.lit(_MOST))

    def of(between: Column) -> Column:
        def is_dip(x: Column, i: Column) -> Column:
            if last is None:
                return (x <= F.get(between, i)) & (x <= F.get(between, i + 2))
            return (x <= F.get(between, i)) & ((x <= F.get(between, i + 2)) | (i == last)) & (i <= last)

        # One pass and a plain function after it: a filter would look up each word once more.
        return F.array_remove(F.transform(hashes, lambda x, i: F.when(is_dip(x, i), i).otherwise(-1)), -1)

    return _let(F.concat(none, hashes, none), of)


def _chunks(words: Column) -> Column:
    """Chunks of ``WORDS`` words; a text of fewer is one by itself."""

    def chunk(hashes: Column, n: Column, start: Column) -> Column:
        # Of the words' hashes one by one, for a slice costs more; a place after the last word adds nothing.
        own = (F.get(hashes, start + k) for k in range(WORDS))
        return F.struct(
            start.alias("start"),
            n.alias("n"),
            F.xxhash64(*own).alias("hash"),
            F.lit(None).cast("int").alias("apart"),
        )

    def of(hashes: Column, n: Column) -> Column:
        at = lambda values, places: F.transform(places, lambda i: F.get(values, i))
        dips = _let(F.size(hashes) - n, lambda last: _dips(hashes, last))
        opens = _let(dips, lambda d: at(d, _let(at(hashes, d), lambda h: _dips(h))))
        return F.transform(opens, lambda start: chunk(hashes, n, start))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: _let(F.least(F.size(h), F.lit(WORDS)), lambda n: of(h, n)))


def _wide(words: Column) -> Column:
    """Words of ``WIDE`` bytes, each with the next one unless it has ``ALONE``."""

    def one(i: Column) -> Column:
        alone = (F.octet_length(F.get(words, i)) >= ALONE) | (i == F.size(words) - 1)
        return F.struct(
            i.alias("start"),
            F.when(alone, 1).otherwise(2).alias("n"),
            F.xxhash64(F.get(words, i), F.when(~alone, F.get(words, i + 1))).alias("hash"),
            F.lit(None).cast("int").alias("apart"),
        )

    is_wide = lambda i: F.octet_length(F.get(words, i)) >= WIDE
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), is_wide), one)


def seeds(docs: DataFrame, text: str) -> DataFrame:
    """For each document its ``seeds`` by place: ``start`` (word), ``n`` (words), ``hash``, and how far
    it is ``apart`` from an equal one that it overlaps or touches, if there is one before it."""

    def of(words: Column) -> Column:
        has_wide = F.exists(words, lambda w: F.octet_length(w) >= WIDE)
        return _let(_chunks(words), lambda c: F.when(has_wide, F.array_sort(F.concat(c, _wide(words)))).otherwise(c))

    own = docs.filter(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")))
    split = F.split(F.btrim(F.col(text), F.lit(_BLANK)), rows.SPACES, -1)
    found = own.select("id", "version", _let(split, of).alias("seeds"))

    def apart(back: Column):
        """``back``: the hashes, last one first."""

        def of(x: Column, i: Column) -> Column:
            behind = F.slice(back, F.size(back) - i + 1, F.lit(BEHIND))
            by = x["start"] - F.get(F.col("seeds"), i - F.array_position(behind, x["hash"]).cast("int"))["start"]
            return x.withField("apart", _let(by, lambda n: F.when((n > 0) & (n <= x["n"]), n)))

        return of

    again = F.size(F.array_distinct("seeds.hash")) < F.size("seeds")
    told = _let(F.reverse("seeds.hash"), lambda back: F.transform("seeds", apart(back)))
    return found.select("id", "version", F.when(again, told).otherwise(F.col("seeds")).alias("seeds"))


def _is_in(id_: str = "_id", version: str = "_version") -> Column:
    return F.col("id").eqNullSafe(F.col(id_)) & (F.col("version") == F.col(version))


def _parted(docs: DataFrame, some: DataFrame, lists: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``some`` (rows with ``_id`` and ``_version``, and lists) to be joined, the documents that may be
    among them, and those that are not. A few are sent to every task; else a bitmap of their hashes is."""
    some = written(some, "line-list")
    size = F.lit(1) if lists is None else F.coalesce(F.size(lists), F.lit(0)) + 1
    n, elements = some.agg(F.count("*"), F.sum(size)).first()
    if (elements or 0) <= BROADCAST_ELEMENTS:
        return F.broadcast(some), docs, None
    slots = 1 << max(0, (min(MOST_SLOTS, n * BITS_EACH // 64) - 1).bit_length())
    at = lambda id_, version: F.pmod(F.xxhash64(id_, version), F.lit(64 * slots))
    bit = F.col("_at").bitwiseAND(F.lit(63)).cast("int")
    bits = some.select(at("_id", "_version").alias("_at"))
    bits = bits.groupBy(F.shiftright("_at", 6).alias("_slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("_bits")
    )
    bits = F.broadcast(written(bits, "line-bits"))
    told = docs.withColumn("_at", at("id", "version")).withColumn("_slot", F.shiftright("_at", 6))
    told = told.join(bits, "_slot", "left").withColumn("_may", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)))
    return some, told.filter("_may").select(*docs.columns), told.filter("NOT _may").select(*docs.columns)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """The ``id``, ``version`` and SHA-256 (``same``) of the documents, and how many ``times`` each is there."""
    same = F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("same")
    own = docs.select("id", "version", same).groupBy("id", "version", "same").agg(F.count("*").alias("times"))
    return written(own, "line-texts")


def copies(own: DataFrame) -> DataFrame:
    """``id`` and ``version`` of the documents whose text, by SHA-256, an earlier document has."""
    own = own.drop("times")
    first = own.groupBy("same").agg(F.min(F.struct("id")).alias("k"), F.count("*").alias("times"))
    first = first.filter("times > 1").drop("times").hint("rebalance")
    return own.join(first, "same").filter(~F.col("id").eqNullSafe(F.col("k.id"))).select("id", "version")


def _not_in(docs: DataFrame, some: DataFrame) -> DataFrame:
    some, may, rest = _parted(docs, some.select(F.col("id").alias("_id"), F.col("version").alias("_version")))
    left = may.join(some, _is_in(), "left_anti")
    return left if rest is None else left.unionByName(rest)


def repeated_runs(found: DataFrame) -> DataFrame:
    """Runs of repeated seeds that are not the first: ``n`` words from word ``start`` of ``id``
    and ``version``, and from ``k_start`` of ``k_id`` and ``k_version``, where they stood before.
    Seeds with the same earlier document and distance that overlap or touch are one run. Words
    to compare on each side of it are ``reach``."""
    # Not "inline": it would make the seeds a second time, to see whether there are any.
    places = found.select("id", "version", F.inline_outer("seeds")).filter("hash IS NOT NULL")
    # What stands near an equal one is only carried along, by itself.
    own = F.xxhash64("id", "version", "start", F.lit(1))
    places = places.withColumn("hash", F.when(F.col("apart").isNull(), F.col("hash")).otherwise(own))
    by = W.partitionBy("hash", F.col("apart").isNull()).orderBy("id", "version", "start")
    first = lambda c: F.first(c).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    places = places.select(
        "id", "version", "start", "n", "apart", *(first(c).alias(f"k_{c}") for c in ("id", "version", "start"))
    )
    other = ~(_is_in("k_id", "k_version") & (F.col("start") == F.col("k_start")))
    near = F.col("apart").isNotNull()
    met = places.filter(near | other).select(
        "id", "version", "start", (F.col("start") + F.col("n")).alias("end"),
        F.when(near, F.col("id")).otherwise(F.col("k_id")).alias("k_id"),
        F.when(near, F.col("version")).otherwise(F.col("k_version")).alias("k_version"),
        F.coalesce("apart", F.col("start") - F.col("k_start")).alias("apart"),
    )
    line = ["id", "version", "k_id", "k_version", "apart"]
    order = W.partitionBy(*line).orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    met = met.withColumn("new", F.coalesce(F.col("start") > so_far, F.lit(True)).cast("int"))
    met = met.withColumn("run", F.sum("new").over(order))
    runs = met.groupBy(*line, "run").agg(
        F.min("start").alias("start"),
        (F.max("end") - F.min("start")).alias("n"),
        F.lit(REACH).alias("reach"),
    )
    return runs.select(
        "id", "version", "start", "n", "reach",
        "k_id", "k_version", (F.col("start") - F.col("apart")).alias("k_start"),
    )


def _with_words(places: DataFrame, docs: DataFrame, text: str, names: list[str], side: str) -> DataFrame:
    """Places (``id``, ``version``, ``start``, ``n``, ``reach`` and more columns ``names``) with the
    SHA-256 of the words there, and the words before (last one first) and after them."""
    own = places.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_list(F.struct("start", "n", "reach", *names)).alias("places")
    )
    own, may, _ = _parted(docs.select("id", "version", text), own, "places")
    one = may.join(own, _is_in())
    one = one.withColumn("words", _words(F.btrim(F.col(text), F.lit(_BLANK))))

    def at(words: Column, p: Column) -> Column:
        start, n = p["start"], p["n"]
        back = F.least(start, p["reach"])
        joined = lambda found: F.array_join(found, " ")
        return F.struct(
            start.alias("start"),
            n.alias("n"),
            p["reach"].alias("reach"),
            *(p[x].alias(x) for x in names),
            F.unhex(F.sha2(joined(F.slice(words, start + 1, n)), 256)).alias(f"{side}_core"),
            joined(F.reverse(F.slice(words, start - back + 1, back))).alias(f"{side}_before"),
            joined(F.slice(words, start + n + 1, p["reach"])).alias(f"{side}_after"),
        )

    # The words are split once, not per place.
    found = _let(F.col("words"), lambda w: F.transform("places", lambda p: at(w, p)))
    return one.select("id", "version", F.inline(found))


def _equal_ahead(a: str, b: str) -> Column:
    """How many words two texts, with one blank between words, share from their start."""
    words = lambda x: F.when(F.col(x) != "", F.split(x, " ", -1)).otherwise(F.array().cast("array<string>"))
    differs = F.zip_with(words(a), words(b), lambda x, y: F.coalesce(x == y, F.lit(False)))

    def of(equal: Column) -> Column:
        first = F.array_position(equal, F.lit(False))
        return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")

    # Mostly they are the same, or the first words differ.
    first = lambda x: F.substring_index(F.col(x), " ", 1)
    return (
        F.when(F.col(a) == F.col(b), F.size(words(a)))
        .when(first(a) != first(b), 0)
        .otherwise(_let(differs, of))
    )


def removable(docs: DataFrame, text: str) -> DataFrame:
    """``id``, ``version`` and the stretches of words (``a`` to ``b``, in order) that stand
    in an earlier place as one, or ``gone`` is null where the whole text stands in an earlier
    document. ``docs`` has ``id``, ``version`` and the text."""
    own = _texts(docs, text)
    whole = written(copies(own), "line-copies")
    found = seeds(_not_in(docs, whole), text)
    # Rows with the same key and text are one document.
    if not own.filter("times > 1").isEmpty():
        found = found.dropDuplicates(["id", "version"])
    runs = written(repeated_runs(found), "line-runs")
    here = _with_words(runs, docs, text, ["k_id", "k_version", "k_start"], "d")
    first = runs.select(
        F.col("k_id").alias("id"), F.col("k_version").alias("version"), F.col("k_start").alias("start"), "n", "reach"
    ).distinct()
    # Rows with the same key and text are one document.
    there = _with_words(first, docs, text, [], "k").dropDuplicates(["id", "version", "start", "n", "reach"])
    there = there.select(
        F.col("id").alias("o_id"), F.col("version").alias("o_version"), F.col("start").alias("o_start"),
        F.col("n").alias("o_n"), F.col("reach").alias("o_reach"), "k_core", "k_before", "k_after",
    ).hint("rebalance")
    same = (
        F.col("k_id").eqNullSafe(F.col("o_id"))
        & (F.col("k_version") == F.col("o_version"))
        & (F.col("k_start") == F.col("o_start"))
        & (F.col("n") == F.col("o_n"))
        & (F.col("reach") == F.col("o_reach"))
    )
    met = here.join(there, same).filter(F.col("d_core") == F.col("k_core"))
    ahead, behind = _equal_ahead("d_before", "k_before"), _equal_ahead("d_after", "k_after")
    met = met.select(
        "id", "version", "k_id", "k_version", (F.col("start") - F.col("k_start")).alias("apart"),
        (F.col("start") - ahead).alias("a"), (F.col("start") + F.col("n") - 1 + behind).alias("b"),
    )
    # Stretches grow together only if they continue each other in one earlier document.
    line = ["id", "version", "k_id", "k_version", "apart"]
    met = met.groupBy(*line, "a").agg(F.max("b").alias("b"))
    order = W.partitionBy(*line).orderBy("a")
    so_far = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    met = met.withColumn("new", F.coalesce(F.col("a") > so_far + 1, F.lit(True)).cast("int"))
    met = met.withColumn("nth", F.sum("new").over(order))
    passages = met.groupBy(*line, "nth").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    gone = passages.groupBy("id", "version").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone"))
    return gone.unionByName(whole, allowMissingColumns=True)


def remove_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the words that stand at an earlier place removed from ``text``, and
    ``n_removed``, the number of lines from which words were removed."""
    own = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("version"),
        F.col(text).alias("text"),
        F.struct(*(c for c in docs.columns if c != text)).alias("row"),
    )
    gone = removable(own.select("id", "version", "text").filter("text IS NOT NULL"), "text").select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), "gone"
    )
    gone, may, rest = _parted(own, gone, "gone")
    found = may.join(gone, _is_in(), "left")
    cut = F.when(F.col("gone").isNotNull(), _without("text", "gone"))
    cut = cut.when(F.col("_version").isNotNull(), _emptied(F.col("text")))
    found = found.select("text", "row", cut.alias("cut"))
    if rest is not None:
        found = found.unionByName(rest.select("text", "row"), allowMissingColumns=True)
    made = {text: F.coalesce("cut.text", "text"), "n_removed": F.coalesce("cut.n_removed", F.lit(0))}
    names = dict.fromkeys([*docs.columns, "n_removed"])
    return found.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in names))


def _emptied(text: Column) -> Column:
    """What ``_without`` gives where all words go: null for a text too short to be removed."""
    # The last of so many words has all the text after it.
    words = F.split(F.btrim(text, F.lit(_BLANK)), rows.SPACES, MIN_WORDS)
    size = lambda w: (F.size(w) >= MIN_WORDS) | (F.octet_length(F.array_join(w, " ")) + 1 > MIN_BYTES)
    long = _let(words, size)
    n_lines = F.size(F.filter(lines(text), lambda x: x != ""))
    return F.when(long, F.struct(F.lit("").alias("text"), n_lines.alias("n_removed")))


def _without(text: str, gone: str) -> Column:
    """``text`` without the stretches of words that are worth it, and ``n_removed``; null where none
    is. White space goes with the word before it, and with the first word what stands before."""

    def part(given: Column, x: Column) -> Column:
        return F.slice(given["words"], x["a"] + 1, x["b"] - x["a"] + 1)

    def worth(given: Column) -> Column:
        size = lambda x: _total(
            F.transform(part(given, x), lambda w: F.octet_length(F.rtrim(w, F.lit(_BLANK))) + 1)
        )
        long = F.filter(
            F.col(gone), lambda x: (x["b"] - x["a"] >= MIN_WORDS - 1) | (size(x) > MIN_BYTES)
        )
        # Stretches from different earlier documents may overlap: places, each once.
        places = F.flatten(F.transform(long, lambda x: F.sequence(x["a"], x["b"])))
        return F.struct(*(given[c].alias(c) for c in ("lead", "words")), places.alias("gone"))

    def of(given: Column) -> Column:
        words, gone = given["words"], given["gone"]
        stay = F.array_except(F.sequence(F.lit(0), F.size(words) - 1), gone)
        left = F.array_join(F.transform(stay, lambda i: F.get(words, i)), "")
        lead = F.when(F.array_min(gone) == 0, "").otherwise(given["lead"])
        of_word = F.transform(lines(F.col(text)), lambda x, i: F.array_repeat(i, F.size(_words(x))))
        touched = _let(F.flatten(of_word), lambda line: F.transform(gone, lambda i: F.get(line, i)))
        made = F.struct(
            F.concat(lead, left).alias("text"), F.size(F.array_distinct(touched)).alias("n_removed")
        )
        # Lines are told only where words go.
        return F.when(F.size(gone) > 0, made)

    given = F.struct(
        F.regexp_extract(F.col(text), f"^{rows.SPACES}", 0).alias("lead"),
        F.split(F.ltrim(F.col(text), F.lit(_BLANK)), _WORD_END, -1).alias("words"),
    )
    return _let(_let(given, worth), of)
