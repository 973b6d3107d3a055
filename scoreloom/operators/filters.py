"""Which documents belong to a domain: by a lexicon of weighted phrases, or by a trained model."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, in lower-cased text.
WORD = r"[\p{L}\p{Nd}]+"
#: Bytes of a lexicon that may be sent to every task as part of a plan.
LEXICON_BYTES = 4 << 20
#: Hashed features of the model, the rounds of its fit, and the weight that holds it back.
FEATURES, ROUNDS, REGULARISATION = 1 << 16, 40, 0.1


def domain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _lexicon(phrases: Iterable[tuple[str, int]]) -> dict[str, int]:
    """Phrases as lower-case words joined by blanks; of repeated ones the greatest weight."""
    out: dict[str, int] = {}
    for phrase, weight in phrases:
        words = " ".join(re.findall(r"[^\W_]+", phrase.lower()))
        if words:
            out[words] = max(int(weight), out.get(words, int(weight)))
    size = sum(len(p.encode()) + 8 for p in out)
    if size > LEXICON_BYTES:
        raise ValueError(f"a lexicon of {size} bytes; {LEXICON_BYTES} may be sent to every task")
    if not out:
        raise ValueError("a lexicon without phrases")
    return out


def lexicon_matches(words: Column, phrases: Iterable[tuple[str, int]]) -> Column:
    """``n`` and ``weight`` of the phrases in an array of words, from left to right, at each place
    the longest, none overlapping the one before. ``words`` is to be a column.

    Places are found by a set of the words that phrases start with; only there are longer
    pieces looked up, in a set per length, longest first.
    """
    lexicon = _lexicon(phrases)
    by_length: dict[int, list[str]] = {}
    for phrase in lexicon:
        by_length.setdefault(phrase.count(" ") + 1, []).append(phrase)
    starts = sorted({p.split(" ")[0] for p in lexicon})
    by_weight: dict[int, list[str]] = {}
    for phrase, weight in lexicon.items():
        by_weight.setdefault(weight, []).append(phrase)

    def piece(i: Column, n: Column | int) -> Column:
        return F.array_join(F.slice(words, i + 1, F.lit(n) if isinstance(n, int) else n), " ")

    def longest(i: Column) -> Column:
        n = F.lit(0)
        for length, listed in sorted(by_length.items()):  # the last is asked first
            fits = (i + length <= F.size(words)) & piece(i, length).isin(listed)
            n = F.when(fits, length).otherwise(n)
        return F.struct(i.alias("at"), n.alias("n"))

    def weighed(x: Column) -> Column:
        phrase, weight = piece(x["at"], x["n"]), F.lit(0).cast("bigint")
        for value, listed in by_weight.items():
            weight = F.when(phrase.isin(listed), F.lit(value).cast("bigint")).otherwise(weight)
        return F.struct(x["at"].alias("at"), x["n"].alias("n"), weight.alias("weight"))

    places = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(starts), i).otherwise(-1)), lambda i: i >= 0
    )
    found = F.transform(F.filter(F.transform(places, longest), lambda x: x["n"] > 0), weighed)
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("free"), zero.alias("n"), zero.alias("weight")),
        lambda state, x: F.when(x["at"] < state["free"], state).otherwise(
            F.struct(
                (x["at"] + x["n"]).alias("free"),
                (state["n"] + 1).alias("n"),
                (state["weight"] + x["weight"]).alias("weight"),
            )
        ),
    )


def domain_filter_lexicon(
    docs: DataFrame, phrases: Iterable[tuple[str, int]], per_thousand: int, text: str = "text"
) -> DataFrame:
    """Add ``n_words``, ``n_phrases``, ``weight`` (of the phrases found, whole numbers) and
    ``in_domain``: the weight is ``per_thousand`` or more for a thousand words. A document
    without words is in no domain. Within a row, without a shuffle."""
    df = docs.withColumn("_words", domain_words(F.col(text)))
    df = df.withColumn("_found", lexicon_matches(F.col("_words"), phrases))
    n = F.size("_words").cast("bigint")
    made = {
        "n_words": n,
        "n_phrases": F.col("_found.n"),
        "weight": F.col("_found.weight"),
        "in_domain": (n > 0) & (1000 * F.col("_found.weight") >= per_thousand * n),
    }
    return df.withColumns(made).drop("_words", "_found")


def fit_domain_model(
    labelled: DataFrame, path: str, text: str = "text", label: str = "label", features: int = FEATURES
) -> PipelineModel:
    """Fit words, hashed, to a 0/1 label, and save the pipeline at ``path``.

    Rows without a label are left out. The fit is Spark's own: tasks add up gradients, the
    driver holds one weight per feature and no text. What it learned is read back from
    the files by :func:`score_domain_model`, in this session or another.
    """
    train = labelled.where(F.col(label).isNotNull()).select(
        F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label")
    )
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=WORD, gaps=False, toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_probability",
            predictionCol="_prediction", rawPredictionCol="_raw", maxIter=ROUNDS, regParam=REGULARISATION,
        ),
    ]
    model = Pipeline(stages=stages).fit(train)
    model.write().overwrite().save(path)
    return model


def score_domain_model(docs: DataFrame, path: str, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``domain_score`` (0 to 1) and ``in_domain`` to every row, by the model at ``path``."""
    model = PipelineModel.load(path)
    scored = model.transform(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    score = vector_to_array("_probability")[1]
    made = {"domain_score": score, "in_domain": score >= threshold}
    return scored.withColumns(made).select(*(c for c in docs.columns if c not in made), *made)
