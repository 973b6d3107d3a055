"""Per-sample scores.

Scorers are column expressions over a response ``text`` (null: no response) and a
``gold`` text. What is extracted from a response is extracted before any join, so
that only short values are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.severity import with_base_score
from .validation import Checked

WORST_DISTANCE = 10.0

#: Rejects of one repeated response that are made at once.
STEP = 10_000


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Scorer:
    """A metric: what is taken from a response, how it compares, how it sums up.

    ``extract`` sees the response text only and so runs before the join to the
    gold answers; ``compare`` sees what it returned, null for no response.
    """

    metric: str
    extract: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]
    aggregate: Callable[[Column], Column] = F.avg
    higher_is_better: bool = True
    category: str = "generative"

    def __call__(self, text: Column, gold: Column) -> Column:
        return self.compare(self.extract(text), gold)


def _letter_match(letter: Column, gold: Column) -> Column:
    return _flag(letter == F.upper(T.strip(gold)))


def _same(found: Column, gold: Column) -> Column:
    return _flag(found == gold)


def _stripped_if_any(text: Column) -> Column:
    return F.when(text != "", T.strip(text))


def _same_stripped(found: Column, gold: Column) -> Column:
    return _flag(found == T.strip(gold))


def _starts_with(found: Column, gold: Column) -> Column:
    return _flag(F.startswith(found, T.strip(gold)))


def matches_anything(gold: Column) -> Column:
    """A gold text that is empty once stripped, which every response starts with."""
    return T.strip(gold) == ""


def _set_f1(predicted: Column, gold: Column) -> Column:
    wanted = F.array_distinct(T.parse_technique_list(gold))
    shared = F.size(F.array_intersect(predicted, wanted))
    precision = shared / F.size(predicted)
    recall = shared / F.size(wanted)
    both_empty = (F.size(predicted) == 0) & (F.size(wanted) == 0)
    return (
        F.when(predicted.isNull(), 0.0)
        .when(both_empty, 1.0)
        .when(shared == 0, 0.0)
        .otherwise(2 * (precision * recall) / (precision + recall))
    )


# The letter a response settles on is the gold letter.
mcq_regex = Scorer("acc", T.extract_choice_letter, _letter_match)
# The last weakness id, or the stripped text where there is none, is the gold id.
weakness_id = Scorer("acc", lambda t: T.extract_weakness_id(T.strip(t)), _same)
# Both agree after stripping; an empty response scores 0.
exact_match = Scorer("em", _stripped_if_any, _same_stripped)
# The stripped response starts with the stripped gold text.
prefix_match = Scorer("pem", _stripped_if_any, _starts_with)
# F1 of the sets of technique ids; no response scores 0.
technique_f1 = Scorer("f1", lambda t: T.extract_techniques(T.strip(t)), _set_f1)

SCORERS: dict[str, Scorer] = {
    "mcq_regex": mcq_regex,
    "weakness_id": weakness_id,
    "exact_match": exact_match,
    "prefix_match": prefix_match,
    "technique_f1": technique_f1,
}


def register_scorer(name: str, scorer: Scorer) -> bool:
    """Add a scorer; a name already taken keeps its first meaning."""
    if name in SCORERS:
        return False
    SCORERS[name] = scorer
    return True


def severity_distance(
    df: DataFrame, text: str = "text", gold: str = "gold", out: str = "mad"
) -> DataFrame:
    """Add the distance between the base scores of the stated and the gold vector.

    Without a response or a vector in it the distance is the worst possible. If
    either vector has no score, equal strings are 0 apart and others the worst.
    """
    df = df.withColumn("_stated", T.find_severity_vector(T.strip(F.col(text))))
    df = with_base_score(df, "_stated", "_stated_score")
    df = with_base_score(df, gold, "_gold_score")
    unscored = F.col("_stated_score").isNull() | F.col("_gold_score").isNull()
    same = F.coalesce(F.col("_stated") == F.col(gold), F.lit(False))
    distance = (
        F.when(F.col("_stated").isNull(), WORST_DISTANCE)
        .when(unscored, F.when(same, 0.0).otherwise(WORST_DISTANCE))
        .otherwise(F.abs(F.col("_stated_score") - F.col("_gold_score")))
    )
    return df.withColumn(out, distance).drop("_stated", "_stated_score", "_gold_score")


def severity_similarity(distance: Column) -> Column:
    """Distance turned into a similarity between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / WORST_DISTANCE))


def best_choice(logprobs: Column) -> Column:
    """Index of the highest log-probability in an array, the first one on a tie."""
    return (F.array_position(logprobs, F.array_max(logprobs)) - 1).cast("int")


def loglikelihood_choice(choices: DataFrame, n_choices: int | None = None) -> DataFrame:
    """Score choices stored one per row: (model, task, item_id, choice_idx,
    logprob, gold_index).

    The highest log-probability is picked, the first one on a tie; a null one never, so an
    item without any picks none and scores 0. An index below 0 is an error. Stored as one
    array per item, ``best_choice`` needs no shuffle and is to be preferred.

    With ``n_choices``, the length of the task's label domain, the choices are kept in a
    hash aggregate, and an index beyond it is an error. Without, they are sorted. Both
    give the same.
    """
    keys = ["model", "task", "item_id"]
    bounds = [F.min("choice_idx").alias("_first"), F.max("choice_idx").alias("_last")]
    gold = F.max("gold_index").alias("gold_index")
    if n_choices is None:
        order = F.struct(F.col("logprob"), (-F.col("choice_idx")).alias("first"))
        known = F.when(F.col("logprob").isNotNull(), order)
        best = F.max_by("choice_idx", known).alias("picked")
        grouped = choices.groupBy(*keys).agg(best, *bounds, gold)
        picked, legal = F.col("picked"), F.col("_first") >= 0
    else:
        at = [
            F.max(F.when(F.col("choice_idx") == i, F.col("logprob"))).alias(f"_{i}")
            for i in range(n_choices)
        ]
        grouped = choices.groupBy(*keys).agg(*at, *bounds, gold)
        picked = best_choice(F.array(*[F.col(f"_{i}") for i in range(n_choices)]))
        legal = (F.col("_first") >= 0) & (F.col("_last") < n_choices)
    stray = F.raise_error(F.concat(F.lit("choice out of range in "), "task"))
    found = grouped.select(
        *keys, F.when(legal, picked).otherwise(stray.cast("int")).alias("picked"), "gold_index"
    )
    return found.withColumn("value", _flag(F.col("picked") == F.col("gold_index")))


def to_sample_scores(wide: DataFrame, metrics) -> DataFrame:
    """One column per metric to one row per sample and metric."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]
    return wide.select(
        "model", "task", "item_id", F.explode(F.array(*pairs)).alias("score")
    ).select("model", "task", "item_id", "score.metric", "score.value")


def _rows_per_score(df: DataFrame, asked: str, scorers: dict[str, Scorer], value) -> DataFrame:
    """One row per scorer a row asks for; ``value`` gives its score from its name.

    The scores are columns first, where generated code computes them, and rows
    only then. A scorer that gives null leaves the sample out.
    """
    columns = {name: f"_score_{name}" for name in scorers}
    wide = df.select(
        "model",
        "task",
        "item_id",
        *[
            F.when(F.array_contains(asked, name), value(name, s)).alias(columns[name])
            for name, s in scorers.items()
        ],
    )
    scores = [
        F.struct(
            F.lit(name).alias("scorer"),
            F.lit(s.metric).alias("metric"),
            F.col(columns[name]).alias("value"),
        )
        for name, s in scorers.items()
    ]
    return (
        wide.select("model", "task", "item_id", F.inline(F.array(*scores)))
        .where(F.col("value").isNotNull())
        .select("model", "task", "item_id", "scorer", "metric", "value")
    )


def _known(asked: Column, scorers: dict[str, Scorer]) -> Column:
    """The scorers asked for; a name without a scorer, or two scorers that report one
    metric, are errors."""
    names = F.array(*[F.lit(name) for name in scorers])
    metrics = F.create_map(*[F.lit(x) for name, s in scorers.items() for x in (name, s.metric)])
    unknown = F.array_except(asked, names)
    reported = F.transform(F.array_distinct(asked), lambda name: metrics[name])
    return (
        F.when(
            F.size(unknown) > 0,
            F.raise_error(F.concat(F.lit("no scorer named "), F.array_join(unknown, ","))),
        )
        .when(
            F.size(F.array_distinct(reported)) < F.size(reported),
            F.raise_error(F.concat(F.lit("two scorers of one metric in "), F.array_join(asked, ","))),
        )
        .otherwise(asked)
    )


def score_multi_metric(
    df: DataFrame, scorers: dict[str, Scorer] | None = None, asked: str = "metrics"
) -> DataFrame:
    """Score each (text, gold) by the scorers its row names, and by no others.

    All scores of a row come out of one projection; the text is not repeated per
    metric. A name without a scorer is an error, and so are two scorers of one metric.
    """
    scorers = SCORERS if scorers is None else scorers
    return _rows_per_score(
        df.withColumn(asked, _known(F.col(asked), scorers)),
        asked,
        scorers,
        lambda name, s: s(F.col("text"), F.col("gold")),
    )


def score_responses(
    responses: DataFrame, prompts: DataFrame, tasks: DataFrame, scorers=None
) -> Checked:
    """Sample scores of generated responses.

    ``responses`` (model, task, item_id, texts), ``prompts`` (task, item_id, gold),
    ``tasks`` (task, metrics, stops). Every prompt is scored for every model that was run
    on its task; one without a response scores as no response does. Each response is cut at
    its task's stop strings and reduced to what its scorers extract; only that is joined to
    the gold answers on (task, item_id). A name without a scorer is an error. Responses to a
    task or an item that is not there, without a model, or beyond the first to one prompt are
    rejected with the reason; the first is the one whose text has the least MD5, none last.
    """
    scorers = SCORERS if scorers is None else scorers
    asked = tasks.select("task", _known(F.col("metrics"), scorers).alias("metrics"), "stops")
    whole = T.first_response(F.col("texts"))
    cut = responses.join(asked, "task").where(F.col("model").isNotNull()).select(
        "model", "task", "item_id", "metrics", F.md5(whole).alias("_hash"),
        T.cut_at_stops(whole, F.col("stops")).alias("text"),
    )
    extracted = cut.select(
        "model",
        "task",
        "item_id",
        F.struct(
            F.col("_hash").isNull().alias("none"),
            F.col("_hash").alias("hash"),
            *[
                F.when(F.array_contains("metrics", name), s.extract(F.col("text"))).alias(f"_{name}")
                for name, s in scorers.items()
            ],
        ).alias("_found"),
    )
    # A response counts once: of repeated ones that whose text hashes lowest.
    once = extracted.groupBy("model", "task", "item_id").agg(F.min("_found").alias("_found"))
    once = once.select("model", "task", "item_id", *(F.col("_found")[f"_{n}"].alias(f"_{n}") for n in scorers))
    # One row a task, with the models that were run on it; set apart from how it was made, so
    # that the join can be split where a task has most prompts.
    run = responses.groupBy("task").agg(F.array_sort(F.collect_set("model")).alias("_models"))
    run = asked.select("task", "metrics").join(run, "task").hint("rebalance")
    items = prompts.select("task", "item_id", "gold")
    wanted = items.join(run, "task").select(
        "task", "item_id", "gold", "metrics", F.explode("_models").alias("model")
    )
    joined = wanted.join(once, ["model", "task", "item_id"], "left")
    scores = _rows_per_score(
        joined, "metrics", scorers, lambda name, s: s.compare(F.col(f"_{name}"), F.col("gold"))
    )
    return Checked(accepted=scores, rejected=_unscored(responses, items, asked))


def _unscored(responses: DataFrame, items: DataFrame, asked: DataFrame) -> DataFrame:
    """A row per response that is not scored, with the reason; keys alone are read."""
    known = items.select("task", "item_id").distinct().withColumn("_known", F.lit(True))
    tasks = asked.select("task", F.lit(True).alias("_asked"))
    there = responses.select("model", "task", "item_id").join(tasks, "task", "left")
    marked = there.join(known, ["task", "item_id"], "left").select(
        "model",
        "task",
        "item_id",
        F.when(F.col("_asked").isNull(), "no such task")
        .when(F.col("_known").isNull(), "no such item")
        .when(F.col("model").isNull(), "no model")
        .alias("reason"),
    )
    strays = marked.where(F.col("reason").isNotNull())
    counts = marked.where(F.col("reason").isNull()).groupBy("model", "task", "item_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    # One row per response beyond the first, made in steps, for a response may be repeated much.
    last = F.floor((F.col("_n") - 2) / STEP)
    steps = counts.where(F.col("_n") > 1).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    in_step = F.least(F.lit(STEP).cast("bigint"), F.col("_n") - 1 - F.col("_step") * STEP)
    repeated = steps.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), in_step))).select(
        "model", "task", "item_id", F.lit("repeated response").alias("reason")
    )
    return strays.unionByName(repeated)


def count_rejects(rejected: DataFrame) -> DataFrame:
    """Rejected responses per model, task and reason."""
    return rejected.groupBy("model", "task", "reason").agg(F.count(F.lit(1)).alias("n"))
