"""Benchmark rows to prompt rows.

A layout is one column expression. A ``Formatter`` names the columns it reads, its
layout, how it finds the gold index and which choices are scored; the one job
``build_prompts`` applies any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, wording
from .validation import (
    Checked,
    choice_text,
    missing_choices,
    missing_columns,
    require_present,
)

ANSWER = "Answer:"


def lettered(options: Column, letters=labels.FOUR_CHOICES) -> Column:
    """Lines ``A. text`` for the first four options; further ones are not shown."""
    lines = [
        F.when(
            F.size(options) > i,
            F.concat(F.lit(f"{letter}. "), F.coalesce(F.get(options, F.lit(i)), F.lit("None"))),
        )
        for i, letter in enumerate(letters)
    ]
    return F.concat_ws("\n", *lines)


def _question(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question)


def subject_intro(subject, intro=wording.SUBJECT_INTRO) -> Column:
    return F.concat(F.lit(intro[0]), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit(intro[1]))


def subject_mcq(subject, question, choices, intro=wording.SUBJECT_INTRO) -> Column:
    head = F.concat(subject_intro(subject, intro), F.lit("\n\n"), _question(question))
    # Without options the question is followed by the answer line at once.
    shown = F.when(F.size(choices) > 0, lettered(choices))
    return F.concat_ws("\n", head, shown, F.lit(ANSWER))


def stored_mcq(
    prompt, direct: bool, old=wording.THREAT_LAST_LINE, new=wording.THREAT_DIRECT
) -> Column:
    return F.replace(prompt, F.lit(old), F.lit(new)) if direct else prompt


def weakness(
    prompt,
    description,
    direct: bool,
    old=wording.WEAKNESS_STORED,
    new=wording.WEAKNESS_ASKED,
    cue=wording.WEAKNESS_CUE,
) -> Column:
    if not direct:
        return F.replace(prompt, F.lit(old), F.lit(new))
    return _described(description, new, cue)


def severity(
    prompt, description, direct: bool, asked=wording.SEVERITY_ASKED, cue=wording.SEVERITY_CUE
) -> Column:
    return _described(description, asked, cue) if direct else prompt


def _described(description, asked: str, cue: str) -> Column:
    return F.concat(F.lit(f"{asked}\n\nCVE Description: "), description, F.lit(f" {cue}"))


def techniques(prompt, direct: bool, cue=wording.TECHNIQUES_CUE) -> Column:
    return F.concat(prompt, F.lit(f"\n{cue}")) if direct else prompt


def inline_options(question, options, cue=wording.INLINE_CUE) -> Column:
    shown = F.transform(
        options, lambda o: F.concat(o["key"], F.lit(") "), F.coalesce(o["text"], F.lit("None")))
    )
    return F.concat(
        _question(question),
        F.lit("\nOptions: "),
        F.array_join(shown, ", "),
        F.lit(f"\n\n{cue}\n{ANSWER}"),
    )


def listed_mcq(question, options, asked: str) -> Column:
    return F.concat(
        F.lit(f"{asked}\n"), _question(question), F.lit("\n"), lettered(options), F.lit(f"\n{ANSWER}")
    )


def boolean(prompt) -> Column:
    return F.concat(prompt, F.lit(f"\n{ANSWER}"))


def multi_answer(
    question, choices, examples: str | None = None, asked=wording.ANSWER_SET_ASKED
) -> Column:
    block = "" if examples is None else f"{examples}\n"
    return F.concat(
        F.lit(f"{asked}\n\n{block}"),
        _question(question),
        F.lit(" "),
        F.concat_ws(" ", choices),
        F.lit(f"\n{ANSWER}"),
    )


def example_block(question, choices, answer) -> Column:
    """One worked example in the layout of ``multi_answer``."""
    return F.concat(
        _question(question), F.lit(" "), F.concat_ws(" ", choices), F.lit(f"\n{ANSWER} "), answer
    )


def context_mcq(
    question, options, content=None, asked=wording.LETTERS_ASKED
) -> Column:
    lines = [
        F.concat(F.lit(f"{letter}. "), choice_text(options, letter))
        for letter in labels.FOUR_CHOICES
    ]
    body = F.concat_ws("\n", _question(question), *lines, F.lit(ANSWER))
    head = F.lit(f"{asked}\n")
    if content is None:
        return F.concat(head, body)
    context = F.when(content != "", F.concat(F.lit("Context: "), content, F.lit("\n\n")))
    return F.concat(head, F.coalesce(context, F.lit("")), body)


@dataclass(frozen=True)
class Formatter:
    """How the rows of one source schema become prompts.

    ``specific`` names the source column of each extra kept with a prompt; one that
    a table lacks is null.
    """

    required: Sequence[str]
    query: Callable[..., Column]
    gold: str
    gold_index: Callable[[Column], Column] | None = labels.gold_index_strict
    labels: Sequence[str] = labels.FOUR_CHOICES
    instruction: str | Callable[[], Column] | None = None
    specific: Mapping[str, str] = field(default_factory=dict)
    optional: Sequence[str] = field(default_factory=tuple)
    need_all_choices: str | None = None
    need_texts: str | None = None


c = F.col

FORMATTERS: dict[str, Formatter] = {
    "subject_mcq": Formatter(
        ["subject", "question", "choices", "answer"],
        lambda **kw: subject_mcq(c("subject"), c("question"), c("choices"), **kw),
        "answer",
        labels.gold_index_mixed,
        instruction=lambda: subject_intro(c("subject")),
    ),
    "threat_mcq": Formatter(
        ["Prompt", "GT"],
        lambda direct=True, **kw: stored_mcq(c("Prompt"), direct, **kw),
        "GT",
        labels.gold_index_normalized,
        instruction=wording.THREAT_ASKED,
        specific={"url": "URL", "Question": "Question"},
    ),
    "weakness": Formatter(
        ["Description", "Prompt", "GT"],
        lambda direct=True, **kw: weakness(c("Prompt"), c("Description"), direct, **kw),
        "GT",
        None,
        instruction=wording.WEAKNESS_ASKED,
        specific={"url": "URL", "Description": "Description", "GT": "GT"},
    ),
    "severity": Formatter(
        ["Description", "Prompt", "GT"],
        lambda direct=True, **kw: severity(c("Prompt"), c("Description"), direct, **kw),
        "GT",
        None,
        instruction=wording.SEVERITY_ASKED,
        specific={"url": "URL", "Description": "Description", "GT": "GT"},
    ),
    "techniques": Formatter(
        ["Prompt", "GT"],
        lambda direct=True, **kw: techniques(c("Prompt"), direct, **kw),
        "GT",
        None,
        instruction=wording.TECHNIQUES_ASKED,
        specific={"url": "URL", "Platform": "Platform", "Description": "Description", "GT": "GT"},
    ),
    "inline_options": Formatter(
        ["question", "answers", "solution"],
        lambda **kw: inline_options(c("question"), c("answers"), **kw),
        "solution",
        labels.gold_index_normalized,
    ),
    "listed_mcq": Formatter(
        ["question", "options", "answer"],
        lambda asked=wording.LETTERS_ASKED: listed_mcq(c("question"), c("options"), asked),
        "answer",
        instruction=wording.LETTERS_ASKED,
        specific={"id": "id"},
    ),
    "boolean": Formatter(
        ["prompt", "question", "answer"],
        lambda: boolean(c("prompt")),
        "answer",
        lambda label: labels.gold_index_strict(label, labels.TRUE_FALSE_UNKNOWN),
        labels.TRUE_FALSE_UNKNOWN,
        specific={"question": "question", "url": "url"},
    ),
    "listed_mcq_alt": Formatter(
        ["question", "answers", "label"],
        lambda asked=wording.LETTER_ASKED: listed_mcq(c("question"), c("answers"), asked),
        "label",
        instruction=wording.LETTER_ASKED,
        specific={"id": "id"},
    ),
    "multi_answer": Formatter(
        ["question", "answer", "choices"],
        lambda **kw: multi_answer(c("question"), c("choices"), **kw),
        "answer",
        lambda label: labels.gold_index_normalized(label, labels.ANSWER_SETS),
        labels.ANSWER_SETS,
        instruction=wording.ANSWER_SET_ASKED,
        specific={"id": "id", "topic": "topics"},
        need_texts="choices",
    ),
    "context_mcq": Formatter(
        ["question", "answers", "solution"],
        lambda include_context=True, **kw: context_mcq(
            c("question"), c("answers"), c("content") if include_context else None, **kw
        ),
        "solution",
        instruction=wording.LETTERS_ASKED,
        specific={"id": "id"},
        optional=["content"],
        need_all_choices="answers",
    ),
}


def register_formatter(name: str, formatter: Formatter) -> bool:
    """Add a formatter; a name already taken keeps its first meaning."""
    if name in FORMATTERS:
        return False
    FORMATTERS[name] = formatter
    return True


def build_prompts(rows: DataFrame, formatter: str, **options) -> Checked:
    """Rows (task, item_id and the formatter's columns) to prompt records.

    Accepted rows have task, item_id, query, instruction, choices, gold_index, gold and
    specific.
    """
    f = FORMATTERS[formatter]
    require_present(rows, f.required)
    for name in f.optional:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))

    gold_index = f.gold_index(c(f.gold)) if f.gold_index else F.lit(0)
    gaps = F.array().cast("array<string>")
    if f.need_all_choices:
        gaps = missing_choices(c(f.need_all_choices))
    # Plain conditions on single columns, which reach the scan.
    conditions = [c(name).isNotNull() for name in f.required] + [gold_index.isNotNull()]
    if f.need_all_choices:
        conditions.append(F.size(gaps) == 0)
    if f.need_texts:
        # The places, from 0, of choices without a text.
        places = F.transform(c(f.need_texts), lambda x, i: F.when(x.isNull(), i.cast("string")))
        gaps = F.coalesce(F.array_compact(places), gaps)
        conditions.append(~F.exists(f.need_texts, lambda x: x.isNull()))
    fine = reduce(lambda a, b: a & b, conditions)

    choices = labels.choices(f.labels) if f.gold_index else F.array(c(f.gold))
    extras = []
    for key, source in f.specific.items():
        value = c(source) if source in rows.columns else F.lit(None)
        extras += [F.lit(key), value.cast("string")]
    specific = F.create_map(*extras) if extras else F.lit(None)
    instruction = f.instruction() if callable(f.instruction) else F.lit(f.instruction)
    prompts = (
        rows.where(fine)
        .withColumn("gold_index", gold_index)
        .select(
            "task",
            "item_id",
            f.query(**options).alias("query"),
            instruction.cast("string").alias("instruction"),
            choices.alias("choices"),
            "gold_index",
            F.get(choices, c("gold_index")).alias("gold"),
            specific.cast("map<string,string>").alias("specific"),
        )
    )
    absent = missing_columns(f.required)
    rejects = rows.where(~fine).select(
        F.lit(formatter).alias("source"),
        c("item_id").cast("string").alias("key"),
        F.when(F.size(absent) > 0, "missing required value")
        .when(F.size(gaps) > 0, "choice without text")
        .otherwise("invalid label")
        .alias("reason"),
        F.concat(absent, gaps).alias("missing"),
    )
    return Checked(accepted=prompts, rejected=rejects)
