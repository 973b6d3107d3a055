"""The task registry: which slice, layout, metrics and splits make up a task.

The names of the in-house suite and of the owner of the re-hosted datasets are
parameters, since they differ between sites.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

HOUSE = "house_mcq"
OWNER = "benchmarks"

LL = ["loglikelihood"]
FULL = ["exact_match", "prefix_match", "mcq_regex"]
MATCHES = ["exact_match", "prefix_match"]
LETTER = ["mcq_regex"]
WEAKNESS = ["weakness_id"]
NEWLINE = ["\n"]

# Sizes and subsets of the suites.
CYBERMETRICS_SIZES = (80, 500, 2000, 10000)
HOUSE_SUBSETS = (
    "cybersecurity_knowledge_generals",
    "cybersecurity_knowledge_frameworks",
    "cybersecurity_skills",
    "cybersecurity_tools_cli",
    "cybersecurity_tools_kali",
)
SECURE_LAYOUTS = {
    "MAET": "listed_mcq",
    "CWET": "listed_mcq",
    "KCV": "boolean",
    "VOOD": "boolean",
}


@dataclass(frozen=True)
class Task:
    task: str
    category: str
    repo: str
    subset: str
    formatter: str
    variant: str
    metrics: list
    available_splits: list
    few_shot_split: str | None = None
    few_shot_rule: str | None = None
    generation_size: int = -1
    stops: list | None = None
    evaluation_split: str = "test"
    version: int = 0


SCHEMA = (
    "position int, task string, category string, repo string, subset string, "
    "formatter string, variant string, metrics array<string>, available_splits array<string>, "
    "few_shot_split string, few_shot_rule string, generation_size int, stops array<string>, "
    "evaluation_split string, version int"
)


def _either(logprob: bool, metrics=FULL) -> dict:
    """Scored by choice log-probabilities, or by what was generated in one line."""
    if logprob:
        return {"metrics": LL}
    return {"metrics": metrics, "generation_size": 100, "stops": NEWLINE}


def _cybermetrics(owner):
    for logprob in (True, False):
        for size in CYBERMETRICS_SIZES:
            yield Task(
                f"cybermetrics:{size}" + ("" if logprob else "_em"),
                "CyberMetrics",
                f"{owner}/CyberMetrics",
                f"cyberMetric_{size}",
                "inline_options",
                "",
                available_splits=["test"],
                **_either(logprob),
            )


def _subject():
    yield Task(
        "mmlu:cs_security",
        "MMLU",
        "lighteval/mmlu",
        "computer_security",
        "subject_mcq",
        "",
        FULL,
        ["auxiliary_train", "test", "validation", "dev"],
        few_shot_split="dev",
        generation_size=5,
        stops=NEWLINE,
    )


def _threat(owner):
    hosts = [
        ("cti_bench", f"{owner}/CTI-Bench", ["validation", "test"]),
        ("cti_bench_ori", "AI4Sec/cti-bench", ["test"]),
    ]
    for prefix, repo, splits in hosts:
        for name, subset, formatter, variant, metrics, size, stops in (
            ("cti-mcq", "cti-mcq", "threat_mcq", "direct", LL, -1, None),
            ("cti-mcq_em", "cti-mcq", "threat_mcq", "full", LETTER, 1024, []),
            ("cti-mcq_em_direct", "cti-mcq", "threat_mcq", "direct", LETTER, 100, NEWLINE),
            ("cti-rcm_em", "cti-rcm", "weakness", "full", WEAKNESS, 512, []),
            ("cti-rcm_em_direct", "cti-rcm", "weakness", "direct", WEAKNESS, 100, NEWLINE),
        ):
            yield Task(
                f"{prefix}:{name}",
                "CTI-Bench" if prefix == "cti_bench" else "CTI-Bench (original)",
                repo,
                subset,
                formatter,
                variant,
                metrics,
                splits,
                generation_size=size,
                stops=stops,
            )


_WITH_VAL = {
    "available_splits": ["val", "test"],
    "few_shot_split": "val",
    "few_shot_rule": "sequential",
}


def secure_task(name: str, subset: str, logprob: bool, owner: str = OWNER) -> Task:
    """A task over one subset of the suite; a subset not known is an error."""
    layout = SECURE_LAYOUTS.get(subset)
    if layout is None:
        raise ValueError(f"unknown subset {subset!r} of SECURE")
    return Task(
        f"secure:{name}",
        "SECURE",
        f"{owner}/SECURE",
        subset,
        layout,
        "",
        **_either(logprob, FULL if layout == "listed_mcq" else MATCHES),
        **_WITH_VAL,
    )


def _secure(owner):
    for name, subset, logprob in (
        ("maet", "MAET", True),
        ("cwet", "CWET", True),
        ("maet_em", "MAET", False),
        ("cwet_em", "CWET", False),
        ("kcv_em", "KCV", False),
    ):
        yield secure_task(name, subset, logprob, owner)


def _secbench(owner):
    for name, logprob in (("mcq-en", True), ("mcq-en_em", False)):
        yield Task(
            f"secbench:{name}",
            "SecBench",
            f"{owner}/SecBench",
            "MCQs_English",
            "listed_mcq_alt",
            "",
            **_either(logprob),
            **_WITH_VAL,
        )


def _seceval(owner):
    for name, variant in (("mcqa", ""), ("mcqa_5s", "examples")):
        yield Task(
            f"seceval:{name}",
            "SecEval",
            f"{owner}/SecEval",
            "default",
            "multi_answer",
            variant,
            MATCHES,
            generation_size=512,
            stops=NEWLINE,
            **_WITH_VAL,
        )


def _house(owner, house):
    for subset in HOUSE_SUBSETS:
        for logprob in (True, False):
            yield Task(
                f"{house}{'' if logprob else '_em'}:{subset}",
                "In-house MCQ",
                f"{owner}/{house}",
                subset,
                "context_mcq",
                "no_context",
                available_splits=["test"],
                few_shot_split="val",
                few_shot_rule="sequential",
                **_either(logprob),
            )


def tasks(owner: str = OWNER, house: str = HOUSE) -> list[Task]:
    """All tasks in registry order."""
    return [
        *_cybermetrics(owner),
        *_subject(),
        *_threat(owner),
        *_secure(owner),
        *_secbench(owner),
        *_seceval(owner),
        *_house(owner, house),
    ]


def task_registry(spark: SparkSession, owner: str = OWNER, house: str = HOUSE) -> DataFrame:
    """The registry as a table, in registry order."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    assert set(names[1:]) == {f.name for f in fields(Task)}
    rows = []
    for position, task in enumerate(tasks(owner, house)):
        values = {"position": position, **asdict(task)}
        rows.append(tuple(values[n] for n in names))
    return session.local_table(spark, rows, SCHEMA)


def distinct_datasets(requests: DataFrame) -> DataFrame:
    """Each (repo, subset) once, with the task that asked for it first.

    ``requests`` has position, task, repo and subset, one row per use of a task.
    Uses are first reduced to one row per task, by a hash aggregate.
    """
    firsts = requests.groupBy("repo", "subset", "task").agg(F.min("position").alias("position"))
    return firsts.groupBy("repo", "subset").agg(
        F.min_by("task", "position").alias("task"), F.min("position").alias("position")
    )


CURATED = "Curated suites"


def task_catalogue(registry: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """Tasks of each category, in registry order, and the names of the suites.

    The re-hosted originals are not offered for choice and are left out.
    """
    listed = registry.where(~F.startswith("task", F.lit("cti_bench_ori:"))).select(
        "category", "position", "task"
    )
    if suites is not None:
        names = suites.groupBy("suite").agg(F.min("place").alias("position"))
        listed = listed.unionByName(
            names.select(F.lit(CURATED).alias("category"), "position", F.col("suite").alias("task"))
        )
    in_order = F.array_sort(F.collect_list(F.struct("position", "task")))
    return listed.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.transform(in_order, lambda t: t["task"]).alias("tasks")
    )


def curated_suites(spark: SparkSession, house: str = HOUSE) -> DataFrame:
    """(suite, place, task, shots): base suites and suites for instructed models."""
    related = [
        "cti_bench:cti-mcq",
        "cti_bench:cti-rcm_em{}",
        "cybermetrics:500",
        "mmlu:cs_security",
        "secbench:mcq-en",
        "seceval:mcqa",
        "secure:maet",
        "secure:cwet",
        "secure:kcv_em",
    ]
    suites = {
        "house_base": [(f"{house}:{s}", 0) for s in HOUSE_SUBSETS],
        "house_instruct": [(f"{house}_em:{s}", 0) for s in HOUSE_SUBSETS],
        "related_base": [(t.format("_direct"), 5) for t in related],
        "related_instruct": [(t.format(""), 0) for t in related],
    }
    rows = [
        (suite, place, task, shots)
        for suite, members in suites.items()
        for place, (task, shots) in enumerate(members)
    ]
    return session.local_table(spark, rows, "suite string, place int, task string, shots int")


def suite_tasks(suites: DataFrame, registry: DataFrame) -> DataFrame:
    """Suite members with their registry row; ``known`` is false without one."""
    found = registry.withColumn("known", F.lit(True))
    return suites.join(found, "task", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def base_name(task: Column) -> Column:
    """Task name by which the variant is chosen."""
    return F.replace(task, F.lit("_ori"), F.lit(""))


def scoring_mode(task: Column) -> Column:
    """How a task name says its responses are scored."""
    generates = (
        F.contains(task, F.lit("_em"))
        | F.startswith(task, F.lit("seceval:"))
        | F.startswith(task, F.lit("mmlu:"))
    )
    return F.when(generates, "generative").otherwise("loglikelihood")


def generation_size(task: Column) -> Column:
    """Longest response a task name allows; -1 where nothing is generated."""
    name = base_name(task)
    return (
        F.when(scoring_mode(name) == "loglikelihood", -1)
        .when(name == "cti_bench:cti-mcq_em", 1024)
        .when(name == "cti_bench:cti-rcm_em", 512)
        .when(F.startswith(name, F.lit("seceval:")), 512)
        .when(F.startswith(name, F.lit("mmlu:")), 5)
        .otherwise(100)
    )


def resolve_variants(named: DataFrame, registry: DataFrame, task: str = "task") -> DataFrame:
    """Add what a task name decides; ``known`` is false for names of no task."""
    known = registry.select(F.col("task").alias(task), F.lit(True).alias("known"))
    name = F.col(task)
    return (
        named.join(known, task, "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumns(
            {
                "base_name": F.when(F.col("known"), base_name(name)),
                "mode": F.when(F.col("known"), scoring_mode(name)),
                "generation_size": F.when(F.col("known"), generation_size(name)),
            }
        )
    )
