"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every query is run
to the end twice, without bringing its rows to the driver, and the faster run
counts: the first also pays for compiling its code.
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import spark_session
from checks.queries import QUERIES

HEADLINE = (
    "accuracy_report",
    "score_multi_metric",
    "score_responses",
    "score_loglikelihood_choice",
    "score_severity_mad",
    "score_technique_f1",
    "all_rollup",
    "attach_few_shots",
    "limit_per_task",
    "prompt_p10_multi_answer",
    "prompt_p11_context_mcq",
    "normalize_task_spec",
    "flatten_results",
    "pivot_by_model",
    "collect_report",
    "history_at_turn",
    "prompt_completion_pairs",
    "drop_unanswered_turns",
)


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = spark_session(cpus)
    timed(spark, sf_dir, "score_mcq_regex")  # starts the engine; not counted
    seconds = {
        name: min(timed(spark, sf_dir, name), timed(spark, sf_dir, name)) for name in HEADLINE
    }
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
