"""Result payloads to report tables.

Work stays in long form, one row per (file, task, metric); columns are made last,
from a list of names that is as long as tasks times metrics and no longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STDERR_SUFFIX = "_stderr"
BASE_COLUMNS = ("model", "task", "json_path")
MAX_REPORT_COLUMNS = 10000


def parse_payload(text: Column) -> Column:
    """Decode a payload; null when it is not JSON.

    Not-a-number and infinite values, which the usual writers leave bare, are read
    as text; they turn into numbers again when cast.
    """
    bare = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,}\]])"
    repaired = F.regexp_replace(text, bare, '$1"$2"')
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(repaired))


def parent_path(path: Column) -> Column:
    """Directory part of a path, as ``.`` when there is none."""
    cut = F.regexp_replace(path, r"/[^/]*\z", "")
    return (
        F.when(~F.contains(path, F.lit("/")), ".")
        .when(cut == "", "/")
        .otherwise(cut)
    )


def resolve_model_name(payload: Column, path: Column) -> Column:
    """Name in the general configuration, else in its model configuration, else
    the directory of the file. An empty name counts as none."""
    named = [
        F.nullif(F.try_variant_get(payload, f"$.config_general.{place}", "string"), F.lit(""))
        for place in ("model_name", "model_config.model_name")
    ]
    return F.coalesce(*named, parent_path(path))


def run_time(payload: Column, path: Column) -> Column:
    """When a file's run was: as the payload says, else as its name ``results_<time>.json``
    does, else the name itself."""
    said = F.nullif(F.try_variant_get(payload, "$.config_general.run_time", "string"), F.lit(""))
    name = F.substring_index(path, "/", -1)
    dated = F.nullif(F.regexp_extract(name, r"\Aresults_(.+)\.json\z", 1), F.lit(""))
    return F.coalesce(said, dated, name)


def task_entries(parsed: DataFrame) -> DataFrame:
    """One row per file and task: (model, task, json_path, run, metrics).

    ``parsed`` has json_path and the decoded payload; entries that are not objects
    are left out, and so are payloads that are null. ``run`` tells runs apart in order: the
    time in the payload, else in the name of the file, else that name.
    """
    spark = parsed.sparkSession
    named = parsed.select(
        "json_path",
        resolve_model_name(F.col("payload"), F.col("json_path")).alias("model"),
        run_time(F.col("payload"), F.col("json_path")).alias("run"),
        F.try_variant_get("payload", "$.results", "variant").alias("results"),
    )
    return spark.sql(
        """
        SELECT r.model, t.key AS task, r.json_path, r.run, t.value AS metrics
        FROM {named} AS r, LATERAL variant_explode(r.results) AS t
        WHERE t.key IS NOT NULL AND schema_of_variant(t.value) LIKE 'OBJECT%'
        """,
        named=named,
    )


def flatten_results(entries: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per metric of a task entry; ``raw`` keeps the value as written.

    ``keep_empty`` keeps an entry without metrics as a row with a null metric, so
    that its model still shows up in a report.
    """
    spark = entries.sparkSession
    explode = "variant_explode_outer" if keep_empty else "variant_explode"
    return spark.sql(
        f"""
        SELECT e.model, e.task, e.json_path, e.run, m.key AS metric,
               try_cast(m.value AS DOUBLE) AS value, CAST(m.value AS STRING) AS raw
        FROM {{entries}} AS e, LATERAL {explode}(e.metrics) AS m
        """,
        entries=entries,
    )


def drop_stderr(long: DataFrame) -> DataFrame:
    is_stderr = F.coalesce(F.endswith(F.col("metric"), F.lit(STDERR_SUFFIX)), F.lit(False))
    return long.where(~is_stderr)


def path_parts(path: Column) -> Column:
    """Parts of a path: a root slash is a part, empty and ``.`` parts are not."""
    names = F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))
    root = (
        F.when(path.rlike("^//(?!/)"), F.array(F.lit("//")))
        .when(F.startswith(path, F.lit("/")), F.array(F.lit("/")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.concat(root, names)


def common_prefix(entries: DataFrame) -> DataFrame:
    """The one-row table of the prefix to trim from model names, null for none.

    The longest run of parts common to all names is the one common to the smallest
    and the largest, so one aggregate finds it.
    """
    parts = path_parts(F.col("model"))
    ends = entries.where(F.col("model") != "").agg(
        F.min(parts).alias("low"), F.max(parts).alias("high")
    )
    pairs = F.zip_with("low", "high", lambda a, b: F.coalesce(a == b, F.lit(False)))
    same = F.array_position(F.concat(pairs, F.array(F.lit(False))), F.lit(False)) - 1
    joined = F.array_join(F.slice("low", F.lit(1), same.cast("int")), "/")
    prefix = F.concat(F.regexp_replace(joined, r"/+\z", ""), F.lit("/"))
    return ends.select(F.when(same > 0, prefix).alias("prefix"))


def trim_model_prefix(entries: DataFrame) -> DataFrame:
    """Remove the leading path parts that all model names share.

    A name that is nothing but the prefix stays, and so does a single name.
    """
    prefix = common_prefix(entries).scalar()
    longer = F.startswith("model", prefix) & (F.length("model") > F.length(prefix))
    trimmed = F.when(longer, F.substr("model", F.length(prefix) + 1)).otherwise(F.col("model"))
    return entries.withColumn("model", trimmed)


def report_column() -> Column:
    """Report column of a metric of a task; null where there is no metric."""
    return F.concat("task", F.lit("_"), "metric")


def latest_cells(long: DataFrame) -> DataFrame:
    """One value per model and report column, from the latest run.

    Runs of one time, which the usual names don't give, go by path.
    """
    return (
        long.withColumn("column", report_column())
        .groupBy("model", "column")
        .agg(
            F.max_by(
                F.struct("task", "metric", "value", "raw"), F.struct("run", "json_path")
            ).alias("cell")
        )
        .select("model", "column", "cell.*")
    )


def distinct_names(df: DataFrame, column: str, most: int = MAX_REPORT_COLUMNS) -> list[str]:
    """Sorted distinct values that become columns; more than ``most`` is an error."""
    named = df.select(column).where(F.col(column).isNotNull())
    found = [r[0] for r in named.distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values of {column!r} cannot become columns")
    return sorted(found)


def pivot_by_model(
    long: DataFrame, columns=None, cell: str = "raw", most: int = MAX_REPORT_COLUMNS
) -> DataFrame:
    """One row per model, one column per task and metric, names in code point order."""
    if columns is None:
        columns = distinct_names(long.select(report_column().alias("column")), "column", most)
    cells = latest_cells(long)
    first = F.first(cell, ignorenulls=True)
    return cells.groupBy("model").pivot("column", columns).agg(first)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def results_long_table(
    entries: DataFrame, metrics=None, with_stderr: bool = True, most: int = MAX_REPORT_COLUMNS
) -> DataFrame:
    """One row per file and task, one column per metric.

    A task entry already holds its metrics, so they are read out of it in place
    and nothing is shuffled. A name that no path can spell is looked up in the entry read
    as a map.
    """
    if metrics is None:
        named = flatten_results(entries.select(*BASE_COLUMNS, "run", "metrics"))
        metrics = distinct_names(named, "metric", most)
    if not with_stderr:
        metrics = [m for m in metrics if not m.endswith(STDERR_SUFFIX)]

    def cell(name: str) -> Column:
        if '"' in name or "\\" in name:
            return F.try_element_at(F.col("metrics").cast("map<string,string>"), F.lit(name))
        return F.try_variant_get("metrics", '$["' + name + '"]', "string")

    return entries.select(*BASE_COLUMNS, *(cell(m).alias(m) for m in metrics))


def metric_group(column: str) -> str:
    return column.rsplit("_", 1)[-1]


def split_by_metric(report: DataFrame) -> dict[str, DataFrame]:
    """One table per metric, by the part of the column name after the last
    underscore; each keeps the base columns."""
    base = [c for c in BASE_COLUMNS if c in report.columns]
    groups: dict[str, list[str]] = {}
    for column in report.columns:
        if column not in base:
            groups.setdefault(metric_group(column), []).append(column)
    return {
        group: report.select(*map(quoted, base), *map(quoted, columns))
        for group, columns in groups.items()
    }


def result_payloads(scores: DataFrame, run_time: str | None = None) -> DataFrame:
    """Task scores to one payload per model.

    ``scores`` is (model, task, metric, value, stderr); every metric also gives
    ``<metric>_stderr``. With a column ``shots`` a task is named ``task|shots``, as result
    files do; the mean over all tasks keeps its name. A payload is as long as tasks times
    metrics. ``run_time`` sorts as time does and goes into the payload.
    """
    entries = F.array(
        F.struct(F.col("metric").alias("name"), F.col("value")),
        F.struct(
            F.concat("metric", F.lit(STDERR_SUFFIX)).alias("name"), F.col("stderr").alias("value")
        ),
    )
    if "shots" in scores.columns:
        named = F.concat_ws("|", "task", F.col("shots").cast("string"))
        scores = scores.withColumn("task", F.when(F.col("task") == "all", F.col("task")).otherwise(named))
    per_task = scores.groupBy("model", "task").agg(
        F.map_from_entries(F.array_sort(F.flatten(F.collect_list(entries)))).alias("metrics")
    )
    by_task = F.array_sort(
        F.collect_list(F.struct("task", "metrics")),
        lambda a, b: F.when(a["task"] < b["task"], -1).otherwise(1),
    )
    results = F.map_from_entries(by_task)
    per_model = per_task.groupBy("model").agg(results.alias("results"))
    general = [F.col("model").alias("model_name")]
    if run_time is not None:
        general.append(F.lit(run_time).alias("run_time"))
    return per_model.select("model", F.struct(*general).alias("config_general"), "results")
