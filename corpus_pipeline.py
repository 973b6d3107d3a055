"""The corpus pipeline: raw documents to a mix of training documents.

Each stage takes the documents that the one before it kept, whatever columns they have, and
returns them with the same columns, less the rows it drops: toxic documents; repeated lines,
and the documents that held nothing else; all but one document of each group of near
duplicates; documents contaminated by a benchmark. The last returns one row per document
with the words that the mix takes of it. Empty tables pass through all stages. Null texts
are kept up to the mix, which takes nothing of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import decontaminate, line_chunks, mixing, near_dedup, rows, toxicity
from scoreloom.session import written

#: Rows of (key, hash) that may be sent to every task, about 8 MB.
BROADCAST_ROWS = 200_000


def _apart(docs: DataFrame, made: Iterable[str]) -> DataFrame:
    """The documents with columns renamed that share a name with what a stage makes."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in made})


def _back(found: DataFrame, docs: DataFrame, made: Iterable[str]) -> DataFrame:
    return found.select(*(F.col(f"_own_{c}" if c in made else c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = rows.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, rows.fold(F.col("_key"), 5) != 0)
    made = ("score", "predicted")
    return _back(toxicity.score(_apart(docs, made), model).filter("predicted = 0"), docs, made)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("n_removed",)
    found = line_chunks.remove_repeated(_apart(docs, made))
    left = found.filter((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        cut = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, cut).otherwise(F.col("n_chars")))
    return _back(left, docs, made)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document that is first by id (nulls last) and hash of the text stays.
    Rows that repeat an id and its text are one document, and texts that differ are several."""
    found = near_dedup.grouped(docs.select("doc_id", "text"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_version").alias("_is"), "_component")
    found = written(found, "near-duplicates")
    same = F.col("_id").eqNullSafe(F.col("_first._id")) & (F.col("_is") == F.col("_first._is"))
    by = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_is")
    first = found.filter("_component IS NOT NULL").groupBy("_component").agg(F.min(by).alias("_first"))
    dropped = found.join(first.hint("rebalance"), "_component").filter(~same).select("_id", "_is").distinct()
    dropped = written(dropped, "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    own = docs.withColumn("_text_version", F.xxhash64("text"))
    is_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_version") == F.col("_is"))
    left = own.join(dropped, is_row, "left_anti")
    # Without an id and words nothing says that two rows are one document.
    again = found.filter("_id IS NOT NULL OR _component IS NOT NULL")
    again = again.groupBy("_id", "_is").count().filter("count > 1").select("_id", "_is")
    again = written(again, "repeated-rows")
    if again.isEmpty():
        return left.drop("_text_version")
    # Of rows that are one document, the first by all columns stays.
    once = left.join(again, is_row, "left_semi").groupBy("doc_id", "_text_version").agg(
        F.min(F.struct(*docs.columns)).alias("_row")
    )
    rest = left.join(again, is_row, "left_anti").drop("_text_version")
    return rest.unionByName(once.select(*(F.col("_row")[c].alias(c) for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = ("n_words", "items", "spans", "n_hit", "contaminated")
    benchmark = rows.table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(_apart(docs, made), benchmark)
    return _back(found.filter("NOT contaminated"), docs, made)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Training a model is no SQL: the pipeline is tested against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = rows.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs, name), sf_dir)
    return docs
