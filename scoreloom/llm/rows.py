"""What the operators of this subpackage share: tables, words, whole rows through Arrow."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch that a task holds as Python objects.
PIECE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def fold(key: Column, modulus: int) -> Column:
    """CRC-32 of a key written as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the code that runs there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix=f"{package.name}-")) / f"{package.name}.zip"
    with zipfile.ZipFile(to, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def through_arrow(
    df: DataFrame,
    inputs: dict[str, Column | str],
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]],
    outputs: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Run ``work`` over the partitions of ``df`` and add its columns to the kept ones.

    ``work`` sees batches with the columns ``inputs`` only and yields, for each
    batch in turn, one array per column of ``outputs`` (a DDL string). The kept
    columns (all unless named) travel beside them under positional names, so that
    no name can clash; an output replaces a kept column of its name. An input that
    is given by its name is not sent a second time where that column is kept.
    """
    ship(df.sparkSession)
    made = StructType.fromDDL(outputs)
    keep = [c for c in (df.columns if keep is None else keep) if c not in made.names]
    kept = [df[c].alias(f"_k{i}") for i, c in enumerate(keep)]
    at = {n: len(kept) + i for i, n in enumerate(x for x, c in inputs.items() if not isinstance(c, str) or c not in keep)}
    sent = ((df[c] if isinstance(c, str) else c).alias(f"_i{i}") for i, c in enumerate(inputs[n] for n in at))
    given = df.select(*kept, *sent)
    schema = StructType(given.schema.fields[: len(kept)] + [
        f.__class__(f"_o{i}", f.dataType, True) for i, f in enumerate(made.fields)
    ])
    names, n_kept, n_made = list(inputs), len(kept), len(made.fields)
    places = [at[n] if n in at else keep.index(c) for n, c in inputs.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, PIECE):
                    piece = batch.slice(start, PIECE)
                    waiting.append(piece.select(range(n_kept)))
                    columns = [piece.column(i) for i in places]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        for arrays in work(seen()):
            beside = waiting.pop(0)
            yield pa.RecordBatch.from_arrays(
                [*beside.columns, *arrays],
                names=[*beside.schema.names, *(f"_o{i}" for i in range(n_made))],
            )

    out = given.mapInArrow(run, schema)
    return out.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
        *(F.col(f"_o{i}").alias(f.name) for i, f in enumerate(made.fields)),
    )
