"""Run queries beside their SQL and compare by value.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from scoreloom import session

TABLES = "documents events conversations labels pages benchmark embeddings".split()


def spark_session(cores: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scoreloom-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    spark = session.configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float):
        return repr(v + 0.0)
    return repr(v)


def differences(spark, con, sf_dir, fn, sql) -> list[str]:
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return [f"columns {names} against {sorted(rel.columns)}"]
    at = [rel.columns.index(n) for n in names]
    want = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        types = dict(zip(rel.columns, map(str, rel.types)))
        odd = [f"{n}: {t} against {types[n]}" for n, t in df.dtypes if not _same_type(t, types[n])]
        return odd or ([] if got else ["no rows"])
    out = [f"{len(got)} rows against {len(want)}"]
    pairs = [(g, w) for g, w in zip(got, want) if g != w]
    out += [f"  spark {str(g)[:300]}\n  duck  {str(w)[:300]}" for g, w in pairs[:2]]
    return out


def _same_type(spark_type: str, duck_type: str) -> bool:
    known = {
        "string": {"VARCHAR", "JSON"},
        "bigint": {"BIGINT"},
        "int": {"INTEGER"},
        "double": {"DOUBLE"},
        "boolean": {"BOOLEAN"},
    }
    return duck_type in known.get(spark_type, {duck_type})


def main(argv: list[str]) -> int:
    from .oracle import ORACLE
    from .queries import QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = spark_session(), duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = (
                differences(spark, con, sf_dir, QUERIES[name], ORACLE[name])
                if name in ORACLE
                else ["no oracle"]
            )
        except Exception as error:  # a broken query must not hide the others
            problems = [str(error)[:1500]]
        failed += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - start:.1f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
