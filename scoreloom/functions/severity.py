"""Severity base scores by the public v3.1 base equations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the public standard: metric weights and the optional metrics a
# vector may carry besides the eight that make up the base score.
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
PRIVILEGES_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
BASE_METRICS = ("AV", "AC", "PR", "UI", "S", "C", "I", "A")
METRIC_VALUE = (
    "(?:AV:[NALP]|AC:[LH]|PR:[NLH]|UI:[NR]|S:[UC]|[CIA]:[NLH]"
    "|E:[XUPFH]|RL:[XOTWU]|RC:[XURC]|[CIA]R:[XLMH]"
    "|MAV:[XNALP]|MAC:[XLH]|MPR:[XNLH]|MUI:[XNR]|MS:[XUC]|M[CIA]:[XNLH])"
)


def _weight(value: Column, weights: dict[str, float]) -> Column:
    return reduce(
        lambda chain, item: chain.when(value == item[0], F.lit(item[1])),
        weights.items(),
        F,
    )


def _round_up(score: Column) -> Column:
    """Smallest tenth not below the score, on hundred-thousandths."""
    n = F.round(score * 100000).cast("long")
    return F.when(n % 10000 == 0, n / 100000.0).otherwise((F.floor(n / 10000.0) + 1) / 10.0)


def with_base_score(df: DataFrame, vector: str, out: str) -> DataFrame:
    """Add the base score of a vector column; null where the vector is not valid.

    Works in three projections, so each metric is taken out of the text once.
    """
    body, parts, ok = f"_{out}_body", f"_{out}_parts", f"_{out}_ok"
    keys = {m: f"_{out}_{m}" for m in BASE_METRICS}
    df = df.withColumn(body, F.regexp_replace(F.col(vector), r"^CVSS:3\.[01]/", ""))
    df = df.withColumns(
        {
            parts: F.transform(F.split(body, "/"), lambda p: F.substring_index(p, ":", 1)),
            ok: F.col(body).rlike(rf"^{METRIC_VALUE}(?:/{METRIC_VALUE})*\z"),
            **{k: F.regexp_extract(body, rf"(?:^|/){m}:([A-Z])", 1) for m, k in keys.items()},
        }
    )
    col = {m: F.col(k) for m, k in keys.items()}
    changed = col["S"] == "C"
    iss = 1 - (1 - _weight(col["C"], IMPACT)) * (1 - _weight(col["I"], IMPACT)) * (
        1 - _weight(col["A"], IMPACT)
    )
    impact = F.when(
        changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))
    ).otherwise(6.42 * iss)
    exploitability = (
        8.22
        * _weight(col["AV"], ATTACK_VECTOR)
        * _weight(col["AC"], ATTACK_COMPLEXITY)
        * F.when(changed, _weight(col["PR"], PRIVILEGES_CHANGED)).otherwise(
            _weight(col["PR"], PRIVILEGES_UNCHANGED)
        )
        * _weight(col["UI"], USER_INTERACTION)
    )
    df = df.withColumns({f"_{out}_imp": impact, f"_{out}_exp": exploitability})
    total = F.col(f"_{out}_imp") + F.col(f"_{out}_exp")
    raw = F.least(F.lit(10.0), F.when(changed, total * 1.08).otherwise(total))
    complete = reduce(lambda a, b: a & b, [c != "" for c in col.values()])
    no_repeats = F.size(F.array_distinct(F.col(parts))) == F.size(F.col(parts))
    score = F.when(
        F.col(ok) & complete & no_repeats,
        F.when(F.col(f"_{out}_imp") <= 0, F.lit(0.0)).otherwise(_round_up(raw)),
    )
    scratch = [body, parts, ok, f"_{out}_imp", f"_{out}_exp", *keys.values()]
    return df.withColumn(out, score).drop(*scratch)
