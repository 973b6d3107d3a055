"""Secrets: base patterns, and weak parts of a credential that stand near each other.

Base patterns find assigned passwords and tokens, access keys and long hexadecimal
strings. A credential often comes in parts, each too weak to report alone: an identifier
(a client or account name, a short access key), a secret (a long mixed string) and an
endpoint. Parts are intervals of a text. Two parts are in one scope if at most ``scope``
code points lie between them; an interval join by cells of that width finds those pairs.
An identifier is reported with a secret in scope, a secret with an identifier in scope, and
an endpoint with an access key, an assigned secret, a hexadecimal string, or an identifier or
secret that is reported, in scope. What touches a base match is that match and is not reported again.

All of it is column expressions and one join. A cell holds at most as many parts as fit
into its width, so neither a long text nor a text full of parts makes a large group.

Defined cases: a null text is empty and has no spans. Rows with the same key and text are
one document to the join; each gives one row. A null key is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written

from . import spans

BASE_KINDS = ("assign", "access", "hex")
PART_KINDS = ("identifier", "secret", "endpoint")
SCOPE = 200

_NAME = r"(?i:password|passwd|secret|token|api_?key)"
#: The contract's patterns, written so that no start in a run is tried twice.
ASSIGN = _NAME + r"""["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

#: Weak parts; the group is the part itself.
IDENTIFIER = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{4,}+"
    r"|(?i:client|account|user|access_?key)[_-]?+(?i:id|name)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.@-]{3,}+)"
)
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = (
    r"(?<![A-Za-z0-9])(?:(?i:https?)://[^\s\"'<>]++"
    r"|(?i:host|endpoint|server)[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9.:/_-]{4,}+)"
)


def _as(kind: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


def base_spans(text: Column) -> Column:
    """Valid base matches by start, then kind as listed."""
    assign = F.filter(spans.matches(text, ASSIGN, 1), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(spans.matches(text, ACCESS), lambda s: s["end"] - s["start"] >= 20)
    found = {"assign": assign, "access": access, "hex": spans.matches(text, HEX)}
    return in_order(F.concat(*(_as(kind, s) for kind, s in found.items())))


def part_spans(text: Column) -> Column:
    found = {"identifier": IDENTIFIER, "secret": SECRET, "endpoint": ENDPOINT}
    return F.concat(*(_as(kind, spans.matches(text, p)) for kind, p in found.items()))


def in_order(found: Column) -> Column:
    """By start, then kind as listed (weak parts last), then end."""
    kinds = F.array(*(F.lit(k) for k in (*BASE_KINDS, *PART_KINDS)))
    keyed = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(kinds, s["kind"]).alias("nth"),
            s["end"].alias("end"),
            s["kind"].alias("kind"),
        ),
    )
    return F.transform(
        F.array_sort(keyed),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Pairs of complementary parts in one scope, seen from the first.

    ``parts`` has ``key``, ``version``, ``start``, ``end``, ``kind``, once each. Returns
    those columns with ``other_kind``, ``other_start`` and ``other_end``.
    """
    cell = lambda place: F.floor(place / F.lit(scope)).cast("int")
    near = F.explode(F.sequence(cell(F.col("start") - scope), cell(F.col("end") + scope)))
    left = parts.withColumn("cell", near)
    at = F.explode(F.array_distinct(F.array(cell(F.col("start")), cell(F.col("end")))))
    right = parts.select(
        F.col("key").alias("o_key"),
        F.col("version").alias("o_version"),
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.col("kind").alias("other_kind"),
        at.alias("o_cell"),
    )
    role = lambda k: F.when(F.col(k).isin("access", "identifier"), "identifier").when(
        F.col(k) == "endpoint", "endpoint"
    ).otherwise("secret")
    gap = F.greatest("start", "other_start") - F.least("end", "other_end")
    wanted = (
        ((role("kind") == "identifier") & (role("other_kind") == "secret"))
        | ((role("kind") == "secret") & (role("other_kind") == "identifier"))
        | ((role("kind") == "endpoint") & F.col("other_kind").isin(*BASE_KINDS))
    )
    same = (
        F.col("key").eqNullSafe(F.col("o_key"))
        & (F.col("version") == F.col("o_version"))
        & (F.col("cell") == F.col("o_cell"))
    )
    return left.join(right, same & wanted & gap.between(0, scope)).select(
        *parts.columns, "other_kind", "other_start", "other_end"
    )


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE
) -> DataFrame:
    """One row per document: ``key``, ``base`` and ``added`` spans (start, end, kind)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(whole).alias("version"),
        base_spans(whole).alias("base"),
        part_spans(whole).alias("parts"),
    )
    alone = F.filter(
        "parts",
        lambda p: ~F.exists("base", lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])),
    )
    found = written(found.withColumn("parts", alone), "secrets")
    kinds = F.array_union(F.transform("base", lambda s: s["kind"]), F.transform("parts", lambda s: s["kind"]))
    parts = (
        found.filter((F.size("parts") > 0) & (F.size(kinds) > 1))
        .select("key", "version", F.explode(F.concat("base", "parts")).alias("p"))
        .select("key", "version", "p.*")
        .distinct()
    )
    parts = written(parts, "credential-parts")
    linked = linked_parts(parts, scope).filter(F.col("kind").isin(*PART_KINDS))
    linked = written(linked.select(*parts.columns).distinct(), "linked-parts")
    # A weak identifier or secret that has its complement counts as a match for endpoints.
    weak = linked.filter("kind != 'endpoint'").withColumn("kind", F.lit(BASE_KINDS[0]))
    endpoints = parts.filter("kind = 'endpoint'")
    beside = linked_parts(weak.distinct().unionByName(endpoints), scope).filter("kind = 'endpoint'")
    added = (
        linked.unionByName(beside.select(*parts.columns))
        .groupBy(F.col("key").alias("_key"), F.col("version").alias("_version"))
        .agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    )
    same_row = F.col("key").eqNullSafe(F.col("_key")) & (F.col("version") == F.col("_version"))
    none = F.filter("base", lambda _: F.lit(False))
    return found.join(added, same_row, "left").select(
        F.col("key").alias(key), "base", F.coalesce("added", none).alias("added")
    )


def digest(found: DataFrame) -> DataFrame:
    count = {k: F.size(spans.of_kind(F.col("base"), k)).cast("bigint") for k in BASE_KINDS}
    return found.select(
        "doc_id",
        *(n.alias(f"n_{k}") for k, n in count.items()),
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(in_order(F.concat("base", "added"))).alias("spans"),
    )
