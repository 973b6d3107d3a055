"""Secrets: base spans against Python's expressions, linked parts by planted credentials."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.llm import secrets, spans

ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ORDER = {"assign": 0, "access": 1, "hex": 2}


def brute(text):
    text = text or ""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], ORDER[x[1]]))]


TEXTS = [
    None, "", "token=abcdef", "TOKEN = 'abcdef'", 'api_key":"a.b-c=d/e+f_"', "apikey :: x", "secret=abc token=abcdefg",
    "token=token=abcdef", "passwordpassword: hunter2hunter2", "passwd\t=abcdefgh", "tokKen=abcdefg", "ſecret=abcdefg",
    "AKIA" + "A1" * 8, "AKIA" + "A1" * 7, "AKIAAKIA" + "Z" * 20, "é😀AKIA" + "Q" * 30 + " " + "0a" * 12, "f" * 23, "f" * 24 + "G",
    "abcdef0123456789abcdef012 " * 3, "token = " + "a" * 24, "token" * 5000, "token" + " " * 5000, "secret=" + "x" * 100_000, "0" * 100_000,
    "password=\nabcdef", "password='" + "abc\"def", "api-key=abcdefg", "API_KEY=abc",
]


def digests(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in secrets.digest(secrets.find_secrets(docs)).collect()}


def test_base_spans(spark):
    got = digests(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        counts = [sum(w.startswith(k + ":") for w in want) for k in ORDER]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts, text and text[:80]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["token", "Secret", "=", ":", " ", "'", "abcdef", "AKIA", "QQQQQQQQ", "0f" * 6, "é", "\n", "api_", "key"]), max_size=14).map("".join), min_size=200, max_size=200))
def test_base_spans_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in docs.select("doc_id", spans.joined(secrets.base_spans(docs.text)).alias("s")).collect():
        assert r.s == ",".join(brute(texts[r.doc_id]))


SECRET = "aB3dE6gH9jK2mN5pQ8sT1v"


def test_parts_count_only_together(spark):
    far = "x " * 150
    texts = [
        f"client_id: shop-77 and {SECRET} here",
        f"client_id: shop-77 {far} {SECRET} here",
        "client_id: shop-77 alone",
        f"{SECRET} alone",
        f"endpoint=https://api.example.com/v1 {SECRET}",
        "see https://api.example.com/v1 token=abcdefgh",
        "see https://api.example.com/v1 only",
        f"AKIAABCD and {SECRET}",
        f"{SECRET} {SECRET}x",
        "account_name=bob password: hunter22",
    ]
    got = digests(spark, texts)
    added = {i: set(got[i].spans.split(",")) - set(brute(t)) - {""} for i, t in enumerate(texts)}
    at = lambda i, part, kind: f"{kind}:{texts[i].index(part)}:{texts[i].index(part) + len(part)}"
    assert {i: a for i, a in added.items() if a} == {
        0: {at(0, "client_id: shop-77", "identifier"), at(0, SECRET, "secret")},
        5: {at(5, "https://api.example.com/v1", "endpoint")},
        7: {at(7, "AKIAABCD", "identifier"), at(7, SECRET, "secret")},
        9: {at(9, "account_name=bob", "identifier")},
    }


def test_the_interval_join_finds_every_pair(spark):
    rng = random.Random(2)
    kinds = [*secrets.BASE_KINDS, *secrets.PART_KINDS]
    parts = set()
    for _ in range(400):
        start = rng.randrange(3000)
        parts.add((rng.choice([1, 2, None]), 0, start, start + rng.choice([3, 40, 900]), rng.choice(kinds)))
    frame = spark.createDataFrame(sorted(parts, key=str), "key bigint, version bigint, start int, end int, kind string")
    role = lambda k: {"access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}.get(k, "secret")

    def wanted(a, b):
        if role(a) == "endpoint":
            return b in secrets.BASE_KINDS
        return {role(a), role(b)} == {"identifier", "secret"}

    want = {
        (*a, b[4], b[2], b[3])
        for a in parts
        for b in parts
        if a[0] == b[0] and wanted(a[4], b[4]) and 0 <= max(a[2], b[2]) - min(a[3], b[3]) <= 50
    }
    rows = secrets.linked_parts(frame, 50).collect()
    assert {tuple(r) for r in rows} == want and want


def test_rows_stay_as_they_are(spark):
    docs = spark.createDataFrame(
        [(1, "token=abcdef", "x"), (1, "token=abcdef", "x"), (None, "token=abcdef", "x"), (None, None, None)], "doc_id bigint, text string, parts string"
    )
    got = sorted(r.spans for r in secrets.digest(secrets.find_secrets(docs)).collect())
    assert got == ["", "assign:0:12", "assign:0:12", "assign:0:12"]
    assert secrets.digest(secrets.find_secrets(docs.limit(0))).count() == 0


def test_a_text_full_of_parts(spark):
    text = " ".join(f"client_id=user{i} {SECRET}{i}" for i in range(3000))
    row = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string"))).first()
    assert row.spans.count("secret:") == 3000


def test_spans_of_many_matches(spark):
    """Offsets are right beyond the width of a block of sums."""
    text = "é0 " * 5000
    docs = spark.createDataFrame([(text,)], "text string")
    found = docs.select(spans.matches(F.col("text"), "[0-9]", context=True).alias("m")).first().m
    assert [(m.start, m.end, m.value) for m in found] == [(3 * i + 1, 3 * i + 2, "0") for i in range(5000)]
    assert found[1].left == " é" and found[1].right == " é"


def test_an_endpoint_beside_a_weak_credential_is_reported(spark):
    url = "https://api.example.com/v1"
    far = "word " * 400
    texts = [
        f"client_id: shop-77 {url} {SECRET}",
        f"client_id: shop-77 {SECRET} {far} {url}",
        f"{url} {SECRET}",
        f"{url} client_id: shop-77",
    ]
    got = digests(spark, texts)
    kinds = {i: sorted(x.split(":")[0] for x in got[i].spans.split(",") if x) for i in range(len(texts))}
    assert kinds == {0: ["endpoint", "identifier", "secret"], 1: ["identifier", "secret"], 2: [], 3: []}
