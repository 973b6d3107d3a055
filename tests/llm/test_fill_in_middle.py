"""Fill-in-middle against plain Python, and back to the text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scoreloom.llm.fill_in_middle import digest, fill_in_middle, restored

SENTINELS = ("<P>", "<S>", "<M>")


def brute(key, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * j : 8 * j + 8], 16) for j in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in SENTINELS) or h[2] % 100 >= 90:
        return len(units), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def corpus(seed, n=400):
    rng = random.Random(seed)
    letters = "abcXYZ 09.\n\t\x00\x7f\x80é日😀́<P>SM"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "a<P>b"), (n + 3, "<<S>"), (None, "some words here"), (7, "again")]
    docs += [(7, "again"), (n + 4, "word " * 60_000 + "日" * 50_000), (n + 5, "x" * 100_000), (n + 6, "<P<S>")]
    return docs


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain_python(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    made = fill_in_middle(frame).withColumn("back", restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert len(rows) == len(docs)
    for r in rows:
        got = (r.n, r.form, r.output, r.prefix_chars, r.middle_chars)
        assert got == brute(r.doc_id, r.text) and r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_shares_of_the_forms(spark):
    frame = spark.range(20_000).selectExpr("id AS doc_id", "'one two three four' AS text")
    counts = {r.form: r["count"] for r in fill_in_middle(frame).groupBy("form").count().collect()}
    assert counts["plain"] == pytest.approx(2000, rel=0.1)
    assert counts["spm"] == pytest.approx(3600, rel=0.1)


def test_parameters(spark):
    frame = spark.range(50).selectExpr("id AS doc_id", "'one two' AS text")
    assert {r.form for r in fill_in_middle(frame, cut=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(frame, cut=100, suffix_first=100).collect()} == {"spm"}


def test_empty_tables_and_clashing_names(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert digest(fill_in_middle(frame)).collect() == []
    frame = spark.createDataFrame([(1, "a b c", 5, "x", "y")], "doc_id int, text string, n int, h1 string, output string")
    [r] = fill_in_middle(frame).collect()
    assert (r.n, r.form, r.output) == brute(1, "a b c")[:3] and (r.h1, r.text) == ("x", "a b c")


def test_digest_holds_hashes_of_output_and_text(spark):
    frame = spark.createDataFrame([(3, "ein Text"), (4, None)], "doc_id bigint, text string")
    for r in digest(fill_in_middle(frame)).collect():
        text = "ein Text" if r.doc_id == 3 else ""
        assert r.output_sha256 == hashlib.sha256(brute(r.doc_id, text)[2].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
