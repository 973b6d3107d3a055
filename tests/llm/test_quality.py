"""Quality rules: counts against Python, bounds against exact sums, the guarantee."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a\n a\na\n\n\na ", "é😀 # * $%&|<> x\x0by\x0cz\r", "w " * 9, "w " * 10, "x\xa0y z", "a b c d e " * 3]
    for _ in range(80):
        pool = [f"w{i}" for i in range(rng.choice([2, 4, 50]))]
        out.append(rng.choice([" ", "\n", "  \t"]).join(rng.choices(pool, k=rng.randint(0, 60))))
    return [*out, "one two three four five six " * 3000, " ".join(map(str, range(20_000)))]


def test_counts(spark):
    data = texts()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id int, text string")
    labels = spark.createDataFrame([], "doc_id int, quality int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(data)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        text = data[r.doc_id]
        want = brute(text) if len(text or "") < 20_000 else None
        if want is None:
            n = len(text.split())
            want = (n, len(text.replace(" ", "")), 0, 0, n if n < 20_000 else 0, n < 20_000)
        assert got == want, text and text[:60]
        assert r.kept == (not r.base_failed)


@pytest.mark.parametrize("rate", [0.01, 0.3])
def test_the_bound_is_exact(spark, rate):
    cases = [(k, float(n)) for n in (1, 7, 100, 900) for k in (0, 1, 3, 6) if k <= n]
    frame = spark.createDataFrame(cases, "k bigint, n double")
    p = Fraction(rate)
    for r in frame.select("k", "n", quality.log_at_most(F.col("k"), F.col("n"), rate).alias("l")).collect():
        n = int(r.n)
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(r.k + 1))
        assert math.isclose(math.exp(r.l), float(exact), rel_tol=1e-9)


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 90))]
        if not good:
            words = [w + "&&&" for w in words]
        elif rng.random() < 0.002:
            words = [w + "#" for w in words]  # good texts that look bad
        docs.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return docs, labels


def test_cutoffs_reject_the_bad_and_keep_the_good(spark):
    docs, labels = corpus(6000, 2)
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    rows = quality.judge(frame, known).collect()
    bad = [r for r in rows if r.doc_id % 5 == 0]
    good = [r for r in rows if r.doc_id % 5 > 0]
    assert all("symbols" in r.rejected_by and not r.kept for r in bad)
    assert sum(not r.kept for r in good) <= quality.LIMIT * len(good)


def test_a_cutoff_holds_only_if_the_bound_does(spark):
    docs, labels = corpus(6000, 3)
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    counted = quality.counts(spark.createDataFrame(docs, "doc_id int, text string")).persist()
    row = quality.cutoffs(counted, known).first()
    held = counted.filter("NOT base_failed AND key % 5 > 0").select("features.*").collect()
    share = Fraction(quality.LIMIT / len(quality.GRID))
    level = quality.ALPHA / (sum(map(len, quality.GRID.values())) * (len(quality.BANDS) + 1))
    for rule, grid in quality.GRID.items():
        fits = []
        for c in grid:
            n, k = len(held), sum(r[rule] > c for r in held)
            if k <= n * share and float(sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1))) <= level:
                fits.append(c)
        assert row.cutoff[rule] == (min(fits) if fits else None)


def test_edge_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(1, text, True), (1, text, True), (None, text, None), (2, None, None)]
    frame = spark.createDataFrame(docs, "doc_id int, text string, kept boolean")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id int, quality int")
    got = sorted((r.doc_id or 0, r.n_words, r.kept) for r in quality.judge(frame, labels).collect())
    assert got == [(0, 30, True), (1, 30, True), (1, 30, True), (2, 0, False)]
    assert quality.judge(frame.limit(0), labels).count() == 0


def test_the_chain_ends_at_the_first_setting_that_fails(spark):
    docs, labels = corpus(3000, 5)
    # Good texts of which ever more look bad at stricter settings, in one band.
    rng = random.Random(6)
    docs += [(10_000 + i, " ".join(["w#"] * rng.randrange(12) + [f"v{rng.randrange(9999)}" for _ in range(60)])) for i in range(400)]
    labels += [(10_000 + i, 1) for i in range(400)]
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    counted = quality.counts(spark.createDataFrame(docs, "doc_id int, text string")).persist()
    [row] = quality.chained_cutoffs(counted, known).collect()
    good = [i for i, y in labels if y]
    held = {r.key: r.features for r in counted.filter("NOT base_failed").collect() if r.key in set(good)}
    p, last = Fraction(quality.LIMIT), -1
    for i in range(8):
        n, k = len(held), sum(any(f[r] > c[i] for r, c in quality.GRID.items()) for f in held.values())
        if k > n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > quality.ALPHA / 4:
            break
        last = i
    assert 0 <= last < 7
    assert row.cutoff.asDict() == {r: c[last] for r, c in quality.GRID.items()}


def test_copies_are_one_trial(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(i, text) for i in range(1000)]
    counted = quality.counts(spark.createDataFrame(docs, "doc_id int, text string"))
    known = spark.createDataFrame([(i, 1) for i in range(1000)], "doc_id int, quality int")
    [row] = quality.chained_cutoffs(counted, known).collect()
    assert set(row.cutoff.asDict().values()) == {None}
    assert set(quality.cutoffs(counted, known).first().cutoff.asDict().values()) == {None}


def test_the_risk_is_kept_in_a_simulation(spark):
    """Strata whose true share of good texts above a cutoff is just over the limit: no more than
    alpha of them may be certified."""
    rng = random.Random(7)
    trials, n = 400, 120
    sums = [(t, n, sum(rng.random() < 1.001 * quality.LIMIT for _ in range(n))) for t in range(trials)]
    frame = spark.createDataFrame(sums, "t int, n int, k int")
    bound = quality.log_at_most(F.col("k"), F.col("n").cast("double"), quality.LIMIT)
    certified = frame.filter(bound <= math.log(quality.ALPHA / 4)).count()
    assert certified <= trials * quality.ALPHA
    # 86 good texts without a rejection are enough, 85 are not.
    few = spark.createDataFrame([(0, 86), (0, 87)], "k int, n int")
    level = math.log(quality.ALPHA / 4)
    got = {r.n: r.l <= level for r in few.select("n", quality.log_at_most(F.col("k"), F.col("n").cast("double"), quality.LIMIT).alias("l")).collect()}
    assert got == {86: math.log(0.95) * 86 <= level, 87: math.log(0.95) * 87 <= level} and got[87]
