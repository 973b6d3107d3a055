"""Personal data: base spans against Python's expressions, found ones by planted contexts."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind in pii.KINDS
        for m in re.finditer(PLAIN[kind], text or "")
        if valid(kind, m[0])
    ]


TEXTS = [
    None, "", " ", "a@b.c", "a@b.c@d.e", "a@b.c_d@e.fr x", "@b.c", "a@b", "a@b..c", "é.a@b-.c.d.",
    "ç😀 a.b+c%d@mail-1.example.com, x", "1.2.3.4", "256.1.1.1", "001.02.255.0", "1.2.3.4.5.6.7.8", "0000000255.1.1.1",
    "1.2.3", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467 4539148803436468", "4539  1488 0343 6467",
    "0" * 13, "0" * 12, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 8", "+1 (743) 555-3824", "+1", "+12", "+1 2", "+123456789+123456789",
    "+1 (743) 555-3824-", "++1 743 555 3824..", "+1234567890123456", "tel +49 30 1234567.\n+1 1", "a@b.c" * 40,
    "1.1.1.1" + " 2.2.2.2" * 50, "x" * 300_000 + "@" + "y" * 1000 + ".z", "5" * 100_000, "@" * 5000, "1." * 3000, "+1" * 3000,
]


def digests(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in pii.digest(pii.find_personal_data(docs)).collect()}


def test_base_spans(spark):
    got = digests(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = brute(text)
        counts = [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == counts, text and text[:80]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(","))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0159+-. ()@ab", max_size=60), min_size=200, max_size=200))
def test_base_spans_of_random_texts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    from scoreloom.llm import spans

    got = docs.select("doc_id", spans.joined(pii.base_spans(docs.text)).alias("s")).collect()
    for r in got:
        assert r.s == ",".join(brute(texts[r.doc_id]))


GOOD = ["4539148803436467", "4716461583322103", "4929000000006", "5105105105105100", "4111111111111111"]


def test_contexts_of_known_ones_find_unseen_ones(spark):
    docs = [f"please charge card {c} today" for c in GOOD]
    docs += [f"please charge card {c} today" for c in GOOD]  # copies add nothing
    docs.append("please charge card 4539148803436460 today")  # wrong check digit
    docs.append("order 4539148803436461 shipped")  # the same form in another context
    docs += [f"call me at +1 202 555 01{i}0 now" for i in range(5)]
    docs += ["call me at 202 555 0199 now", "version 202 555 0198 built", "call me at 1.2.3.4 now"]
    got = digests(spark, docs)
    added = {i: set(got[i].spans.split(",")) - set(brute(t)) - {""} for i, t in enumerate(docs)}
    assert {i: a for i, a in added.items() if a} == {10: {"card:19:35"}, 17: {"phone:11:23"}}


def test_too_few_known_ones_find_nothing(spark):
    docs = [f"charge card {c}" for c in GOOD[: pii.SUPPORT - 1]] + ["charge card 4539148803436460"]
    got = digests(spark, docs)
    assert [r.spans for r in got.values()] == [",".join(brute(t)) for t in docs]


def test_rows_stay_as_they_are(spark):
    docs = spark.createDataFrame(
        [(1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (1, "other", "x", 1), (None, "a@b.c", "x", 1), (None, None, None, None)],
        "doc_id bigint, text string, base string, version int",
    )
    got = sorted(r.spans for r in pii.digest(pii.find_personal_data(docs)).collect())
    assert got == ["", "", "email:0:5", "email:0:5", "email:0:5"]
    assert pii.digest(pii.find_personal_data(docs.limit(0))).count() == 0


@pytest.mark.parametrize("turns", [1, 2, 5])
def test_scores_follow_their_definition(spark, turns):
    edges = [("k", f"p{p}", f"i{i}") for p in range(6) for i in range(20) if (i * 7 + p * 3) % 5 < 2]
    state = {f"i{i}": 1 if i < 8 else -1 if i > 16 else 0 for i in range(20)}
    frame = spark.createDataFrame([(*e, state[e[2]]) for e in edges], "kind string, pattern string, instance string, state int")
    trust = {i: float(s == 1) for i, s in state.items()}
    best = {}
    for _ in range(turns):
        score = {}
        for p in {e[1] for e in edges}:
            own = [trust[e[2]] for e in edges if e[1] == p]
            if sum(own) >= 2:
                score[p] = sum(own) / (len(own) + 1)
        best = {}
        for _, p, i in edges:
            if state[i] == 0 and p in score:
                best[i] = max(best.get(i, 0), score[p])
        trust = {i: best.get(i, 0.0) if s == 0 else trust[i] for i, s in state.items()}
    got = {r.instance for r in pii.score_instances(frame, 2, 0.4, turns).collect()}
    assert got == {i for i, b in best.items() if b >= 0.4}
