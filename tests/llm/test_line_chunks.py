"""Line dedup: what goes stands earlier, what repeats goes, nothing else changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import line_chunks as lc

END = re.compile(r"(?<=\n)(?=[^\n])|(?<=[^.!?\n]{16}[.!?] )(?=[^ \n])")


def cut(text):
    return END.split(text)


def sentence(rng, n=None):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n or rng.randint(4, 14))).capitalize() + rng.choice(".!?")


def prose(rng, n):
    return "".join(sentence(rng) + rng.choice([" ", " ", "\n"]) for _ in range(n)).strip()


def out_of(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = lc.remove_repeated(frame).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.text, r.n_removed) for r in rows}


def passages(rng, n):
    found = []
    while len(found) < n:
        p = " ".join(sentence(rng) for _ in range(rng.randint(6, 12)))
        if len(p.split()) > 50:
            found.append(p)
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_repeated_passages_go_and_the_rest_stays(spark, seed):
    rng = random.Random(seed)
    shared = passages(rng, 12)
    docs = []
    for i in range(150):
        text = prose(rng, rng.randint(1, 20))
        if i % 3 == 0:
            p = shared[(i // 3) % len(shared)]
            text = rng.choice([f"{text} {p}", f"{p} {text}", f"{text}\n{p}\n{prose(rng, 3)}", p])
        docs.append((i, text))
    got = out_of(spark, docs)
    for p in shared:
        held = [i for i, t in docs if p in t]
        left = [i for i in held if p in got[i][0]]
        assert held[0] in left
        assert len(left) <= 1 + len(held) // 10  # a passage without a boundary inside may stay
        for i in held[1:]:
            if i not in left:
                words = [w for w in p.split() if w in got[i][0].split()]
                assert len(words) <= 15  # lines merged with their neighbours
    for i, t in docs:
        if i % 3:
            assert got[i] == (t, 0)


@pytest.mark.parametrize("seed", [3, 4])
def test_what_goes_stands_at_an_earlier_place(spark, seed):
    """Random lines of few kinds, so that repeats overlap in every way."""
    rng = random.Random(seed)
    kinds = [sentence(rng, rng.choice([4, 6, 12, 40])) for _ in range(30)]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choices(kinds, k=rng.randint(1, 40)))) for i in range(60)]
    got = out_of(spark, docs)
    kept, removed = [], 0
    for i, t in docs:
        whole, left, at = cut(t), got[i][0], 0
        rest = []
        for piece in whole:  # the lines that stayed are the pieces of what is left, in order
            if left.startswith(piece, at):
                rest.append(piece)
                at += len(piece)
        assert at == len(left)
        assert len(whole) - len(rest) <= got[i][1] + 0
        removed += got[i][1]
        kept.append({p.strip() for p in cut(left) if left})
        for p in {p.strip() for p in whole} - kept[-1]:
            assert any(p in earlier for earlier in kept[:-1]) or p in kept[-1], (i, p)
    assert removed > 100
    # every line there was is still somewhere
    assert {p.strip() for _, t in docs for p in cut(t)} == set().union(*kept)


def test_copies_go_whole(spark):
    rng = random.Random(5)
    text = prose(rng, 30)
    got = out_of(spark, [(i, text) for i in range(40)] + [(99, prose(rng, 30))])
    assert got[0] == (text, 0) and got[99][1] == 0
    assert all(got[i][0] == "" for i in range(1, 40))


def test_common_short_lines_stay(spark):
    rng = random.Random(6)
    docs = [(i, "All rights reserved.\n" + prose(rng, 5) + "\nHome\nAbout") for i in range(50)]
    assert out_of(spark, docs) == {i: (t, 0) for i, t in docs}


def test_a_long_line_counts_alone(spark):
    rng = random.Random(7)
    line = " ".join(f"v{i}" for i in range(55))
    docs = [(i, f"{prose(rng, 4)}\n{line}\n{prose(rng, 4)}") for i in range(20)]
    got = out_of(spark, docs)
    assert line in got[0][0] and not any(line in got[i][0] for i in range(1, 20))
    for i, t in docs[1:]:
        assert got[i] == (t.replace(line + "\n", ""), 1)


def test_repeats_within_a_document(spark):
    rng = random.Random(8)
    block = " ".join(sentence(rng, 10) for _ in range(6))
    text = f"{prose(rng, 3)}\n{block}\n{prose(rng, 3)}\n{block}\n{prose(rng, 3)}"
    got = out_of(spark, [(1, text)])
    assert got[1][0].count(block) == 1 and got[1][1] >= 4
    long = "Again and again it says the very same thing here. " * 3000
    assert len(out_of(spark, [(2, long)])[2][0]) < len(long) / 100


def test_edge_cases(spark):
    rng = random.Random(9)
    text = prose(rng, 20)
    docs = [(1, text, "a", 1), (1, text, "a", 1), (None, text, "b", 2), (2, text, None, None), (3, None, "c", 3), (4, "", "d", 4), (5, "\n\n. ", "e", 5)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, id string, n_removed int")
    rows = lc.remove_repeated(frame).collect()
    got = sorted(((r.doc_id, r.text, r.id) for r in rows), key=str)
    # A null key comes first and keeps the text; rows of one key and text are one document.
    assert got == sorted(
        [(1, "", "a"), (1, "", "a"), (None, text, "b"), (2, "", None), (3, None, "c"), (4, "", "d"), (5, "\n\n. ", "e")], key=str
    )
    assert rows[0].__fields__ == ["doc_id", "text", "id", "n_removed"]
    assert lc.remove_repeated(frame.limit(0)).count() == 0


def test_pieces_are_the_text(spark):
    texts = ["a. B! c?\n\nd . e", "Seventeen letters. Nineteen letters so! x  y", "Now is the time now!! Or. Never more I say?", "\n\na", "a. ", ". . .", "é.  x\ty\n z", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in frame.select("i", lc.pieces(frame.t).alias("p")).collect():
        assert "".join(r.p) == texts[r.i] and r.p == cut(texts[r.i])


def test_passages_inside_running_text_go(spark):
    """Mid-sentence, at any word, without a sentence end in the passage or around it."""
    rng = random.Random(11)
    plain = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [plain(rng.randint(51, 120)) for _ in range(40)]
    shared += [" ".join(sentence(rng) for _ in range(30)).split()[3 : 3 + rng.randint(51, 90)] for _ in range(20)]
    shared += [[w[:1] + w[-1:] for w in plain(51)] for _ in range(5)]  # 2 letters a word
    docs, rest = [], {}
    for p in shared:
        for copy in range(3):
            before, after = plain(rng.randint(1, 90)), plain(rng.randint(1, 90))
            if copy:
                rest[len(docs)] = " ".join(before + after)
            docs.append((len(docs), " ".join(before + p + after)))
    got = out_of(spark, docs)
    for i, t in docs:
        assert got[i] == (t, 0) if i not in rest else (got[i][0] == rest[i] and got[i][1] > 0), i


def test_long_words_and_lines_without_words_go(spark):
    rng = random.Random(12)
    urls = "\n".join(f"https://host{rng.randrange(10**6)}.example.org/{rng.randrange(10**9)}" for _ in range(4))
    wide = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(80))
    docs = [(i, f"{prose(rng, 3)}\n{p}\n{prose(rng, 3)}") for i, p in enumerate([urls, urls, wide, wide])]
    got = out_of(spark, docs)
    assert got[0] == (docs[0][1], 0) and got[2] == (docs[2][1], 0)
    assert got[1] == (docs[1][1].replace(urls + "\n", ""), 4)
    assert got[3] == (docs[3][1].replace(wide + "\n", ""), 1)


def test_white_space_and_repeated_rows(spark):
    rng = random.Random(13)
    p = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    docs = [(1, " ".join(p)), (2, "\n " + "\n".join(p) + " \tx"), (3, "a  b\t" + "  ".join(p) + "\n\nc d")]
    frame = spark.createDataFrame(docs + docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text) for r in lc.remove_repeated(frame).collect())
    assert got == sorted([(1, docs[0][1]), (2, "x"), (3, "a  b\tc d")] * 2)


def test_short_phrases_of_several_documents_stay(spark):
    rng = random.Random(14)
    plain = lambda n: " ".join(f"x{rng.randrange(1000)}" for _ in range(n))
    phrases = [plain(20) for _ in range(6)]
    docs = [(i, f"{plain(30)} {p} {plain(30)}") for i, p in enumerate(phrases)]
    docs += [(50, " ".join(phrases)), (51, "\n".join(phrases[::-1]) + "\n" + plain(5))]
    assert out_of(spark, docs) == {i: (t, 0) for i, t in docs}


def test_stretches_of_two_documents_that_overlap(spark):
    rng = random.Random(15)
    w = [f"y{rng.randrange(10**6)}" for _ in range(100)]
    text = lambda *parts: " ".join(x for p in parts for x in p)
    own = [[f"z{rng.randrange(10**6)}" for _ in range(20)] for _ in range(6)]
    docs = [(0, text(own[0], w[:60], own[1])), (1, text(own[2], w[50:], own[3])), (2, text(own[4], w, own[5]))]
    got = out_of(spark, docs)
    assert got[0] == (docs[0][1], 0) and got[1] == (docs[1][1], 0)
    assert got[2][0] == text(own[4], own[5])


def repeated_at(docs, minimum=lc.MIN_WORDS):
    """Per document the places of words that any earlier place (document, then word) has with
    ``minimum - 1`` or more neighbours in a row: by looking at all windows of all texts."""
    seen, out = set(), {}
    for i, t in docs:
        words, gone = t.split(), set()
        for s in range(len(words) - minimum + 1):
            window = tuple(words[s : s + minimum])
            if window in seen:
                gone.update(range(s, s + minimum))
            seen.add(window)
        out[i] = gone
    return out


@pytest.mark.parametrize("seed", [16, 17])
def test_all_places_against_all_windows(spark, seed):
    """Words so long that 50 of them and not 150 bytes decide, so that the windows are the rule."""
    rng = random.Random(seed)
    plain = lambda n: [chr(97 + rng.randrange(26)) + chr(97 + rng.randrange(26)) for _ in range(n)]
    shared = [plain(rng.randint(30, 90)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [plain(rng.randint(5, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), plain(rng.randint(5, 60))]
        docs.append((i, " ".join(w for p in parts for w in p)))
    want, got = repeated_at(docs), out_of(spark, docs)
    for i, t in docs:
        left = [w for s, w in enumerate(t.split()) if s not in want[i]]
        assert got[i][0].split() == left, i


def test_a_few_words_again_and_again_are_one_run(spark):
    rng = random.Random(18)
    words = "one two three four five six seven eight nine ten".split()
    docs = [(n, " ".join(words[:n]) + " ") for n in range(1, 11)]
    said = dict(docs)
    docs = [(n, prose(rng, 2) + " " + t * 300 + prose(rng, 2)) for n, t in docs]
    frame = spark.createDataFrame(docs, "id bigint, text string").selectExpr("id", "xxhash64(text) AS version", "text")
    runs = lc.repeated_runs(lc.seeds(frame, "text")).filter("id <=> k_id").groupBy("id").count().collect()
    assert {r.id for r in runs} == set(range(1, 11)) and all(r["count"] <= 20 for r in runs)
    got = out_of(spark, docs)
    for n, t in docs:
        assert len(got[n][0]) < len(t) - 280 * len(said[n])


def test_many_lists_are_told_by_a_bitmap(spark, monkeypatch):
    """The same comes out where nothing is sent to every task, also with a bitmap that is full;
    documents in none of the lists are set apart before the join."""
    rng = random.Random(19)
    shared = passages(rng, 6)
    docs = [(i, f"{prose(rng, 3)} {shared[i % 6] if i % 4 == 0 else ''} {prose(rng, 3)}") for i in range(200)]
    docs += [(200 + i, docs[i][1]) for i in range(20)] + [(None, docs[30][1]), (301, None)]
    want = out_of(spark, docs)
    monkeypatch.setattr(lc, "BROADCAST_ELEMENTS", 0)
    assert out_of(spark, docs) == want
    frame = spark.createDataFrame(docs, "id bigint, text string").selectExpr("id", "xxhash64(text) AS version", "text")
    some = frame.filter("id % 10 = 3 OR id IS NULL").selectExpr("id AS _id", "version AS _version")
    for most, least in ((lc.MOST_SLOTS, 150), (1, 1)):
        monkeypatch.setattr(lc, "MOST_SLOTS", most)
        listed, may, rest = lc._parted(frame, some)
        assert may.join(listed, lc._is_in(), "left_semi").count() == some.count()
        assert may.count() + rest.count() == len(docs) and rest.count() >= least
    assert out_of(spark, docs) == want


def test_seeds_tell_every_word(spark):
    """A chunk's hash is over all of its words, so one that differs in any word is no repeat."""
    rng = random.Random(20)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(-1, " ".join(words))] + [(i, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(150)]
    frame = spark.createDataFrame(docs, "id bigint, text string").selectExpr("id", "xxhash64(text) AS version", "text")
    found = {r.id: r.seeds for r in lc.seeds(frame, "text").collect()}
    known = {s.hash for s in found.pop(-1)}
    assert len(known) > 8
    for i, seeds in found.items():
        assert not any(s.hash in known for s in seeds if s.start <= i < s.start + s.n), i


def chunk_places(hashes):
    """Where chunks open, by the rule: dips of the hashes, and dips of those."""

    def dips(places):
        at = lambda j: hashes[places[j]] if 0 <= j < len(places) else float("inf")
        return [p for j, p in enumerate(places) if at(j) <= at(j - 1) and at(j) <= at(j + 1)]

    return dips(dips(list(range(max(len(hashes) - lc.WORDS, 0) + 1))))


def test_chunks_open_by_the_rule_and_cost_no_slice_each(spark):
    rng = random.Random(21)
    texts = [[f"w{rng.randrange(k)}" for _ in range(n)] for n in [1, 2, 12, 13, 14, 15, 40, 200, 400] for k in (1, 3, 10**6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, w array<string>")
    own = frame.select("i", F.transform("w", lambda w: F.xxhash64(w)).alias("h"), lc._chunks(frame.w).alias("c"))
    for r in own.collect():
        assert [c.start for c in r.c] == chunk_places(r.h), texts[r.i]
        assert all(c.n == min(len(r.h), lc.WORDS) and c.apart is None for c in r.c)
        alike = {(tuple(r.h[c.start : c.start + c.n]), c.hash) for c in r.c}
        assert len(alike) == len({a for a, _ in alike}) == len({b for _, b in alike})
    # Array slices are made element by element outside of generated code: none for each chunk.
    assert "slice(" not in lc._chunks(frame.w)._jc.toString()


def test_lines_are_not_told_where_nothing_goes(spark):
    words = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(1, words, [(3, 9)]), (2, words, [(3, 9), (20, 70)])], "i int, text string, gone array<struct<a:int,b:int>>")
    got = dict(frame.select("i", lc._without("text", "gone")).collect())
    left = " ".join(w for n, w in enumerate(words.split()) if not 20 <= n <= 70)
    assert got[1] is None and (got[2].text, got[2].n_removed) == (left, 1)
