import random


from scoreloom.operators import conversations as C
from scoreloom.operators import ordered

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def gapped(seed=3):
    """Conversations of which one is long, with gaps between turns."""
    rng = random.Random(seed)
    out = []
    for conv, length in ((1, 60), (2, 4), (3, 1), (4, 17)):
        turns = sorted(rng.sample(range(length * 3), length))
        for t in turns:
            out.append((conv, t, rng.choice(["user", "assistant"]), f"{conv}-{t}"))
    return out


def test_next_row_is_the_same_with_and_without_blocks(spark):
    df = frame(spark, gapped())
    whole = ordered.with_next(df, "conv_id", "turn", ["role", "text"])
    for size in (2, 5, 16):
        blocks = ordered.with_next(df, "conv_id", "turn", ["role", "text"], size)
        assert blocks.columns == whole.columns
        assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))


def test_position_is_the_same_with_and_without_blocks(spark):
    df = frame(spark, gapped() + [(5, -1, "system", "s"), (5, 0, "user", "u"), (5, 900, "user", "v")])
    whole = ordered.number_in_order(df, "conv_id", "turn", "n")
    for size in (2, 5, 16):
        blocks = ordered.number_in_order(df, "conv_id", "turn", "n", size)
        assert rows_of(blocks, "conv_id", "turn", "n") == rows_of(whole, "conv_id", "turn", "n")
    assert max(r.n for r in whole.where("conv_id = 1").collect()) == 59


def test_long_conversations_pair_and_drop_alike(spark):
    df = frame(spark, gapped(9))
    for job in (C.prompt_completion_pairs, C.drop_unanswered_turns):
        assert sorted(map(str, job(df, 4).collect())) == sorted(map(str, job(df).collect()))


def test_history_is_whole_at_any_length(spark):
    data = gapped() + [(7, t, ["user", "assistant"][t % 2], f"7-{t}") for t in range(1, 521)]
    data.append((7, 0, "system", "s"))
    df = frame(spark, data)
    seen = C.history_at_turn(df).collect()
    assert len(seen) == sum(1 for r in data if r[2] == "user")
    for r in seen:
        want = [x[3] for x in sorted(data) if x[0] == r.conv_id and x[1] <= r.turn]
        assert [m.text for m in r.messages] == want
    assert max(len(r.messages) for r in seen) == 521


def test_history_blocks_hold_every_message_once(spark):
    data = gapped()
    got = [m.text for r in C.history_blocks(frame(spark, data), 8).collect() for m in r.messages]
    assert sorted(got) == sorted(r[3] for r in data)


def test_system_turn(spark):
    df = frame(spark, [(1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", "b")])
    got = rows_of(C.inject_system_turn(df, "hello"), "conv_id", "turn", "role", "text")
    assert got == [
        (1, -1, "system", "hello"), (1, 0, "user", "a"), (2, 0, "system", "s"), (2, 1, "user", "b"),
    ]


def test_blank_turns(spark):
    df = frame(spark, [(1, 0, "user", "  \n"), (1, 1, "user", " hi "), (1, 2, "assistant", " "), (1, 3, "user", None)])
    assert rows_of(C.skip_blank_turns(df), "turn", "text") == [(1, "hi"), (2, " ")]


def test_sentinel_ends_a_conversation(spark):
    df = frame(
        spark,
        [(1, 0, "user", "a"), (1, 1, "assistant", "quit"), (1, 2, "user", " QUIT\n"), (1, 3, "user", "b")]
        + [(2, 0, "user", "exit"), (3, 0, "user", "exit now")],
    )
    assert rows_of(C.truncate_at_sentinel(df), "conv_id", "turn") == [(1, 0), (1, 1), (3, 0)]


def test_pairs_and_unanswered(spark):
    df = frame(
        spark,
        [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "assistant", " a2\n"), (1, 4, "user", "q3")],
    )
    assert rows_of(C.prompt_completion_pairs(df), "turn", "prompt", "completion") == [(2, "q2", "a2")]
    assert rows_of(C.drop_unanswered_turns(df), "position", "text") == [(0, "s"), (1, "q2"), (2, " a2\n")]
    lost = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", "r"), (1, 3, "assistant", "b")])
    assert rows_of(C.prompt_completion_pairs(lost), "turn") == [(2,)]
    assert rows_of(C.drop_unanswered_turns(lost), "position", "text") == [(0, "r"), (1, "b")]


def test_single_turn_prompts(spark):
    df = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")])
    row = C.single_turn_prompts(df, "be brief").first()
    assert [(m.role, m.text) for m in row.messages] == [("system", "be brief"), ("user", "q")]


def test_empty_replies(spark):
    df = spark.createDataFrame([("m", "a"), ("m", None), ("n", "")], "model string, text string")
    checked = C.reject_empty_replies(df)
    assert checked.accepted.count() == 2 and checked.rejected.first().reason == "empty reply"
    assert rows_of(C.failure_rates(df), "model", "requests", "failures") == [("m", 2, 1), ("n", 1, 0)]


def test_nothing_runs_before_it_is_asked_for(spark):
    df = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")])
    spark.sparkContext.setJobGroup("lazy", "lazy")
    C.chat_history(df)
    C.prompt_completion_pairs(df)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("lazy") == []
    spark.sparkContext.setJobGroup("", "")


def test_negative_turns_are_cut_too(spark):
    data = [(1, t, ["user", "assistant"][t % 2], str(t)) for t in range(-20, 20)]
    df = frame(spark, data)
    for size in (3, 7, 1000):
        got = C.drop_unanswered_turns(df, size)
        assert rows_of(got, "position", "text") == [(i, str(t)) for i, t in enumerate(range(-20, 20))]


def test_chat_history(spark):
    df = frame(
        spark,
        [(1, 0, "user", " hi "), (1, 1, "assistant", "a"), (1, 2, "user", "\n"), (1, 3, "user", "lost"), (1, 4, "assistant", None)]
        + [(1, 5, "user", "more"), (1, 6, "assistant", "b"), (1, 7, "user", "exit"), (1, 8, "user", "late")],
    )
    want = [(0, "system", "s"), (1, "user", "hi"), (2, "assistant", "a"), (3, "user", "more"), (4, "assistant", "b")]
    for size in (3, ordered.BLOCK):
        assert rows_of(C.chat_history(df, "s", size), "position", "role", "text") == want
