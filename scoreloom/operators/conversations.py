"""Message histories over a table (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .ordered import BLOCK, number_in_order, with_next
from .validation import Checked

DEFAULT_SYSTEM = "You are a helpful assistant."
SENTINELS = ("quit", "exit")


def _is_user() -> Column:
    return F.col("role") == "user"


def inject_system_turn(turns: DataFrame, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Give conversations without a system message one, before their first turn."""
    lacking = (
        turns.groupBy("conv_id")
        .agg(F.max(F.col("role") == "system").alias("_has"), F.min("turn").alias("_first"))
        .where(~F.col("_has"))
        .select(
            "conv_id",
            F.least(F.col("_first") - 1, F.lit(-1).cast("long")).alias("turn"),
            F.lit("system").alias("role"),
            F.lit(system).alias("text"),
        )
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(lacking)


def skip_blank_turns(turns: DataFrame) -> DataFrame:
    """Strip user input and leave out what is empty."""
    text = F.when(_is_user(), strip(F.col("text"))).otherwise(F.col("text"))
    stripped = turns.withColumn("text", text)
    return stripped.where(~(_is_user() & (F.coalesce("text", F.lit("")) == "")))


def truncate_at_sentinel(turns: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """End a conversation at a user turn that asks to quit; that turn is not kept.

    The ends are an aggregate, joined back by conversation: broadcast where they are few,
    else set apart from their aggregate, so that adaptive execution can split the join where
    a conversation is long.
    """
    quits = _is_user() & F.lower(strip(F.col("text"))).isin(*sentinels)
    ends = turns.where(quits).groupBy("conv_id").agg(F.min("turn").alias("_end"))
    ends = ends.hint("rebalance")
    joined = turns.join(ends, "conv_id", "left")
    return joined.where(F.col("_end").isNull() | (F.col("turn") < F.col("_end"))).drop("_end")


def history_at_turn(turns: DataFrame) -> DataFrame:
    """For each user turn, all messages so far, in order: what a model is sent.

    That is the square of a conversation's length in all, which is the size of the result;
    ``history_blocks`` stores the messages of long conversations once.
    """
    so_far = (
        Window.partitionBy("conv_id")
        .orderBy("turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    messages = F.collect_list(F.struct("turn", "role", "text")).over(so_far)
    listed = turns.withColumn("messages", messages)
    return listed.where(_is_user()).select("conv_id", "turn", "messages")


def history_blocks(turns: DataFrame, size: int) -> DataFrame:
    """The messages of each block of ``size`` turns, in order: a history cut in pieces."""
    return (
        turns.withColumn("block", F.floor(F.col("turn") / size))
        .groupBy("conv_id", "block")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    )


def single_turn_prompts(turns: DataFrame, system: str = DEFAULT_SYSTEM) -> DataFrame:
    """System message and user message alone, for each user turn."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("text")),
        F.struct(F.col("role"), F.col("text")),
    )
    return turns.where(_is_user()).select("conv_id", "turn", messages.alias("messages"))


def prompt_completion_pairs(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """User turns that were answered, with the stripped answer. A reply without content
    is no answer."""
    paired = with_next(turns, "conv_id", "turn", ["role", "text"], size)
    answered = (F.col("next_role") == "assistant") & F.col("next_text").isNotNull()
    return paired.where(_is_user() & answered).select(
        "conv_id",
        "turn",
        F.col("text").alias("prompt"),
        strip(F.col("next_text")).alias("completion"),
    )


def drop_unanswered_turns(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """Take failed user turns back out of the history and number what is left.

    A turn failed if no reply follows it, or one without content; such a reply goes too.
    """
    lost = (F.col("role") == "assistant") & F.col("text").isNull()
    seen = with_next(turns, "conv_id", "turn", ["role", "text"], size)
    replied = (F.col("next_role") == "assistant") & F.col("next_text").isNotNull()
    failed = _is_user() & ~F.coalesce(replied, F.lit(False))
    kept = seen.where(~failed & ~lost).drop("next_role", "next_text")
    return number_in_order(kept, "conv_id", "turn", "position", size)


def chat_history(turns: DataFrame, system: str = DEFAULT_SYSTEM, size: int = BLOCK) -> DataFrame:
    """What a chat session keeps of what was said, numbered from its system message.

    Up to the turn that asks to quit; without blank input, lost replies and the
    user turns that were left without a reply.
    """
    whole = inject_system_turn(turns, system)
    entered = skip_blank_turns(truncate_at_sentinel(whole))
    lost = (F.col("role") == "assistant") & F.col("text").isNull()
    return drop_unanswered_turns(entered.where(~lost), size)


def reject_empty_replies(replies: DataFrame, text: str = "text") -> Checked:
    """Replies without content are errors."""
    lost = F.col(text).isNull()
    return Checked(
        accepted=replies.where(~lost),
        rejected=replies.where(lost).withColumn("reason", F.lit("empty reply")),
    )


def failure_rates(replies: DataFrame, key: str = "model", text: str = "text") -> DataFrame:
    """Requests and failures per key."""
    return replies.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col(text).isNull()).alias("failures"),
    )


#: Who may speak.
ROLES = ("system", "user", "assistant")


def validate_conversations(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation with ``n_turns``, a flag per rule, and ``valid``, all of them:

    ``contiguous``: turns are 0, 1, 2 and so on; ``roles_known``; ``system_first``: only turn 0 may
    be a system message; ``alternates``: a user speaks first, then assistant and user in turn;
    ``answered``: the assistant has the last word; ``no_blank``: every message has some text.

    Each turn is checked against the next one, found in blocks of ``size`` turns with the first
    row of the next block carried over, so a conversation of any length is many tasks. The
    flags are aggregates that combine before the shuffle. A null turn or role breaks the
    rules about it; repeated turns are not contiguous; a null ``conv_id`` is a conversation.
    """
    # A key that equals itself also where it is null, for the joins that carry rows over.
    own = turns.select("turn", "role", "text", F.array("conv_id").alias("_conv"))
    linked = with_next(own, "_conv", "turn", ["turn", "role"], size)
    role, after = F.col("role"), F.col("next_role")
    last = F.col("next_turn").isNull() & F.col("turn").isNotNull()
    first = F.min_by(role, F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b")))
    follows = F.when(role == "user", after == "assistant").otherwise(after == "user")

    def every(rule: Column) -> Column:
        return F.bool_and(F.coalesce(rule, F.lit(False)))

    checked = linked.groupBy("_conv").agg(
        F.count(F.lit(1)).alias("n_turns"),
        (every(last | (F.col("next_turn") == F.col("turn") + 1)) & F.coalesce(F.min("turn") == 0, F.lit(False))).alias(
            "contiguous"
        ),
        every(role.isin(*ROLES)).alias("roles_known"),
        every((role != "system") | (F.col("turn") == 0)).alias("system_first"),
        (every(last | follows) & F.coalesce(first.isin("system", "user"), F.lit(False))).alias("alternates"),
        (every(~last | (role == "assistant")) & F.bool_or(last)).alias("answered"),
        every(strip(F.col("text")) != "").alias("no_blank"),
    )
    flags = ["contiguous", "roles_known", "system_first", "alternates", "answered", "no_blank"]
    valid = F.lit(True)
    for flag in flags:
        valid = valid & F.col(flag)
    return checked.select(F.col("_conv")[0].alias("conv_id"), "n_turns", *flags, valid.alias("valid"))
