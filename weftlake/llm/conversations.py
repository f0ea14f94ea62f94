"""Rebuilding conversations from message rows (problem 2).

The general operator is `resolve_parents`: nodes with a parent pointer get their root and their offset below it by
pointer jumping, in as many joins as the logarithm of the longest path; orphans and cycles are told apart.

Messages that carry no parent pointer are ordered by time, and their pointers are derived: a turn points to the turn it
follows, but one that follows nothing it could (an assistant's first message, or one after another assistant message, or a
message without a time or a speaker) points to a node that is not there, and so is an orphan. Pointers are derived on two
levels, so that a session which holds a large share of all rows is never sorted in one task: within a session, the
messages of one time window form a segment, ordered by (created_at, message_id); a segment's parent is the session's
segment before it, or the missing node if a message in it, or its first one, is an orphan. Pointer jumping over segments
then tells what hangs together: a session with an orphan is broken, as whatever follows the orphan has lost its root; in
the others a message's place is its segment's offset plus its rank there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlake.session import durable, is_blank, stripped

#: Spellings of speakers (fixed values).
SPEAKERS = {"user": ["user", "human"], "assistant": ["assistant", "bot", "model", "ai"], "system": ["system"]}
WINDOW_S = 3600
TIMELESS_PARTS = 64
#: The part that no segment has: what an orphan points to.
MISSING = -(1 << 62)


def resolve_parents(nodes: DataFrame, id_col: str, parent_col: str, weight: Column | None = None) -> DataFrame:
    """(id, root, offset, state) of every node.

    offset is the summed weight of the ancestors (by default their number, so the depth). state is `root`, `child`,
    `orphan` (the parent, or that of an ancestor, is no node: root is the topmost node there is) or `cycle` (root and
    offset are null). Ids must be unique and not null; a null parent makes a root. An empty table gives no rows.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), w.alias("w"))
    up = base.select(F.col("id").alias("pid"), F.col("w").alias("pw"))
    start = base.join(up, base.parent == up.pid, "left").select(
        "id",
        F.when(F.col("pid").isNull(), F.col("id")).otherwise(F.col("pid")).alias("ptr"),
        F.coalesce("pw", F.lit(0)).cast("long").alias("off"),
        F.col("pid").isNull().alias("done"),
        (F.col("parent").isNotNull() & F.col("pid").isNull()).alias("orphan"),
    )
    settled = durable(start)
    total = settled.count()
    # A path of n nodes needs log2(n) + 1 doublings; what is still open then runs in a circle.
    rounds = max(1, total).bit_length() + 1
    open_ = settled.where("NOT done")
    settled = settled.where("done")
    for _ in range(rounds):
        target = settled.unionByName(open_).select(F.col("id").alias("tid"), F.col("ptr").alias("tptr"), F.col("off").alias("toff"), F.col("done").alias("tdone"), F.col("orphan").alias("torphan"))
        moved = open_.join(target, open_.ptr == target.tid).select("id", F.col("tptr").alias("ptr"), (F.col("off") + F.col("toff")).alias("off"), F.col("tdone").alias("done"), F.col("torphan").alias("orphan"))
        moved = durable(moved)
        settled = settled.unionByName(moved.where("done"))
        open_ = moved.where("NOT done")
        if open_.isEmpty():
            break
    state = F.when(F.col("orphan"), "orphan").when(F.col("ptr") == F.col("id"), "root").otherwise("child")
    resolved = settled.select(F.col("id").alias(id_col), F.col("ptr").alias("root"), F.col("off").alias("offset"), state.alias("state"))
    circles = open_.select(F.col("id").alias(id_col), F.lit(None).cast(open_.schema["ptr"].dataType).alias("root"), F.lit(None).cast("long").alias("offset"), F.lit("cycle").alias("state"))
    return resolved.unionByName(circles)


def speaker_of(role: Column) -> Column:
    """user, assistant or system; null if the role cannot be recognised."""
    plain = F.lower(stripped(role))
    out = F.lit(None).cast("string")
    for name, words in SPEAKERS.items():
        out = F.when(plain.isin(words), F.lit(name)).otherwise(out)
    return out


def ordered_messages(messages: DataFrame, window_s: int = WINDOW_S, keep_content: bool = False) -> DataFrame:
    """Messages without system rows and copies, ranked in their segment (session_id, part), with the next one's speaker.

    One shuffle, by segment: grouping out the copies and ranking reuse it. Messages without a time have no order; they
    are spread over parts of their own.
    """
    seconds = F.unix_date(F.to_date("created_at")).cast("long") * 86400 + F.hour("created_at") * 3600 + F.minute("created_at") * 60 + F.second("created_at")
    timed = F.floor(seconds / F.lit(window_s))
    timeless = F.lit(-(1 << 40)) - F.pmod(F.xxhash64("message_id"), F.lit(TIMELESS_PARTS))
    columns = [
        "session_id",
        F.coalesce(timed, timeless).cast("long").alias("part"),
        "message_id",
        "created_at",
        speaker_of(F.col("role")).alias("speaker"),
        is_blank(F.col("content")).alias("blank"),
        F.xxhash64("role", "content").alias("copy"),
    ]
    names = ["session_id", "part", "message_id", "created_at", "speaker", "blank", "copy"] + ["content"] * keep_content
    rows = messages.select(*columns, *["content"] * keep_content).where("session_id IS NOT NULL AND NOT (speaker <=> 'system')")
    rows = rows.repartition("session_id", "part").groupBy(*names).agg(F.lit(1).alias("one")).drop("one", "copy")
    order = Window.partitionBy("session_id", "part").orderBy("created_at", "message_id")
    return rows.withColumns({"rank": F.row_number().over(order).cast("long"), "next": F.lead("speaker").over(order), "next_blank": F.lead("blank").over(order), "last": F.lead("message_id").over(order).isNull() & F.lead("blank").over(order).isNull()})


def wordless_sessions(messages: DataFrame) -> DataFrame:
    """(session_id) of all sessions that have system rows; grouped before the shuffle, so a hot session costs no more."""
    return messages.where("session_id IS NOT NULL").where(speaker_of(F.col("role")) == "system").select("session_id").distinct()


def segments(ordered: DataFrame) -> DataFrame:
    """One row per segment: what its messages show within it, its first and last message, and its parent."""
    user, assistant = F.col("speaker") == "user", F.col("speaker") == "assistant"
    answered = F.coalesce((F.col("next") == "assistant") & ~F.col("next_blank"), F.lit(False))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    parts = ordered.groupBy("session_id", "part").agg(
        F.count(F.lit(1)).alias("n"),
        flag(~F.col("blank")).alias("text"),
        flag(F.col("created_at").isNull() | F.col("speaker").isNull()).alias("bad"),
        flag(assistant & (F.col("next") == "assistant")).alias("double"),
        flag(user & ~F.col("last") & ~answered).alias("unanswered"),
        F.max(F.when(F.col("rank") == 1, F.struct("speaker", "blank"))).alias("head"),
        F.max(F.when(F.col("last"), F.struct("speaker"))).alias("tail"),
    )
    order = Window.partitionBy("session_id").orderBy("part")
    linked = parts.withColumns({"before": F.lag("tail").over(order), "before_part": F.lag("part").over(order), "after": F.lead("head").over(order)})
    # What cannot hang on the segment before it: a speaker or time is missing, or an assistant speaks first or again.
    follows = F.when(F.col("before_part").isNull(), F.col("head.speaker") == "user").otherwise(~((F.col("before.speaker") == "assistant") & (F.col("head.speaker") == "assistant")))
    lost = F.col("bad") | F.col("double") | ~F.coalesce(follows, F.lit(False))
    missing = F.struct("session_id", F.lit(MISSING).alias("part"))
    parent = F.when(lost, missing).when(F.col("before_part").isNotNull(), F.struct("session_id", F.col("before_part").alias("part")))
    return linked.select("session_id", "part", "n", "text", "unanswered", "tail", "after", F.struct("session_id", "part").alias("id"), parent.alias("parent"))


def judged(messages_ordered: DataFrame, wordless: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments with root and offset, sessions with their defect or null); wordless sessions have no message but count."""
    parts = durable(segments(messages_ordered))
    resolved = resolve_parents(parts, "id", "parent", F.col("n"))
    placed = parts.join(resolved.withColumnRenamed("id", "rid"), F.col("id") == F.col("rid"))
    border_answer = F.coalesce((F.col("after.speaker") == "assistant") & ~F.col("after.blank"), F.lit(False))
    seen = placed.select("session_id", "n", "text", (~F.col("state").isin("root", "child")).alias("broken"), (F.col("unanswered") | F.coalesce((F.col("tail.speaker") == "user") & ~border_answer, F.lit(False))).alias("unanswered"))
    if wordless is not None:
        no = F.lit(False)
        seen = seen.unionByName(wordless.select("session_id", F.lit(0).cast("long").alias("n"), no.alias("text"), no.alias("broken"), no.alias("unanswered")))
    sessions = seen.groupBy("session_id").agg(F.max("text").alias("text"), F.max("broken").alias("broken"), F.max("unanswered").alias("unanswered"), F.sum("n").alias("messages"))
    defect = F.when(~F.col("text"), "empty").when(F.col("broken"), "broken").when(F.col("unanswered"), "no_reply")
    return placed, sessions.select("session_id", "messages", defect.alias("defect"))


def dropped_sessions(messages: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(session_id, defect) of every session that is no whole conversation.

    `empty`: no message has content. `broken`: a message has no time or no recognisable speaker, or the first is not the
    user's, or an assistant message directly follows another. `no_reply`: a user message is not directly followed by an
    assistant message with content. The first that holds counts. System rows are set aside, so a session that has no
    others is empty; exact copies count once; equal times are ordered by message_id; rows without a session belong to no
    conversation.
    """
    return judged(ordered_messages(messages, window_s), wordless_sessions(messages))[1].where("defect IS NOT NULL").select("session_id", "defect")


def conversations(messages: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """(session_id, position, speaker, content, message_id, created_at) of the whole conversations, in order from 1.

    One row per message: a conversation may be longer than a row should be.
    """
    ordered = ordered_messages(messages, window_s, keep_content=True)
    placed, sessions = judged(ordered_messages(messages, window_s))
    whole = sessions.where("defect IS NULL").select("session_id")
    starts = placed.join(whole, "session_id", "left_semi").select("session_id", "part", "offset")
    return ordered.join(starts, ["session_id", "part"]).select("session_id", (F.col("offset") + F.col("rank")).alias("position"), "speaker", "content", "message_id", "created_at")
