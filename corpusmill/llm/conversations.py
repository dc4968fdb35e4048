"""Rebuilding conversations from message rows.

Rows are sessionized by channel (the chat id): sorted by time, stripped of repeats, split into
sittings at a calibrated inactivity gap, and dropped when a user is left without a reply, by sitting
or, where a chat is one dialogue, by chat.  A chat may hold a third of all rows, so nothing here
collects a chat: repeats are found by time cells, and the alternation of roles is a product of small
summaries per stretch of time, which are combined in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.session import checkpointed

#: White space, control, format and unassigned characters and the fillers that show nothing.
INVISIBLE = r"(?U)^[\s\p{Z}\p{C}ᅟᅠㅤﾠ⠀]*$"
REPEAT_MICROS = 10_000_000
STRETCH_MICROS = 600_000_000
#: The inactivity gap is this share of all gaps, and never less than so many seconds (a stretch is shorter).
GAP_SHARE, LEAST_GAP_SECONDS = 0.99, 1800
#: Roles in the compact rows; an unknown role, and a row that says nothing but that its chat exists.
USER, ASSISTANT, FOREIGN, SILENT = 0, 1, 2, 3


def clean_role(role: Column) -> Column:
    """The role without case and outer blanks; null stays null."""
    return F.lower(F.regexp_replace(role, r"(?U)^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", ""))


def _counts() -> Column:
    return F.col("content").isNotNull() & ~F.col("content").rlike(INVISIBLE)


def _role_code() -> Column:
    role = clean_role(F.col("role"))
    return F.when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(FOREIGN).cast("byte")


def _marks(content: str) -> list[Column]:
    """128 bits of a content."""
    return [F.xxhash64(content).alias("d1"), F.xxhash64(F.lit("+"), F.col(content)).alias("d2")]


def turns_of(messages: DataFrame, infer_roles: bool = False, with_id: bool = True) -> DataFrame:
    """``(chat_id, role, at, d1, d2[, id])``: each counting message once, and one row for each chat and fault.

    ``role`` is 0 for the user, 1 for the assistant; rows with 2 stand for counting messages without a
    time or with a foreign or missing role, rows with 3 for those that do not count, both without a time.
    With ``infer_roles`` messages of foreign roles that have a time keep it, for :func:`inferred` to name.

    A message is a repeat when the same role said the same in the chat at most ten seconds before (a row
    that is itself a repeat counts as before).  Cells of ten seconds make this a matter of two cells:
    every row is told to its own and to the next one, and of a cell only the earliest can be new.  Of fully
    equal rows the smallest id stays.  Equal rows are folded in each task before the one shuffle.
    """
    at = F.unix_micros("created_at")
    role = _role_code()
    faulty = at.isNull() if infer_roles else at.isNull() | (role == FOREIGN)
    read = messages.where(F.col("chat_id").isNotNull()).select("chat_id", "id", F.when(~_counts(), SILENT).when(faulty, FOREIGN).otherwise(role).cast("byte").alias("role"), _counts().alias("counts"), faulty.alias("faulty"), at.alias("at"), *_marks("content"))
    timed = F.col("counts") & ~F.col("faulty")
    cell = F.floor(F.col("at") / REPEAT_MICROS)
    none = F.lit(None).cast("long")
    own = F.struct("at", "id") if with_id else F.col("at")
    nothing = F.lit(None).cast(f"struct<at: bigint, id: {messages.schema['id'].dataType.simpleString()}>") if with_id else none
    said = lambda role, d1, d2, cell, own, before: F.struct(role.alias("role"), d1.alias("d1"), d2.alias("d2"), cell.alias("cell"), own.alias("own"), before.alias("before"))
    told = F.when(timed, F.array(said(F.col("role"), F.col("d1"), F.col("d2"), cell, own, none), said(F.col("role"), F.col("d1"), F.col("d2"), cell + 1, nothing, F.col("at")))).otherwise(F.array(said(F.col("role"), none, none, none, nothing, none)))
    cells = read.select("chat_id", F.explode(told).alias("t")).groupBy("chat_id", "t.role", "t.d1", "t.d2", "t.cell").agg(F.min("t.own").alias("own"), F.max("t.before").alias("before"))
    first = F.col("own.at") if with_id else F.col("own")
    kept = cells.where(F.col("cell").isNull() | (first.isNotNull() & (F.col("before").isNull() | (first - F.col("before") > REPEAT_MICROS))))
    return kept.select("chat_id", "role", first.alias("at"), "d1", "d2", *([F.col("own.id").alias("id")] if with_id else []))


def inferred(turns: DataFrame) -> DataFrame:
    """Turns whose foreign roles are named by their neighbours.

    A message behind a user's or before the user's next one is the assistant's, any other the user's;
    neighbours are looked for within the stretch, so that no chat is gathered in a task.
    """
    along = Window.partitionBy("chat_id", F.floor(F.col("at") / STRETCH_MICROS)).orderBy("at", "role", "d1", "d2")
    before, after = F.lag("role").over(along), F.lead("role").over(along)
    named = F.when(before == USER, ASSISTANT).when(before == ASSISTANT, USER).when(after == USER, ASSISTANT).otherwise(USER)
    return turns.withColumn("role", F.when((F.col("role") == FOREIGN) & F.col("at").isNotNull(), named.cast("byte")).otherwise(F.col("role")))


def stretches(turns: DataFrame) -> DataFrame:
    """``(chat_id, stretch, opens, closes, fault, spoiled, lo, hi, n)`` of every chat and stretch of ten minutes.

    At one instant the user speaks first, so an instant is the pair (users, assistants), and a second user
    at the same instant leaves the first without reply.  Rows without a time have a stretch of their own,
    null, whose ``spoiled`` says whether they count.  One shuffle, by chat and stretch.
    """
    dealt = turns.select("chat_id", "role", "at", F.floor(F.col("at") / STRETCH_MICROS).alias("stretch")).repartition("chat_id", "stretch")
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    instants = dealt.groupBy("chat_id", "stretch", "at").agg(count(USER).alias("users"), count(ASSISTANT).alias("replies"), count(FOREIGN).alias("foreign"))
    steps = instants.select(
        "*",
        F.when(F.col("users") > 0, USER).otherwise(ASSISTANT).alias("opens"),
        F.when(F.col("replies") > 0, ASSISTANT).otherwise(USER).alias("closes"),
    )
    along = Window.partitionBy("chat_id", "stretch").orderBy("at")
    unanswered = (F.lag("closes").over(along) == USER) & (F.col("opens") == USER)
    linked = steps.withColumn("fault", (F.col("users") > 1) | F.coalesce(unanswered, F.lit(False)))
    return linked.groupBy("chat_id", "stretch").agg(
        F.min_by("opens", "at").alias("opens"), F.max_by("closes", "at").alias("closes"), F.bool_or("fault").alias("fault"), (F.sum("foreign") > 0).alias("spoiled"),
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum(F.col("users") + F.col("replies")).alias("n"),
    )


def sitting_gap(parts: DataFrame, share: float = GAP_SHARE, least_seconds: int = LEAST_GAP_SECONDS) -> int:
    """The inactivity gap in microseconds beyond which a new sitting begins, from all gaps of all chats.

    The gap that ``share`` of the gaps between neighbouring messages of a chat do not exceed, at least
    ``least_seconds``.  ``parts`` are :func:`stretches`: gaps within one are shorter than that least and only
    counted, those between two are measured, so gaps over midnight or over weeks count like any other.
    They are rounded up to minutes, beyond a day to hours and beyond a hundred days to days, so that the
    driver gets a few thousand counts whatever the number of chats.
    """
    along = Window.partitionBy("chat_id").orderBy("stretch")
    between = parts.where(F.col("stretch").isNotNull()).select("n", (F.col("lo") - F.lag("hi").over(along)).alias("gap"))
    minute = 60_000_000
    unit = F.when(F.col("gap") <= 1440 * minute, minute).when(F.col("gap") <= 144_000 * minute, 60 * minute).otherwise(1440 * minute)
    rounded = F.when(F.col("gap") > least_seconds * 1_000_000, F.ceil(F.col("gap") / unit) * unit).otherwise(0)
    bins = between.groupBy(rounded.alias("size")).agg(F.count("gap").alias("between"), F.sum(F.col("n") - 1).alias("within")).collect()
    counts = {r["size"]: r["between"] for r in bins}
    counts[0] = counts.get(0, 0) + sum(r["within"] for r in bins)
    need, found = share * sum(counts.values()), 0
    for size in sorted(counts):
        need -= counts[size]
        found = size
        if need <= 0:
            break
    return max(found, least_seconds * 1_000_000)


def sittings(parts: DataFrame, gap_micros: int) -> DataFrame:
    """``parts`` with ``sitting_no``, which counts the sittings of a chat from 1; rows without a time are with the first."""
    along = Window.partitionBy("chat_id").orderBy(F.col("stretch").asc_nulls_first())
    cut = F.coalesce((F.col("lo") - F.lag("hi").over(along) > gap_micros).cast("int"), F.lit(0))
    return parts.withColumn("cut", cut).withColumn("sitting_no", F.sum("cut").over(along) + 1)


def _chained(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Summaries of neighbouring times put together in order: the first role, the last, and whether a user was left."""
    along = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
    unanswered = (F.lag("closes").over(along) == USER) & (F.col("opens") == USER)
    linked = rows.withColumn("fault", F.coalesce(F.col("fault"), F.lit(False)) | F.coalesce(unanswered, F.lit(False)))
    return linked.groupBy(*keys).agg(
        F.min_by("opens", F.when(F.col("opens").isNotNull(), F.col(order))).alias("opens"), F.max_by("closes", F.when(F.col("closes").isNotNull(), F.col(order))).alias("closes"),
        F.bool_or("fault").alias("fault"), F.bool_or("spoiled").alias("spoiled"), F.bool_or("known").alias("known"), F.sum("n").alias("n"),
    )


def judged(chats: DataFrame, parts: DataFrame, gap_micros: int, by: str = "chat") -> DataFrame:
    """``(chat_id[, sitting_no], drop)``: which chats, or with ``by="sitting"`` which sittings, are to be dropped.

    Sittings are told apart first.  A sitting is broken when it is opened by the assistant or leaves a user
    without reply; where a chat is one dialogue its sittings are joined in order, so that a late reply
    counts.  A chat that ``chats`` does not have, or with a faulty row, is dropped with all its sittings.
    Everything by chat is one shuffle of summaries.
    """
    known = chats.where(F.col("id").isNotNull()).select(F.col("id").alias("chat_id"), F.lit(True).alias("known"))
    rows = sittings(parts.withColumn("known", F.lit(False)).unionByName(known, allowMissingColumns=True), gap_micros)
    each = _chained(rows, ["chat_id", "sitting_no"], "stretch")
    broken = F.coalesce(F.col("n"), F.lit(0)) == 0
    broken = broken | F.col("fault") | (F.col("opens") == ASSISTANT) | (F.col("closes") == USER)
    if by == "chat":
        whole = _chained(each, ["chat_id"], "sitting_no")
        return whole.select("chat_id", (broken | F.coalesce(F.col("spoiled"), F.lit(False)) | ~F.col("known")).alias("drop"))
    if by != "sitting":
        raise ValueError(f"by is chat or sitting, not {by}")
    chat = Window.partitionBy("chat_id")
    return each.select("chat_id", "sitting_no", (broken | F.coalesce(F.max("spoiled").over(chat), F.lit(False)) | ~F.max("known").over(chat)).alias("drop"))


def dropped_chats(chats: DataFrame, messages: DataFrame, gap_micros: int | None = None, infer_roles: bool = False) -> DataFrame:
    """``chat_id`` of every chat to leave out, each once.

    Taken from both tables together: chats without a row in ``chats``, without a counting
    message, with a counting message that has no time or a role other than user or assistant,
    opened by the assistant, or with a user message that is left unanswered.  With ``infer_roles``
    missing and foreign roles are named by their neighbours instead.  Rows without any chat id name
    no chat and yield nothing; chats stored twice count once; empty tables give an empty result.
    Messages are read once.
    """
    turns = turns_of(messages, infer_roles, with_id=False)
    parts = checkpointed(stretches(inferred(turns) if infer_roles else turns))
    found = judged(chats, parts, sitting_gap(parts) if gap_micros is None else gap_micros)
    return found.where("drop").select("chat_id")


def dialogues(chats: DataFrame, messages: DataFrame, gap_micros: int | None = None, infer_roles: bool = False, by: str = "chat") -> DataFrame:
    """``(chat_id, turn_no, sitting_no, role, content, id)``: the chats, or sittings, that stay, in order.

    ``turn_no`` counts the turns of a chat from 1 by time, at one instant the user first, then by id.  A new
    ``sitting_no`` starts after an inactivity gap (:func:`sitting_gap`, when none is given).  Positions are
    offsets of stretches plus positions within, so no task ever holds a whole chat.
    """
    turns = turns_of(messages, infer_roles)
    turns = checkpointed(inferred(turns) if infer_roles else turns)
    parts = checkpointed(stretches(turns))
    if gap_micros is None:
        gap_micros = sitting_gap(parts)
    timed = sittings(parts.where(F.col("stretch").isNotNull()), gap_micros)
    kept = timed.join(judged(chats, parts, gap_micros, by).where(~F.col("drop")), ["chat_id"] if by == "chat" else ["chat_id", "sitting_no"])
    earlier = Window.partitionBy("chat_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.select("chat_id", "stretch", "sitting_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = turns.where(F.col("at").isNotNull()).withColumn("stretch", F.floor(F.col("at") / STRETCH_MICROS)).join(offsets, ["chat_id", "stretch"])
    inside = Window.partitionBy("chat_id", "stretch").orderBy("at", "role", "id", "d1", "d2")
    numbered = placed.select("chat_id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "id", "role", "d1", "d2", (F.col("base") + F.row_number().over(inside)).alias("turn_no"), "sitting_no")
    same = ["chat_id", "key", "d1", "d2"]
    texts = messages.where(F.col("chat_id").isNotNull() & _counts()).select("chat_id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), *_marks("content"), "content").groupBy(*same).agg(F.first("content").alias("content"))
    role = F.when(F.col("role") == USER, "user").otherwise("assistant")
    return numbered.join(texts, same).select("chat_id", "turn_no", "sitting_no", role.alias("role"), "content", "id")
