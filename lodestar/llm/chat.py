"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with this speaker as
assistant and the others as named users; what the speaker says is to be learnt, all
else is masked. Speakers in ``narrators`` (system messages) are nobody's perspective
and stay ``system`` in all.

A long conversation is rendered in parts of about ``part_chars`` characters, in order,
so that no task holds more than one part. To find the parts, messages are dealt by
range over (conversation, turn): a conversation of any length spreads over many tasks,
each sums its own share, and the shares' sums are added up per conversation.

Messages stand in the order of turn, role and text; equal ones stay as often as they
occur. A null turn comes first. A null role is the speaker ``unknown``, a null text an
empty message, null conversation ids are one conversation. A conversation of narrators
only has no participant and no row, and an empty table gives none. Marks of the
template within a text or a name are broken by a space, so a message can't begin
another. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Characters of messages (and 16 for each) in a part of a rendered dialogue.
PART_CHARS = 1 << 18
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _parts(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, part_chars: int) -> DataFrame:
    """conv, turn, role, text and the part that each message belongs to."""
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("_row", F.monotonically_increasing_id())
    order = ["turn", "role", "text", "_row"]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", *order)
    # written, so that a share keeps its rows if a task runs again
    dealt = materialize(dealt.withColumn("share", F.spark_partition_id()), "messages")
    size = F.length("text") + 16
    shares = dealt.groupBy("conv", "share").agg(F.sum(size).alias("chars"))
    earlier = Window.partitionBy("conv").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each conversation and share: few, however long a conversation
    base = shares.select(F.col("conv").alias("c"), F.col("share").alias("s"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("conv", "share").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(base, dealt.conv.eqNullSafe(base.c) & (dealt.share == base.s))
    before = F.col("base") + F.coalesce(F.sum(size).over(within), F.lit(0))
    return placed.select("conv", "turn", "role", "text", F.floor(before / part_chars).cast("long").alias("part"))


def rotate(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",), part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each conversation, participant and part: conv_id, speaker, part (from
    0), n_messages, text (the rendered part) and mask: the lengths in characters of
    runs of ``text``, with 1 where they are to be learnt, as ``length:flag`` joined by
    commas. Each message is two runs, its header and its content with the end mark."""
    placed = _parts(conversations, conv_col, turn_col, role_col, text_col, part_chars)
    narrator = F.col("role").isin(*narrators) if narrators else F.lit(False)
    speakers = placed.where(~narrator).select(F.col("conv").alias("c"), F.col("role").alias("speaker")).distinct()
    # a part's messages only: bounded by part_chars
    parts = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    views = parts.join(speakers, parts.conv.eqNullSafe(speakers.c))

    def runs(m: Column) -> Column:
        own = m["role"] == F.col("speaker")
        system = m["role"].isin(*narrators) if narrators else F.lit(False)
        kind = F.when(system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.regexp_replace(_safe(m["role"]), r"\s+", " ")))
        return F.struct(F.concat(F.lit(BEGIN), kind, F.lit("\n")).alias("head"), F.concat(_safe(m["text"]), F.lit(END + "\n")).alias("body"), F.when(system, F.lit(False)).otherwise(own).cast("int").alias("learn"))

    made = views.select(F.col("conv").alias("conv_id"), "speaker", "part", F.transform("messages", runs).alias("runs"))
    mask = F.transform("runs", lambda r: F.concat(F.length(r["head"]).cast("string"), F.lit(":0,"), F.length(r["body"]).cast("string"), F.lit(":"), r["learn"].cast("string")))
    return made.select(
        "conv_id",
        "speaker",
        "part",
        F.size("runs").cast("long").alias("n_messages"),
        F.array_join(F.transform("runs", lambda r: F.concat(r["head"], r["body"])), "").alias("text"),
        F.array_join(mask, ",").alias("mask"),
    )
