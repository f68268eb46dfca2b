"""Chat formatting with rotated perspectives.

For every participant of a conversation the whole dialogue is rendered with
that participant as assistant, all other participants as named users, and a
mask of the characters the participant is to learn (its own words and the
closing mark; never the headers or other speakers).  Speakers named in
``CONTEXT_ROLES`` are no participants; their turns stay context.

A rendering is returned in chunks of ``chunk_turns`` turns: one row per
(conversation, participant, chunk) with the text, the character offset of the
chunk in the whole rendering and the mask as (start, end) spans within the
chunk; concatenated by chunk number they are the rendering.  A conversation of
any length is thus spread over many groups of bounded size: turns get their
number in the conversation from a range-partitioned order with an offset per
range and conversation, never from one group per conversation.

Only the rendering writes marks: in texts and speaker names ``<|im_`` becomes
``<| im_``, and line breaks of speaker names become spaces, so no text can open
a turn of another speaker.  Speakers are told apart by their names as given.

Chunks meet the participants by conversation and block of chunks, so a
conversation that holds a third of all turns is spread over many keys.

Defined cases: null texts are empty; null speakers are named ``unknown``;
turns are ordered by turn, speaker and text (nulls first), repeated rows are
repeated turns; rows with a null conversation id form one conversation;
conversations of context alone have no perspective and give no rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orchard.session import cut_lineage

CONTEXT_ROLES = ("system",)
UNKNOWN = "unknown"
#: Fixed marks of the rendered format.
OPEN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: What the marks begin with, and what stands for it in texts and names.
MARK, BROKEN = "<|im_", "<| im_"
#: Chunks of one conversation that meet its participants under one key.
BLOCK_CHUNKS = 256


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, text and ``number``: the turn's place, from 0."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ranges are sampled from narrow keys; ``tie`` stands for the text there
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = cut_lineage(rows.repartitionByRange("conv_id", "turn", "speaker", "tie").sortWithinPartitions(
        "conv_id", "turn", "speaker", "tie", "text").withColumn("range", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id()))
    per_range = rows.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("conv_id").orderBy("range")
    offsets = per_range.select(
        F.col("conv_id").alias("_c"), F.col("range").alias("_r"),
        (F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first"))
        .alias("shift"))
    return rows.join(offsets, rows["conv_id"].eqNullSafe(offsets["_c"]) & (rows["range"] == offsets["_r"])).select(
        "conv_id", "speaker", "text", (F.col("at") + F.col("shift")).alias("number"))


def rotations(conversations: DataFrame, chunk_turns: int = 32) -> DataFrame:
    """conv_id, perspective, chunk, n_turns, char_start, text, mask."""
    turns = cut_lineage(numbered_turns(conversations))
    block = F.floor(F.col("chunk") / BLOCK_CHUNKS)
    people = turns.where(~F.col("speaker").isin(*CONTEXT_ROLES)).select(
        F.col("conv_id").alias("_c"), F.col("speaker").alias("perspective")).distinct()
    blocks = turns.groupBy("conv_id").agg(F.floor(F.max("number") / chunk_turns).alias("chunk")).select(
        "conv_id", F.explode(F.sequence(F.lit(0).cast("bigint"), block)).alias("_b"))
    people = blocks.join(people, blocks["conv_id"].eqNullSafe(people["_c"])).select("_c", "_b", "perspective")
    chunked = turns.groupBy("conv_id", F.floor(F.col("number") / chunk_turns).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("number", "speaker", "text"))).alias("turns"))
    views = chunked.join(people, chunked["conv_id"].eqNullSafe(people["_c"]) & (block == people["_b"])).drop("_c", "_b")
    me = F.col("perspective")

    def plain(c):
        return F.replace(c, F.lit(MARK), F.lit(BROKEN))

    def name(t):
        return plain(F.translate(t["speaker"], "\r\n", "  "))

    def head(t):
        return (F.when(t["speaker"] == me, F.lit(OPEN + "assistant"))
                .when(t["speaker"].isin(*CONTEXT_ROLES), F.concat(F.lit(OPEN), name(t)))
                .otherwise(F.concat(F.lit(OPEN + "user name="), name(t))))

    parts = views.withColumn("parts", F.transform("turns", lambda t: F.struct(
        F.concat(head(t), F.lit(MIDDLE)).alias("head"), F.concat(plain(t["text"]), F.lit(END)).alias("body"),
        (t["speaker"] == me).alias("own"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("m"))

    def step(acc, p):
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        # the line break after the closing mark is not learnt
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(acc["m"], span)).otherwise(acc["m"]).alias("m"))

    rendered = parts.select(
        "conv_id", "perspective", "chunk", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.flatten(F.transform("parts", lambda p: F.array(p["head"], p["body"])))).alias("text"),
        F.aggregate("parts", zero, step)["m"].alias("mask"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = rendered.select("conv_id", "perspective", "chunk", F.length("text").cast("long").alias("n"))
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("chunk").alias("_k"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("char_start"))
    return rendered.join(starts, rendered["conv_id"].eqNullSafe(starts["_c"])
                         & (rendered["perspective"] == starts["_p"]) & (rendered["chunk"] == starts["_k"])).select(
        "conv_id", "perspective", "chunk", "n_turns", "char_start", "text", "mask")
