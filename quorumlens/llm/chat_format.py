"""Chat formatting as a relational job, in Spark expressions only.

The turns of a conversation are collected as structs and sorted by turn; adjacent turns of one role
form a block. A block is ``[INST]role[/INST]`` + its texts joined by ``<s>`` + ``</s>``, and the formatted
conversation is its blocks in order. Control strings inside texts and roles get a backslash after their
opening characters (``</s>`` becomes ``</\\s>``); one more where there are backslashes
already, so that the escape can be undone exactly and no text can end a block.

The loss mask is a list of spans (start, length) in code points of the formatted string: one for each
assistant turn, covering its escaped text and no control string.

Defined results: null or missing text is empty, a null role is the empty role, a null turn sorts first;
rows that repeat a turn number are ordered by role and text and all stay; an empty text has a span of
length 0; a conversation of any length is one row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quorumlens.llm.common import running_starts, text_of

OPEN, CLOSE, NEXT, END = "[INST]", "[/INST]", "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?|\[/?)(\\*)(s>|INST\])", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?|\[/?)\\(\\*)(s>|INST\])", r"$1$2$3")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, n_blocks, formatted, loss_spans array<struct<start, length>>."""
    struct = F.struct(F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(struct)).alias("turns"))
    chats = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), merged_blocks(F.col("turns")).alias("blocks"))
    chats = chats.withColumn("written", F.transform("blocks", lambda b: F.struct(
        F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE)).alias("head"), F.transform(b["texts"], escape).alias("bodies"), (b["role"] == trained_role).alias("trained"),
    )))
    # what stands before each turn's text: its block's head, or the mark between turns of a block (and the end of the block before)
    pieces = F.flatten(F.transform("written", lambda b, k: F.transform(b["bodies"], lambda t, i: F.struct(
        F.when(i > 0, len(NEXT)).otherwise(F.char_length(b["head"]) + F.when(k > 0, len(END)).otherwise(0)).alias("before"), F.char_length(t).cast("long").alias("length"), b["trained"].alias("trained"),
    ))))
    placed = chats.withColumn("pieces", pieces)
    placed = placed.withColumn("starts", running_starts(F.transform("pieces", lambda p: p["before"] + p["length"])))
    spans = F.filter(F.zip_with("pieces", "starts", lambda p, at: F.struct((at + p["before"]).alias("start"), p["length"].alias("length"), p["trained"].alias("trained"))), lambda s: s["trained"])
    return placed.select(
        "conv_id", "n_turns", F.size("blocks").cast("long").alias("n_blocks"),
        F.array_join(F.transform("written", lambda b: F.concat(b["head"], F.array_join(b["bodies"], NEXT), F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def merged_blocks(turns: Column) -> Column:
    """Sorted turns as array<struct<role, texts>>: adjacent turns of one role are a block.

    The places where the role changes cut the array into slices, so that a conversation of any length takes linear time.
    """
    n = F.size(turns)
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))
    ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(n))
    return F.zip_with(firsts, ends, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts")))


def read_turns(formatted: DataFrame) -> DataFrame:
    """The turns, from the formatted strings alone: conv_id, position, role, text, start and length (of the escaped text, in code points)."""
    blocks = formatted.select("conv_id", F.posexplode(F.split("formatted", END.replace("/", "\\/"), -1)).alias("block_no", "block"))
    by_conv = W.partitionBy("conv_id")
    blocks = blocks.withColumn("block_start", F.sum(F.char_length("block") + len(END)).over(by_conv.orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)))
    blocks = blocks.filter(F.startswith("block", F.lit(OPEN)))
    head = F.instr(F.col("block"), CLOSE) - 1
    blocks = blocks.withColumn("role", F.substring("block", F.lit(len(OPEN) + 1), head - len(OPEN))).withColumn("rest_at", head + len(CLOSE))
    texts = blocks.withColumn("rest", F.substring(F.col("block"), F.col("rest_at") + 1, F.char_length("block"))).select(
        "conv_id", "block_no", "role", (F.coalesce("block_start", F.lit(0)) + F.col("rest_at")).alias("rest_start"), F.posexplode(F.split("rest", NEXT, -1)).alias("text_no", "escaped")
    )
    in_block = W.partitionBy("conv_id", "block_no").orderBy("text_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("rest_start") + F.coalesce(F.sum(F.char_length("escaped") + len(NEXT)).over(in_block), F.lit(0))
    return texts.select(
        "conv_id", F.struct("block_no", "text_no").alias("position"), unescape(F.col("role")).alias("role"), unescape(F.col("escaped")).alias("text"),
        start.alias("start"), F.char_length("escaped").cast("long").alias("length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and their masks say: conv_id, turns (ordered structs), loss_text (unescaped text under the mask)."""
    parsed = read_turns(formatted)
    spans = formatted.select("conv_id", F.explode("loss_spans").alias("span")).select("conv_id", F.col("span.start").alias("start"), F.col("span.length").alias("length"), F.lit(True).alias("masked"))
    same = parsed["conv_id"].eqNullSafe(spans["conv_id"]) & (parsed["start"] == spans["start"]) & (parsed["length"] == spans["length"])
    marked = parsed.join(spans, same, "left").select(parsed["*"], "masked")
    row = F.struct("position", "role", "text", F.coalesce("masked", F.lit(False)).alias("masked"))
    chats = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["masked"]), lambda t: t["text"]), "")
    return chats.select("conv_id", "turns", loss.alias("loss_text"))
