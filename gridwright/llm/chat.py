"""Chat formatting from an event log.

Events (conv_id, message, seq, kind, role, text) are partitioned by conversation
and sorted by sequence. ``delta`` appends its text to a message, ``edit`` puts its
text in the place of what the message had, ``regenerate`` starts the message anew
with its text. Final messages are rendered as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

Inside texts and roles a backslash becomes two and ``<|`` becomes ``<\\|``; in
roles a line break becomes ``<\\n`` as well, which no escaped text holds otherwise. So
no control string stands in an escaped text, and the escapes can be taken back. Loss lies on the texts of
assistant messages. All of it is made of Spark functions; texts are shuffled once.

Defined results: a null text or role counts as empty, a null kind as delta; rows
with a null conv_id form one conversation; a null message or seq comes first;
events that agree in seq are folded in the order of kind, role and text, and
repeated ones are folded each time; a message has the role of its last event that
has one; messages without text are rendered as well; an empty log gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def events_of_rows(rows: DataFrame) -> DataFrame:
    """The log of (conv_id, turn, role, text) rows: each row is a message that came in one delta."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    slim = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).repartition("conv_id")
    return slim.select("conv_id", F.row_number().over(order).cast("bigint").alias("message"), F.lit(0).cast("bigint").alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def streamed(events: DataFrame) -> DataFrame:
    """The log as a service writes it, with the same final messages as ``events`` of one delta a message.

    By turns, a message comes in two deltas, is begun anew after a draft, or is edited.
    """
    n = F.char_length(F.coalesce("text", F.lit("")))
    half = F.floor(n / 2).cast("int")
    left, right = F.left(F.col("text"), half), F.substring(F.col("text"), half + 1, n)
    step = lambda seq, kind, text: F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.array(step(0, "delta", left), step(1, "delta", right))
    anew = F.array(step(0, "delta", F.lit("draft <|")), step(1, "regenerate", left), step(2, "delta", right))
    edited = F.array(step(0, "delta", left), step(1, "edit", F.col("text")))
    way = F.pmod(F.col("message"), F.lit(3))
    rows = events.withColumn("e", F.explode(F.when(way == 0, deltas).when(way == 1, anew).otherwise(edited)))
    return rows.select("conv_id", "message", "e.seq", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages."""
    log = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))))
    folded = events.groupBy("conv_id", "message").agg(log.alias("log"))
    last = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(0)))
    kept = folded.withColumn("kept", F.slice("log", last + 1, F.size("log")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return kept.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform("kept", lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the text, and where loss lies in it.

    A span runs from code point ``start`` to before ``end``; ``turn`` is the number of
    its turn and ``at`` where it starts within that turn, so that a reader who has cut
    the text into turns need not count from the front.
    """
    order = Window.partitionBy("conv_id").orderBy("message")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "message", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    long = parts.withColumn("length", (F.char_length("head") + F.char_length("body") + len(END) + 1).cast("bigint"))
    placed = long.withColumns({"start": F.sum("length").over(order) - F.char_length("body") - (len(END) + 1), "turn": F.row_number().over(order) - 1})
    turns = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "start", "turn", "head", "body", "loss"))).alias("turns"))
    span = lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.char_length(t["body"])).alias("end"), t["turn"].alias("turn"), F.char_length(t["head"]).alias("at"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), span)
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def cut(formatted: Column) -> Column:
    """The turns of a formatted text, each from its start to before its end mark."""
    turns = F.split(formatted, r"<\|im_end\|>\n")  # behind the last one stands an empty string
    return F.slice(turns, 1, F.size(turns) - 1)


def parse(turns: Column) -> Column:
    """array<struct<role, text>> of turns that were cut."""
    inner = F.transform(turns, lambda t: F.substring(t, F.lit(len(START) + 1), F.char_length(t)))
    return F.transform(inner, lambda t: F.struct(unescape_role(F.substring_index(t, "\n", 1)).alias("role"), unescape(F.substring(t, F.instr(t, "\n") + 1, F.char_length(t))).alias("text")))


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted texts say, and what of them lies under their loss masks, by conversation."""
    turns = chats.select("conv_id", F.char_length("formatted").cast("bigint").alias("formatted_chars"), cut(F.col("formatted")).alias("cut"), "loss_spans")
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.get("cut", s["turn"]), s["at"] + 1, (s["end"] - s["start"]).cast("int"))))
    parsed = turns.select("conv_id", "formatted_chars", parse(F.col("cut")).alias("turns"), F.array_join(masked, "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
