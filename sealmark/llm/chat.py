"""Chat formatting from event logs: fold events into final messages, then render them with a loss mask.

Built-in functions only. Events of a conversation are (turn, seq, kind, role, text); kind is
  message     starts a message of the turn,
  delta       appends its text to the turn's latest message,
  edit        replaces that message's text,
  regenerate  empties it; the deltas after it build the new one.
Events are folded in order of seq, ties by kind (message, regenerate, edit, delta), role, text. A turn whose first
event isn't a message starts one with that event's role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings. A turn is `<s>role[INST] text [/INST]</s>`.
OPEN, BODY, CLOSE = "<s>", "[INST] ", " [/INST]</s>"
END = "</s>"
_CONTROL, _ESCAPED = r"(<|\[)(\\*)(/?s>|/?INST\])", r"(<|\[)\\(\\*)(/?s>|/?INST\])"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every control string, so none stays in the text."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of escape."""
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def final_messages(events: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turn, nr, role, text): the messages that the events leave. Deltas are grouped by conversation and turn."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    event = F.struct(
        F.col("seq"), rank.alias("rank"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    log = events.where(F.col("kind").isin(*KINDS)).groupBy(F.col(conv_col).alias("conv"), F.col("turn").alias("turn")).agg(F.sort_array(F.collect_list(event)).alias("log"))
    log = log.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("log")), lambda i: (i == 1) | (F.get("log", i - 1)["rank"] == 1)))
    parts = log.select("conv", "turn", "log", F.posexplode("starts").alias("nr", "at"), F.size("log").alias("n"), "starts")
    until = F.coalesce(F.get("starts", F.col("nr") + 1), F.col("n") + 1)
    part = F.slice("log", F.col("at"), until - F.col("at"))
    parts = parts.select("conv", "turn", "nr", part.alias("part"))
    # the last event that sets the text; what stands before it is gone
    base = F.array_max(F.filter(F.sequence(F.lit(1), F.size("part")), lambda i: (i == 1) | (F.get("part", i - 1)["rank"] < len(KINDS))))
    parts = parts.withColumn("base", base)
    kept = F.slice("part", F.col("base"), F.size("part") - F.col("base") + 1)
    text = F.array_join(F.transform(kept, lambda e: F.when(e["rank"] == 2, F.lit("")).otherwise(e["text"])), "")
    return parts.select("conv", "turn", "nr", F.get("part", F.lit(0))["role"].alias("role"), text.alias("text"))


def format_chats(events: DataFrame, conv_col: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points; start from 0).

    The mask covers the texts of loss_role, without marks. Null conversation id: its events are one conversation.
    Null role or text: empty. Null turn or seq: before all others. Repeated rows are repeated messages. Other
    columns are not read. A log of no rows gives no rows. A very long text is rendered whole, and time grows in
    proportion to a turn's events; the log of one turn, and one conversation's text, must fit a row.
    """
    rows = final_messages(events, conv_col)
    head, body = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(BODY)), escape(F.col("text"))
    rows = rows.select("conv", "turn", "nr", (F.col("role") == loss_role).alias("loss"), F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).alias("before"), F.length(body).alias("inside"))
    order = Window.partitionBy("conv").orderBy("turn", "nr")
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start + F.col("before"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "nr", "piece", "loss", "start", "inside")))
    chats = rows.groupBy("conv").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["inside"].cast("long").alias("length")))
    return chats.select(F.col("conv").alias("conv_id"), F.array_join("turns.piece", "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text)."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    inner = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    role = lambda p: F.substring_index(inner(p), BODY, 1)
    tail = len(CLOSE) - len(END)

    def text(p):
        at = F.length(role(p)) + len(BODY)
        return F.substring(inner(p), at + 1, F.length(inner(p)) - at - tail)

    return F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text")))


def loss_text(formatted: str, spans: str) -> Column:
    """What the mask covers, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
