r"""Chat logs folded into messages and rendered with a reversible template.

A log row is (conv_id, seq, msg, op, role, text). `message` opens message `msg`, `delta` appends to
it, `edit` replaces its text, `regenerate` empties it for the deltas that follow, `delete` drops
it. Messages keep the order in which they were opened.

A turn is rendered as `<s>[INST]role[/INST]text</s>`. Inside role and text a backslash is doubled
and one is put after the first character of each control string, so none is left to be mistaken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    tags = F.regexp_replace(doubled, F.lit(r"<(/?s>)"), F.lit(r"<\\$1"))
    return F.regexp_replace(tags, F.lit(r"\[(/?INST\])"), F.lit(r"[\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, position, msg, role, text.

    The last reset of a message counts, with the deltas after it; events of one seq are taken in
    the order of (op, role, text). Null texts are empty, a null seq comes first, deltas without a
    reset before them are kept. One conversation's messages are spread over the tasks.
    """
    event = F.struct("seq", "op", "role", "text")
    events = log.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(event)).alias("e"), F.min("seq").alias("position"))
    last = F.coalesce(F.array_max(F.filter(F.transform("e", lambda x, i: F.when(x["op"].isin(*RESETS), i)), lambda i: i.isNotNull())), F.lit(0))
    tail = events.withColumn("tail", F.slice("e", last + 1, F.size("e")))
    alive = tail.filter(~F.coalesce(F.col("tail")[0]["op"] == "delete", F.lit(False)))
    roles = F.filter(F.transform(F.concat(F.reverse("tail"), F.reverse("e")), lambda x: x["role"]), lambda r: r.isNotNull())
    body = F.array_join(F.transform("tail", lambda x: F.when(x["op"] == "regenerate", F.lit("")).otherwise(F.coalesce(x["text"], F.lit("")))), "")
    return alive.select("conv_id", "position", "msg", F.coalesce(F.try_element_at(roles, F.lit(1)), F.lit("")).alias("role"), body.alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Per conversation: formatted, loss_spans (turn, start, end) over the text of `learn_role`.

    Offsets are code points of `formatted`, ends exclusive; `turn` counts from 0.
    """
    order = Window.partitionBy("conv_id").orderBy("position", "msg")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    piece = F.concat(head, escape(F.col("text")), F.lit(CLOSE))
    turns = messages.select("conv_id", "position", "msg", (F.col("role") == learn_role).alias("learn"), F.length(head).cast("long").alias("head"), piece.alias("piece"))
    size = F.length("piece").cast("long")
    turns = turns.withColumns({"turn": F.row_number().over(order) - 1, "stop": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start, end = F.col("stop") - size + F.col("head"), F.col("stop") - len(CLOSE)
    span = F.when(F.col("learn"), F.struct("turn", start.alias("start"), end.alias("end")))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("t"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return gathered.select("conv_id", F.array_join("t.piece", "").alias("formatted"), "loss_spans")


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and loss text parsed from what `render` wrote: conv_id, formatted, turns, loss_text."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)
    turn = lambda p: F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + F.lit(len(OPEN) + len(MIDDLE) + 1))).alias("text"))
    cut = rendered.withColumn("pieces", pieces)
    masked = F.transform("loss_spans", lambda s: unescape(F.right(F.get(F.col("pieces"), s["turn"]), (s["end"] - s["start"]).cast("int"))))
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def log_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as a log; repeated turns are messages of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.row_number().over(order).alias("msg"), F.lit("message").alias("op"), "role", "text")
