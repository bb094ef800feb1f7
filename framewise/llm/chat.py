"""Chat formatting with a grammar round trip (DataFrame functions only).

Template, one block a turn::

    ### role: text</turn>        a turn as it is
    ###\\ role: text</turn>       a turn whose role and text are escaped

Grammar of the parser: a turn starts at each ``###`` that a space or a backslash follows, its role ends at the first
``: ``, its text at the first ``</turn>``. Escapes are pairs of a backslash and a letter, so they undo in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

END = "</turn>"
#: The character and its escape; the backslash's own comes first when writing, last when reading.
ESCAPES = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(c: Column) -> Column:
    for raw, coded in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(raw))
    return c


def block(role: Column, text: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END + "\n"))
    coded = F.concat(F.lit("###\\ "), escape(role), F.lit(": "), escape(text), F.lit(END + "\n"))
    return F.when(escaped, coded).otherwise(plain)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> that the grammar reads in a rendered text."""

    def turn(piece: Column) -> Column:
        coded = F.startswith(piece, F.lit("\\"))
        rest = F.when(coded, F.substring(piece, 3, 2147483647)).otherwise(F.substring(piece, 2, 2147483647))
        colon = F.instr(rest, ": ")
        role = F.when(colon > 0, F.substring(rest, F.lit(1), colon - 1)).otherwise(rest)
        tail = F.when(colon > 0, F.substring(rest, colon + 2, F.lit(2147483647))).otherwise(F.lit(""))
        stop = F.instr(tail, END)
        body = F.when(stop > 0, F.substring(tail, F.lit(1), stop - 1)).otherwise(tail)
        return F.struct(F.when(coded, unescape(role)).otherwise(role).alias("role"), F.when(coded, unescape(body)).otherwise(body).alias("text"))

    pieces = F.split(formatted, r"###(?=[ \\])")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), turn)


def _serial(role: Column, text: Column) -> Column:
    """Unambiguous text of a turn: lengths before contents."""
    return F.concat(F.length(role).cast("string"), F.lit(":"), role, F.length(text).cast("string"), F.lit(":"), text)


def format_conversations(turns: DataFrame, work: Workspace, train_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, spans) of ``turns(conv_id, turn, role, text)``, written to the shared folder and read back.

    ``spans`` is the loss mask: [start, end) code points of the train role's texts in ``formatted`` and whether they are
    escaped there, one for each turn of that role in order. Rows are ordered by turn, ties by role and text; equal rows are all kept. Null role or text
    is empty; a null conv_id is a conversation of its own; a null turn comes first; other columns are ignored. No rows
    give no conversations.

    Each turn is rendered as it is and reparsed; one that does not come back alone is escaped. Then whole conversations
    are rendered, written, reparsed and compared; those that differ are escaped throughout, until all are identical.
    """
    rows = turns.select("conv_id", F.col("turn").alias("n"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    alone = parse(block(F.col("role"), F.col("text"), F.lit(False)))
    same = (F.size(alone) == 1) & (alone[0]["role"] == F.col("role")) & (alone[0]["text"] == F.col("text"))
    rows = rows.withColumn("escaped", ~F.coalesce(same, F.lit(False)))
    for attempt in range(3):
        body = F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text"))
        made = rows.select("conv_id", "n", "role", "text", "escaped", block(F.col("role"), F.col("text"), F.col("escaped")).alias("block"), F.length(body).cast("long").alias("chars"))
        order = Window.partitionBy("conv_id").orderBy("n", "role", "text")
        placed = made.withColumn("i", F.row_number().over(order)).withColumn("end", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - 1)
        span = F.when(F.col("role") == train_role, F.struct((F.col("end") - F.col("chars")).alias("start"), F.col("end").alias("end"), F.col("escaped").alias("escaped")))
        each = F.struct("i", "block", _serial(F.col("role"), F.col("text")).alias("source"), span.alias("span"))
        convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
        written = work.stage(convs.select("conv_id", F.array_join("all.block", "").alias("formatted"), F.sha2(F.array_join("all.source", ""), 256).alias("source"), F.array_compact("all.span").alias("spans")), "formatted")
        back = F.sha2(F.array_join(F.transform(parse(F.col("formatted")), lambda x: _serial(x["role"], x["text"])), ""), 256)
        bad = written.where(back != F.col("source")).select("conv_id").withColumn("bad", F.lit(True))
        if bad.isEmpty():
            return written.select("conv_id", "formatted", "spans")
        rows = rows.join(bad.withColumnRenamed("conv_id", "bad_id"), F.col("conv_id").eqNullSafe(F.col("bad_id")), "left").select("conv_id", "n", "role", "text", (F.col("escaped") | F.coalesce("bad", F.lit(False))).alias("escaped"))
    raise RuntimeError("a conversation does not survive its escapes")


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The source texts under the loss mask, in order."""

    def one(s: Column) -> Column:
        raw = F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.when(s["escaped"], unescape(raw)).otherwise(raw)

    return F.transform(spans, one)
