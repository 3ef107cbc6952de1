"""Chat formatting: every assistant turn becomes an example of its own.

The example's text holds all turns before it as context and ends with that turn, whose text
alone is trainable. A conversation that does not end with an assistant turn gets one more
example, marked ``tail``, that has every turn and nothing trainable, so that no turn is lost.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line feed. Inside a text, a backslash is
written ``\\b`` and ``<`` is written ``\\l``; in a role also ``>`` is ``\\g`` and a line feed
``\\n``. So no text can hold a marker, and reading back is exact.

Defined results: null roles and texts are empty; turns are taken by turn (null first), then
role, then text, so repeated rows stay and ties have one order; conversations with a null id
are one conversation; an empty table gives an empty table; other columns are not read.
One conversation's turns meet in one task, since its last example holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")))


def format_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """From (conv_id, turn, role, text): conv_id, example, text, loss_start, loss_end, tail.

    loss_start and loss_end bound the trainable code points of text; both are its end in a tail.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    head = F.concat(F.lit("<turn "), escape_role(F.col("role")), F.lit(">"))
    rows = rows.select("conv_id", "role", F.row_number().over(order).alias("example"), F.lead(F.lit(1)).over(order).isNull().alias("last"), head.alias("head"), escape(F.col("said")).alias("body"))
    upto = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("said", F.collect_list(F.concat("head", "body", F.lit(CLOSE))).over(upto))
    target = F.col("role") == target_role
    rows = rows.filter(target | F.col("last")).withColumn("text", F.concat_ws("", "said"))
    end = F.length("text") - F.when(target, len(CLOSE)).otherwise(0)
    start = end - F.when(target, F.length("body")).otherwise(0)
    return rows.select("conv_id", "example", "text", start.cast("long").alias("loss_start"), end.cast("long").alias("loss_end"), (~target).alias("tail"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.split(text, CLOSE)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substr(x, F.lit(7)), ">", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, ">") + 1)).alias("text"),
        ),
    )


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substr(text, (start + 1).cast("int"), (end - start).cast("int")))
