"""Paragraphs: captures become ``{name, message}`` items (survey W4, W6, A4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(rows: DataFrame, is_name: Column, unfinish: Column, partition: list[str], order: list[str]) -> DataFrame:
    """``rows`` plus ``item``, from 0 in each partition. A row starts an item if it is a name, or the row before is a message
    that is finished; the first row starts one as well."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = rows.withColumn("_name", F.coalesce(is_name, F.lit(False))).withColumn("_open", F.coalesce(unfinish, F.lit(False)))
    starts = F.col("_name") | F.coalesce(~F.lag("_name").over(w) & ~F.lag("_open").over(w), F.lit(True))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_start", starts.cast("long")).withColumn("item", F.sum("_start").over(running) - 1).drop("_start", "_open")


def items(rows: DataFrame, is_name: Column, unfinish: Column, partition: list[str], order: list[str], sep: str = "\r\n", text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """``partition, item, name, message``: the name of an item, if it has one, and its messages joined in order.

    An item that is only a name has an empty message. ``type`` is that of the last message that has one.
    """
    numbered = sessions(rows, is_name, unfinish, partition, order)
    parts = F.array_sort(F.collect_list(F.when(~F.col("_name"), F.struct(*order, F.col(text_col).alias("_text")))))
    out = [F.max(F.when(F.col("_name"), F.col(text_col))).alias("name"), F.array_join(F.transform(parts, lambda p: p["_text"]), sep).alias("message")]
    if type_col:
        out.append(F.max_by(type_col, F.when(F.col(type_col).isNotNull() & ~F.col("_name"), F.struct(*order))).alias("type"))
    return numbered.groupBy(*partition, "item").agg(*out)


def from_captures(captures: DataFrame, partition: list[str], sep: str = "\r\n") -> DataFrame:
    """Items of the rows of :func:`scriptloom.operators.flags.captures`."""
    has = lambda key: F.array_contains("keys", key)
    return items(captures, has("name"), has("unfinish"), partition, ["line_no", "cap_no"], sep, type_col="type")


def move_names_up(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Each item with the name of the next; items left without name and message go."""
    w = Window.partitionBy(*partition).orderBy("item")
    moved = rows.withColumn("name", F.lead("name").over(w))
    return moved.where("name is not null or message is not null")
