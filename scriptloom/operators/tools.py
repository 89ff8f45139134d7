"""File-level tools over dictionaries, lists and workbooks (survey T1 to T6, section 2.7)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dictionary import last_wins, packed_order, with_position


def merge_lists(rows: DataFrame, order: list[str]) -> DataFrame:
    """All rows with their place in the merged list, ``pos``."""
    return with_position(rows, order)


def merge_dictionaries(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``key, value``: later files win."""
    return last_wins(rows, key, value, order).drop("first")


def manifest(rows: DataFrame, file_col: str) -> DataFrame:
    """Entries of each file of a merge."""
    return rows.groupBy(file_col).agg(F.count("*").alias("entries"))


def split_every(rows: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """``part``: a new one every ``n`` entries."""
    return rows.withColumn("part", F.floor(F.col(pos) / n).cast("long"))


def split_equal(rows: DataFrame, k: int, total: int, pos: str = "pos") -> DataFrame:
    """``part``: ``k`` equal parts, what is left over in the last."""
    size = max(1, total // k)
    return rows.withColumn("part", F.least(F.floor(F.col(pos) / size), F.lit(k - 1)).cast("long"))


def split_by_manifest(rows: DataFrame, sizes: DataFrame, order: str, file_col: str, pos: str = "pos") -> DataFrame:
    """``file`` of each position: the manifest's sizes, in its order, are ranges of positions.

    Range starts and rows are ordered together; the last start at or before a row is its file. Rows beyond the last range
    belong to its file. A manifest is a list of files, far smaller than what it lists.
    """
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.where("entries > 0").withColumn("_from", F.coalesce(F.sum("entries").over(before), F.lit(0)))
    starts = starts.withColumn("_to", F.coalesce(F.lead("_from").over(Window.orderBy("_from")), F.lit(1 << 62)))
    # cut both sides into blocks of positions: an equi-join by block instead of a range join
    block = 1 << 16
    last = F.least(F.floor((F.col("_to") - 1) / block), F.floor((F.col("_from") + F.col("entries")) / block))
    starts = starts.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.greatest(last, F.floor(F.col("_from") / block)))))
    joined = rows.withColumn("_block", F.floor(F.col(pos) / block)).join(starts.select("_block", "_from", "_to", file_col), "_block", "left")
    return joined.where((F.col(pos) >= F.col("_from")) & (F.col(pos) < F.col("_to"))).drop("_block", "_from", "_to")


def make_dictionary(pairs: DataFrame, key: str, value: str, order: list[str], skip: str | None = None) -> DataFrame:
    """A dictionary of zipped keys and values, without keys that match ``skip``; the last value of a key wins."""
    kept = pairs.where(~F.regexp_like(key, F.lit(skip))) if skip else pairs
    return last_wins(kept, key, value, order).drop("first")


def flatten_path(path, sep: str = "__"):
    return F.replace(path, F.lit("/"), F.lit(sep))


def unflatten_path(name, sep: str = "__"):
    return F.replace(name, F.lit(sep), F.lit("/"))


def merge_sheets(rows: DataFrame, file_col: str = "file", sheet_col: str = "sheet") -> DataFrame:
    """Rows of workbooks as sheets of one: each file's first sheet gets the file's name."""
    first = rows.groupBy(file_col).agg(F.min(sheet_col).alias("_first"))
    kept = rows.join(first, file_col).where(F.col(sheet_col) == F.col("_first"))
    return kept.withColumn(sheet_col, F.regexp_replace(file_col, r"\.xlsx$", "")).drop("_first")


def split_sheets(rows: DataFrame, file_col: str = "file", sheet_col: str = "sheet") -> DataFrame:
    """Sheets of a workbook as workbooks of their own, named after the sheet."""
    return rows.withColumn(file_col, F.concat(F.col(sheet_col), F.lit(".xlsx"))).withColumn(sheet_col, F.lit("Sheet1"))


def collect_files(files: DataFrame, path_col: str = "path", sep: str = "__") -> DataFrame:
    """``path, name``: every file of a tree under one flat name."""
    return files.withColumn("name", flatten_path(F.col(path_col), sep))


def distribute_files(files: DataFrame, tree: DataFrame, path_col: str = "path", sep: str = "__") -> DataFrame:
    """Collected files back at the places of a tree: ``path`` of each file whose flat name is one of the tree's, null for others."""
    places = tree.select(F.col(path_col).alias("_place"), flatten_path(F.col(path_col), sep).alias("name")).distinct()
    return files.join(places, "name", "left").withColumn(path_col, F.col("_place")).drop("_place")


#: What a line of a batch list begins with if it isn't a command.
COMMENTS = ("#", "//", "::", ";")


def batch_commands(lines: DataFrame, order: list[str], line_col: str = "line") -> DataFrame:
    """``order, verb, name, value`` of a batch list: ``set`` lines with their option, ``extract`` lines with their path.

    Blank lines and comments aren't commands. Anything else is ``shell``, which this engine lists and never runs.
    """
    line = F.trim(line_col)
    kept = lines.where((line != "") & ~reduce(or_, [F.startswith(line, F.lit(c)) for c in COMMENTS]))
    verb = F.when(F.regexp_like(line, F.lit("^(extract|set)(\\s|$)")), F.regexp_extract(line, "^(\\w+)", 1)).otherwise("shell")
    rest = F.when(verb == "shell", line).otherwise(F.trim(F.regexp_replace(line, "^\\w+", "")))
    name = F.when(verb == "set", F.trim(F.split(rest, "=", 2)[0]))
    value = F.when(verb == "set", F.trim(F.get(F.split(rest, "=", 2), F.lit(1)))).otherwise(rest)
    return kept.select(*order, verb.alias("verb"), name.alias("name"), value.alias("value"))


def top_k(rows: DataFrame, key: str, k: int, order: list[str]) -> DataFrame:
    """The ``k`` most frequent keys; of equally frequent ones, those seen first. One aggregate, by hash where the order packs."""
    packed = packed_order(rows, order)
    seen = F.min(F.struct(*order) if packed is None else packed).alias("first")
    return rows.groupBy(key).agg(F.count("*").alias("n"), seen).orderBy(F.desc("n"), "first").limit(k).drop("first")
