"""The interchange formats, 0 to 12: what a document of each looks like, and how it is read back (survey F0 to F13).

A document is one text for each group of rows (a file, or everything). Its lines and JSON members are native expressions;
only their final concatenation gathers a group, and it is as large as the document that is asked for.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .xlsx import MOST_ROWS, read_workbook, write_workbook


def json_string(text: Column) -> Column:
    """A JSON string; characters beyond ASCII stay as they are."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def dictionary_member(fmt: int, text: Column, trans: Column) -> Column:
    """``"line": ""`` or, for formats 1 and 4, ``"line": "line"`` where there is no translation."""
    value = F.when(trans == "", text).otherwise(trans) if fmt in (1, 4) else trans
    return F.concat(json_string(text), F.lit(": "), json_string(value))


def item_lines(fmt: int, name: Column, message: Column, number: Column, flag: str = "☆★", sep: str = "\r\n") -> Column:
    """The members or lines of one item (``number`` from 1) in formats 2, 6, 7, 9, 10 and 11, as an array."""
    pair = F.array_compact(F.array(name, message))
    if fmt == 2:
        return F.array(F.to_json(F.struct(name.alias("name"), message.alias("message"))))
    if fmt == 6:
        return pair
    if fmt == 7:
        return F.transform(pair, json_string)
    if fmt == 10:
        members = F.transform(F.array_distinct(pair), lambda x: F.concat(json_string(x), F.lit(":"), json_string(x)))
        return F.array(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")))
    if fmt == 11:
        return F.transform(pair, lambda x: F.concat(F.lit("{"), json_string(x), F.lit(":"), json_string(x), F.lit("}")))
    if fmt == 9:
        shown = F.replace(message, F.lit(sep), F.lit(sep.replace("\r", "\\r").replace("\n", "\\n")))
        line = lambda f: F.concat(F.lit(f), F.lpad(number.cast("string"), 6, "0"), F.lit(f), F.coalesce(F.concat(name, F.lit(f)), F.lit("")), shown)
        return F.array(line(flag[0]), line(flag[1]), F.lit(""))
    raise ValueError(f"format {fmt} isn't made of items")


def document(rows: DataFrame, lines: Column, order: list[str], group: list[str], fmt: int) -> DataFrame:
    """``group, document``: the rows' lines or JSON members in order, in one text."""
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("_l")))), lambda x: x["_l"]))
    body = F.array_join("parts", "\n" if fmt in (5, 6, 9) else ",\n  ")
    whole = F.concat(body, F.lit("\n")) if fmt in (5, 6, 9) else F.concat(F.lit("{\n  " if fmt in (0, 1, 3, 4) else "[\n  "), body, F.lit("\n}" if fmt in (0, 1, 3, 4) else "\n]"))
    grouped = rows.groupBy(*group).agg(parts.alias("parts")) if group else rows.agg(parts.alias("parts"))
    return grouped.select(*group, whole.alias("document"))


def write_documents(docs: DataFrame, path: str, file_col: str | None = None) -> None:
    """One folder of text files; with ``file_col`` partitioned by source file."""
    if file_col:
        docs.select(file_col, F.col("document").alias("value")).write.partitionBy(file_col).text(path)
    else:
        docs.select(F.col("document").alias("value")).write.text(path)


def read_dictionary(texts: DataFrame, col: str = "document") -> DataFrame:
    """``text, trans`` of formats 0, 1, 3 and 4; the last value of a repeated key counts."""
    entries = F.map_entries(F.from_json(col, "map<string,string>"))
    return texts.select(F.explode(entries).alias("e")).select(F.col("e.key").alias("text"), F.col("e.value").alias("trans"))


def read_items(texts: DataFrame, col: str = "document") -> DataFrame:
    """``pos, name, message`` of format 2."""
    return texts.select(F.posexplode(F.from_json(col, "array<struct<name:string,message:string>>")).alias("pos", "i")).select("pos", "i.*")


def read_list(texts: DataFrame, col: str = "document") -> DataFrame:
    """``pos, text`` of format 7."""
    return texts.select(F.posexplode(F.from_json(col, "array<string>")).alias("pos", "text"))


def read_map_list(texts: DataFrame, col: str = "document") -> DataFrame:
    """``pos, text, trans`` of formats 10 and 11."""
    maps = texts.select(F.posexplode(F.from_json(col, "array<map<string,string>>")).alias("pos", "m"))
    return maps.select("pos", F.explode(F.map_entries("m")).alias("e")).select("pos", F.col("e.key").alias("text"), F.col("e.value").alias("trans"))


def read_lines(texts: DataFrame, col: str = "document") -> DataFrame:
    """``pos, text`` of formats 5 and 6; a final newline ends the last line and doesn't begin another."""
    return texts.select(F.posexplode(F.split(F.regexp_replace(col, r"\n\z", ""), "\n", -1)).alias("pos", "text"))


def read_two_line(texts: DataFrame, flag: str = "☆★", sep: str = "\r\n", col: str = "document") -> DataFrame:
    """``number, name, orig, trans`` of format 9: a pair of lines for each number."""
    shown = sep.replace("\r", "\\r").replace("\n", "\\n")
    lines = read_lines(texts, col).where(F.left("text", F.lit(1)).isin(*flag))
    mark = F.left("text", F.lit(1))
    parts = F.split("text", f"[{flag}]", -1)
    message = F.replace(F.element_at(parts, -1), F.lit(shown), F.lit(sep))
    rows = lines.select(mark.alias("mark"), F.get(parts, F.lit(1)).cast("int").alias("number"), F.when(F.size(parts) > 3, F.get(parts, F.lit(2))).alias("name"), message.alias("message"))
    is_orig = F.col("mark") == flag[0]
    return rows.groupBy("number").agg(
        F.max(F.when(is_orig, F.col("name"))).alias("name"), F.max(F.when(is_orig, F.col("message"))).alias("orig"),
        F.max(F.when(~is_orig, F.col("name"))).alias("trans_name"), F.max(F.when(~is_orig, F.col("message"))).alias("trans"),
    )


def xlsx_rows(fmt: int, rows: DataFrame) -> DataFrame:
    """The table of a workbook: ``Key, Value`` (8, from ``text, trans``) or four columns (12, from ``name, message``)."""
    if fmt == 8:
        return rows.select(F.col("text").alias("Key"), F.col("trans").alias("Value"))
    name, message = F.coalesce("name", F.lit("")), F.coalesce("message", F.lit(""))
    return rows.select(name.alias("Name"), message.alias("Text"), name.alias("Trans Name"), message.alias("Trans Text"))


def workbook_of(table: DataFrame, sheet: str = "Sheet1", most: int = MOST_ROWS - 1) -> bytes:
    """A table as a workbook of one sheet, header first. A sheet holds a bounded number of rows; more are an error, not a cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for one sheet")
    return write_workbook({sheet: [table.columns, *[list(r) for r in rows]]})


def write_xlsx(table: DataFrame, path: str, most: int = MOST_ROWS - 1) -> None:
    """One workbook file, written through Spark's file system."""
    write_file(table.sparkSession, path, workbook_of(table, most=most))


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file (a workbook, a report, a table of symbols) at any path that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The first sheet, or a named one, of a workbook: the header's columns, all text."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    sheets = read_workbook(data)
    header, *rows = sheets[sheet or next(iter(sheets))] or [[]]
    padded = [(r + [""] * len(header))[: len(header)] for r in rows]
    return spark.createDataFrame(padded, ", ".join(f"`{c}` string" for c in header))


def write_outputs(documents: DataFrame, made: dict[int, Column], path: str) -> dict[str, int]:
    """Several outputs of one extraction in one pass: ``format=NN`` folders of texts, and counters of what was read and written.

    ``made`` has the text of each format, null where a row has none in it. Rows are read once and exploded to their
    formats; ``rows`` and, for each format, ``lines`` and ``texts`` are counted as they pass, not by another scan.
    """
    seen = Observation("outputs")
    each = [F.struct(F.lit(f"{n:02d}").alias("format"), text.alias("value")) for n, text in made.items()]
    counts = [F.count(F.lit(1)).alias("rows")]
    for n, text in made.items():
        newlines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
        counts += [F.count(text).alias(f"texts{n:02d}"), F.coalesce(F.sum(newlines), F.lit(0)).cast("long").alias(f"lines{n:02d}")]
    rows = documents.observe(seen, *counts).select(F.explode(F.array(*each)).alias("x")).select("x.*").where("value is not null")
    rows.write.partitionBy("format").text(path)
    return seen.get


def symbol_table(symbols: str) -> bytes:
    """``sjis_ext.bin``: the characters that tunnel codes stand for, in order, as UTF-16."""
    return symbols.encode("utf-16-le")


def tunnel_config(symbols: str, config: dict | None = None) -> str:
    """``uif_config.json`` with the tunnel decoder switched on for these characters."""
    made = dict(config or {})
    made["tunnel_decoder"] = {**made.get("tunnel_decoder", {}), "enable": True, "mapping": symbols}
    return json.dumps(made, ensure_ascii=False, indent=2)


def cutoff_dictionary(found: DataFrame) -> DataFrame:
    """``document``: ``cutoff.json``, translations that don't fit and what to write instead (:func:`..operators.splice.cutoffs`)."""
    return document(found, F.array(F.concat(json_string(F.col("trans")), F.lit(": "), json_string(F.col("short")))), ["trans"], [], 0)


def rebuilt_json(tree: object, style: int = 1) -> str:
    """A tree as text: 0 compact, 1 indented, 10 one member of the first level on each line."""
    compact = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if style == 0:
        return compact(tree)
    if style == 10 and isinstance(tree, list):
        return "[\n" + ",\n".join(map(compact, tree)) + "\n]"
    if style == 10 and isinstance(tree, dict):
        return "{\n" + ",\n".join(f"{compact(k)}:{compact(v)}" for k, v in tree.items()) + "\n}"
    return json.dumps(tree, ensure_ascii=False, indent=2)
