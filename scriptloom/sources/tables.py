"""Tabular, JSON, XML and workbook sources (survey S7 to S13, D16, D18)."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .xlsx import read_workbook, write_workbook


def csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; no inference pass over the data."""
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False, encoding=encoding, multiLine=True, escape='"')


def cells(lines: DataFrame, sep: str, line_col: str = "line") -> DataFrame:
    """Cells of delimited text that no CSV reader accepts: plain splits."""
    keep = [c for c in lines.columns if c != line_col]
    return lines.select(*keep, F.posexplode(F.split(line_col, "\\Q" + sep + "\\E", -1)).alias("col_no", "cell"))


def json_texts(spark: SparkSession, path: str, postfix: str = ".json") -> DataFrame:
    from .text import files

    return files(spark, path, postfix).select("file", F.col("text").alias("json"))


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """``file, sheet, row_no, cells array<string>`` of XLSX files, all sheets."""
    from .text import files

    return sheets(files(spark, path, ".xlsx", binary=True))


def sheets(blobs: DataFrame) -> DataFrame:
    """``file, sheet, row_no, cells array<string>`` of ``file, data`` rows of workbooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
        for batch in batches:
            for name, data in zip(batch["file"], batch["data"], strict=True):
                rows = [{"file": name.as_py(), "sheet": sheet, "row_no": n, "cells": row} for sheet, found in read_workbook(data.as_py()).items() for n, row in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return blobs.select("file", "data").mapInArrow(run, "file string, sheet string, row_no int, cells array<string>")


#: Rows of a volume: about 5 MB as objects, far below what a sheet may have.
VOLUME_ROWS = 1 << 10


def volumes(rows: DataFrame, file: str, sheet: str = "Sheet1") -> DataFrame:
    """``file, sheet, row_no, cells`` of a table of any size, for :func:`books`: as many files ``file_number`` as its rows need, each of ``VOLUME_ROWS`` at most.

    Rows that stand side by side in a partition share a file; null cells are empty ones.
    """
    at = F.monotonically_increasing_id()
    numbered = rows.withColumn("_at", at)
    number = F.floor(F.col("_at") / VOLUME_ROWS).cast("string")
    return numbered.select(F.concat(F.lit(f"{file}_"), number).alias("file"), F.lit(sheet).alias("sheet"), F.col("_at").alias("row_no"), F.array(*rows.columns).alias("cells"))


def books(rows: DataFrame, file_col: str = "file", sheet_col: str = "sheet", order: str = "row_no", cells_col: str = "cells") -> DataFrame:
    """``file, data``: a workbook of each file's sheets, in the order of their names; a file's rows are one task's."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sheet", "ascending"), ("row_no", "ascending")])
        found: dict[str, list] = {}
        for sheet, cells in zip(table["sheet"].to_pylist(), table["cells"].to_pylist(), strict=True):
            found.setdefault(sheet, []).append(cells)
        return pa.table({"file": table["file"][:1], "data": pa.array([write_workbook(found)], pa.binary())})

    named = rows.select(F.col(file_col).cast("string").alias("file"), F.col(sheet_col).cast("string").alias("sheet"), F.col(order).cast("long").alias("row_no"), F.col(cells_col).alias("cells"))
    return named.groupBy("file").applyInArrow(run, "file string, data binary")


def csv_texts(df: DataFrame, sep: str = ",") -> DataFrame:
    """``line``: rows as CSV, quoted where they must be; the writer for rebuilt tables is ``df.write.csv``."""
    quoted = [F.when(F.regexp_like(c, F.lit(f'[{re.escape(sep)}"\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)]
    return df.select(F.concat_ws(sep, *quoted).alias("line"))


def xml_dialogue(texts: DataFrame, key: str = "file", xml_col: str = "xml") -> DataFrame:
    """``file, seq, name_id, mess_id, name, message``: log entries resolved through the text resources of their file.

    The first of the entries with a message id counts, and the first of the resources with a number.
    """
    get = lambda path: F.xpath(F.col(xml_col), F.lit(path))
    resources = texts.select(key, F.posexplode(F.arrays_zip(get("//TextRes/@NO").alias("no"), get("//TextRes/text()").alias("text"))).alias("at", "r")).select(key, "at", "r.no", "r.text")
    resources = resources.groupBy(key, "no").agg(F.min_by("text", "at").alias("text"))
    logs = texts.select(key, F.posexplode(F.arrays_zip(get("//Log/@NAME").alias("name_id"), get("//Log/@MESS").alias("mess_id"))).alias("seq", "l")).select(key, "seq", "l.*")
    logs = logs.groupBy(key, "mess_id").agg(F.min(F.struct("seq", "name_id")).alias("f")).select(key, "f.seq", "f.name_id", "mess_id")
    name = resources.select(key, F.col("no").alias("name_id"), F.col("text").alias("name"))
    message = resources.select(key, F.col("no").alias("mess_id"), F.col("text").alias("message"))
    return logs.join(name, [key, "name_id"], "left").join(message, [key, "mess_id"], "left")


class RowReader:
    """Typed rows of a binary table: ``int`` (7 bits a byte, low first), ``str``, ``lst``, ``dic`` and ``byteN``."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def int(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def str(self) -> str:
        return self.bytes(self.int()).decode("utf-8")

    def lst(self) -> list[str]:
        return [self.str() for _ in range(self.int())]

    def dic(self) -> dict[int, str]:
        return {self.int(): self.str() for _ in range(self.int())}

    def read(self, kind: str):
        return self.bytes(int(kind[4:] or 1)) if kind.startswith("byte") else getattr(self, kind)()


def write_int(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def write_value(kind: str, v) -> bytes:
    if kind == "int":
        return write_int(v)
    if kind == "str":
        raw = v.encode("utf-8")
        return write_int(len(raw)) + raw
    if kind == "lst":
        return write_int(len(v)) + b"".join(write_value("str", x) for x in v)
    if kind == "dic":
        return write_int(len(v)) + b"".join(write_int(k) + write_value("str", x) for k, x in v.items())
    return bytes(v)


_SQL = {"int": "long", "str": "string", "lst": "array<string>", "dic": "map<long,string>"}


def typed_rows(blobs: DataFrame, columns: list[tuple[str, str]], data_col: str = "data") -> DataFrame:
    """``file, row_no`` and the declared columns of binary tables: a row count, then rows with a length in front, all 32-bit little-endian."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, data in zip(part["file"], part[data_col], strict=True):
                data, at = bytes(data), 4
                for n in range(struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0):
                    size = struct.unpack_from("<I", data, at)[0]
                    reader = RowReader(data[at + 4 : at + 4 + size])
                    out.append((name, n, *[reader.read(kind) for _, kind in columns]))
                    at += 4 + size
            yield pd.DataFrame(out, columns=["file", "row_no", *[c for c, _ in columns]])

    schema = ", ".join(f"`{c}` {_SQL.get(k, 'binary')}" for c, k in columns)
    return blobs.select("file", data_col).mapInPandas(run, f"file string, row_no int, {schema}")
