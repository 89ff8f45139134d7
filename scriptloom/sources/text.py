"""Text sources: files as ordered lines (survey S1 to S6, S14)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import newline_vote
from ..regexes import java_pattern
from ..shared import slices


def files(spark: SparkSession, path: str, postfix: str = "", recursive: bool = False, binary: bool = False) -> DataFrame:
    """``file, text`` (or ``data``) of the files whose names end in ``postfix``, each once. Other files aren't read."""
    reader = spark.read.option("pathGlobFilter", f"*{postfix}").option("recursiveFileLookup", str(recursive).lower())
    if binary:
        return reader.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("data"))
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def decoded_files(spark: SparkSession, path: str, encoding: str, postfix: str = "") -> DataFrame:
    """``file, text`` of files in an encoding that Spark's reader doesn't know."""
    from ..functions.charset import decoded

    return files(spark, path, postfix, binary=True).select("file", decoded(F.col("data"), encoding).alias("text"))


def lines(texts: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep, line_no, line``: lines end with CRLF or LF; a text that ends with a newline has an empty last line."""
    keep = [c for c in texts.columns if c != text_col] if keep is None else keep
    return texts.select(*keep, F.posexplode(F.split(text_col, "\r\n|\n", -1)).alias("line_no", "line"))


def with_newline(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return texts.withColumn("newline", newline_vote(F.col(text_col)))


#: Texts that are cut in one go, so that a batch of long texts never stands in a worker as all of its parts.
SLICE_ROWS = 64


def _native_units(text: Column, separator: str) -> Column | None:
    """The parts of a text as an array, without Python; None where the pattern may match nothing or Java may read it otherwise."""
    pattern = java_pattern(separator)
    if pattern is None or not re._parser.parse(separator).getwidth()[0]:
        return None
    between = F.split(text, pattern, -1)
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, re.compile(separator).groups + 1)]
    if not groups:
        return between
    names = [f"g{k}" for k in range(len(groups) + 1)]
    rows = F.arrays_zip(*[x.alias(n) for x, n in zip((between, *groups), names, strict=True)])
    # behind the last part no group stands
    return F.filter(F.flatten(F.transform(rows, lambda r: F.array(*[r[n] for n in names]))), lambda x: x.isNotNull())


def units(texts: DataFrame, separator: str, text_col: str = "text") -> DataFrame:
    """``keep, line_no, line``: parts between matches of a pattern, in order; what its groups capture are units as well."""
    keep = [c for c in texts.columns if c != text_col]
    parts = _native_units(F.col(text_col), separator)
    if parts is not None:
        return texts.select(*keep, F.posexplode(parts).alias("line_no", "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(separator)
        for batch in slices(batches, SLICE_ROWS):
            rows, numbers, parts = [], [], []
            for at, text in enumerate(batch[text_col].to_pylist()):
                for n, part in enumerate(compiled.split(text) if text is not None else []):
                    rows.append(at)
                    numbers.append(n)
                    parts.append(part or "")
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], pa.array(numbers, pa.int32()), pa.array(parts, pa.string())], [*keep, "line_no", "line"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != text_col)
    return texts.select(*keep, text_col).mapInArrow(run, f"{schema}line_no int, line string")


_TERM = re.compile(r"\s*(?:readInt\(\s*data\s*,\s*(\w+)\s*\)|(0x[0-9A-Fa-f]+|\d+))\s*")


def evaluate(expression: str, data: bytes) -> int:
    """A sum of products of integers and ``readInt(data, offset)`` (four bytes, little-endian): all that layouts need, without eval."""
    total, at = 0, 0
    sign = 1
    while True:
        product, first = 1, True
        while first or (at < len(expression) and expression[at] == "*"):
            at += not first
            m = _TERM.match(expression, at)
            if not m:
                raise ValueError(f"can't read {expression!r} at {at}")
            k = int(m[1], 0) if m[1] else 0
            product *= int.from_bytes(data[k : k + 4], "little") if m[1] else int(m[2], 0)
            at, first = m.end(), False
        total += sign * product
        if at == len(expression):
            return total
        if expression[at] not in "+-":
            raise ValueError(f"can't read {expression!r} at {at}")
        sign = 1 if expression[at] == "+" else -1
        at += 1


def binary_units(blobs: DataFrame, separator: bytes, data_col: str = "data", section: tuple[str, str] | None = None) -> DataFrame:
    """``keep, unit_no, offset, unit``: parts of a section of each file between matches of a byte pattern; captured separators are units too."""
    keep = [c for c in blobs.columns if c != data_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(separator, re.DOTALL) if separator else None
        for batch in batches:
            rows, numbers, offsets, parts = [], [], [], []
            for at, data in enumerate(batch[data_col].to_pylist()):
                if data is None:
                    continue
                low, high = (evaluate(e, data) for e in section) if section else (0, len(data))
                cuts, begin = [], low
                for m in compiled.finditer(data, low, high) if compiled else ():
                    if m.end() > m.start():
                        cuts.append((begin, data[begin : m.start()]))
                        cuts += [(m.start(i), m[i]) for i in range(1, compiled.groups + 1) if m[i] is not None]
                        begin = m.end()
                cuts.append((begin, data[begin:high]))
                for n, (offset, part) in enumerate(cuts):
                    for column, x in zip((rows, numbers, offsets, parts), (at, n, offset, part), strict=True):
                        column.append(x)
            part = batch.take(pa.array(rows, pa.int64()))
            made = [pa.array(numbers, pa.int32()), pa.array(offsets, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[part[c] for c in keep], *made], [*keep, "unit_no", "offset", "unit"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blobs.schema if f.name != data_col)
    return blobs.select(*keep, data_col).mapInArrow(run, f"{schema}unit_no int, offset long, unit binary")
