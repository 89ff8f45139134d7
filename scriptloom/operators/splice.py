"""Putting translated spans back into their lines, and lines into files (survey X17, X18, F14, F17, P18)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig
from ..functions.charset import fit_bytes
from ..shared import slices


def splice(lines: DataFrame, spans: DataFrame, keys: list[str], line_col: str = "line") -> DataFrame:
    """``lines`` with each span (``keys, start, end, translated``; offsets in characters, from 0) replaced.

    Spans of a line don't overlap; they are folded in from the left, with the gaps between them, so no offset moves.
    """
    span = F.array_sort(F.collect_list(F.struct("start", "end", "translated")))
    grouped = spans.groupBy(*keys).agg(span.alias("_spans"))
    joined = lines.join(grouped, keys, "left")
    line = F.col(line_col)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate(
        F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int,translated:string>>")), state,
        lambda s, x: F.struct(F.concat(s["out"], F.substring(line, s["at"] + 1, x["start"] - s["at"]), x["translated"]).alias("out"), x["end"].alias("at")),
    )
    rest = F.substring(line, folded["at"] + 1, F.length(line))
    return joined.withColumn(line_col, F.when(F.col("_spans").isNull(), line).otherwise(F.concat(folded["out"], rest))).drop("_spans")


def rebuild_files(lines: DataFrame, file_col: str, line_no: str, line_col: str, newline: Column | str = "\n") -> DataFrame:
    """``file, text``: the lines of each file joined in order by its newline (a column that is the same for all its lines)."""
    sep = F.lit(newline) if isinstance(newline, str) else newline
    parts = F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col(line_col).alias("t"))))
    joined = lines.groupBy(file_col).agg(parts.alias("parts"), F.first(sep).alias("sep"))
    # joined at once: a fold of concat would copy the file for each of its lines
    return joined.select(file_col, F.expr("array_join(transform(parts, p -> p.t), sep)").alias("text"))


def write_shifted(df: DataFrame, columns: list[str], offset: int, values: dict[str, Column]) -> DataFrame:
    """Each translated column written ``offset`` columns to the right; where there is no value, the source is copied."""
    out = {}
    for name, value in values.items():
        at = df.columns.index(name) + offset
        target = df.columns[at] if at < len(df.columns) else f"{name}_{offset}"
        out[target] = F.coalesce(value, F.col(name))
    return df.withColumns({k: v for k, v in out.items() if columns is None or k not in columns or offset})


#: Texts whose spans a worker holds as objects at once.
SLICE_ROWS = 64


def _changed(joined: DataFrame, like: DataFrame, name: str, kind: pa.DataType, one) -> DataFrame:
    """``joined`` as ``like``, ``name`` changed by ``one(value, spans)`` where it and ``_spans`` aren't null."""
    columns = like.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            pairs = zip(batch[name], batch["_spans"], strict=True)
            made = pa.array([one(v.as_py(), s.as_py()) if v.is_valid and s.is_valid else v.as_py() for v, s in pairs], kind)
            yield pa.RecordBatch.from_arrays([made if c == name else batch[c] for c in columns], columns)

    return joined.mapInArrow(run, like.schema)


def splice_texts(texts: DataFrame, spans: DataFrame, file_col: str, text_col: str = "text") -> DataFrame:
    """``texts`` with spans (``file, line_no, start, end, translated``) put in place in one pass over each text.

    Lines and their ends stay where they are: only the spans are shuffled to their text, never lines. Spans of a line don't
    overlap. A text without spans comes back as it was.
    """

    def one(t: str, found: list[dict]) -> str:
        by_line: dict[int, list] = {}
        for x in found:
            by_line.setdefault(x["line_no"], []).append((x["start"], x["end"], x["translated"]))
        out = []
        for n, part in enumerate(re.split("(\r\n|\n)", t)):
            at = 0
            for start, end, new in sorted(by_line.get(n // 2, ())) if n % 2 == 0 else ():
                out += [part[at:start], new]
                at = end
            out.append(part[at:])
        return "".join(out)

    grouped = spans.groupBy(file_col).agg(F.collect_list(F.struct("line_no", "start", "end", "translated")).alias("_spans"))
    return _changed(texts.join(grouped, file_col, "left").select(*texts.columns, "_spans"), texts, text_col, pa.string(), one)


def splice_units(texts: DataFrame, spans: DataFrame, separator: str, between: str, file_col: str, text_col: str = "text") -> DataFrame:
    """As :func:`splice_texts`, for units cut by a pattern (see :func:`..sources.text.units`; ``line_no`` is a unit's number), which
    are joined by ``between`` in every text. Where a span comes twice, for texts that stand twice, it counts once."""
    cut = re.compile(separator)

    def one(t: str, found: list[dict]) -> str:
        parts = [p or "" for p in cut.split(t)]
        by_unit: dict[int, set] = {}
        for x in found:
            by_unit.setdefault(x["line_no"], set()).add((x["start"], x["end"], x["translated"]))
        for n, new in by_unit.items():
            out, at = [], 0
            for start, end, translated in sorted(new):
                if start >= at:
                    out += [parts[n][at:start], translated]
                    at = end
            parts[n] = "".join([*out, parts[n][at:]])
        return between.join(parts)

    grouped = spans.groupBy(file_col).agg(F.collect_list(F.struct("line_no", "start", "end", "translated")).alias("_spans"))
    joined = texts.join(grouped, file_col, "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(grouped.schema["_spans"].dataType)))
    return _changed(joined.select(*texts.columns, "_spans"), texts, text_col, pa.string(), one)


def splice_bytes(units: DataFrame, spans: DataFrame, keys: list[str], config: ExtractConfig, unit_col: str = "unit") -> DataFrame:
    """``units`` of bytes with spans (``keys, start, end, translated, prefix_at, prefix``; places in bytes) replaced.

    With ``cutoff`` a translation is cut or filled to the bytes it replaces. With ``preLen`` and ``preLenFix`` the length in front
    grows by what the text grew; where it counts more than single bytes, zeros fill the text up to a whole count. A
    translation that can't be encoded leaves its span as it was.
    """

    def one(data: bytes, found: list[dict]) -> bytes:
        out = bytearray(data)
        # from the last to the first, so that no place moves before it is used
        for x in sorted(found, key=lambda x: -x["start"]):
            low, high = x["start"], x["end"]
            try:
                new = fit_bytes(x["translated"], high - low, config.encoding)[0] if config.cutoff else x["translated"].encode(config.encoding)
            except UnicodeEncodeError:
                continue
            grown = len(new) - (high - low)
            if grown and config.pre_len and config.pre_len_fix and x["prefix_at"] >= 0:
                fill = -grown % config.pre_len_scale
                new, grown = new + bytes(fill), grown + fill
                at = x["prefix_at"]
                out[low:high] = new
                out[at : at + config.pre_len] = (x["prefix"] + grown // config.pre_len_scale).to_bytes(config.pre_len, "little")
            else:
                out[low:high] = new
        return bytes(out)

    grouped = spans.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "translated", "prefix_at", "prefix")).alias("_spans"))
    return _changed(units.join(grouped, keys, "left").select(*units.columns, "_spans"), units, unit_col, pa.binary(), one)


def cutoffs(spans: DataFrame, config: ExtractConfig) -> DataFrame:
    """``trans, short, diff``: translations longer than what they replace, for a dictionary of shorter ones (``cutoff.json``).

    ``short`` is the translation itself with ``cutoffCopy``, else empty; ``diff`` the bytes too many. Encodings are those that
    Spark's ``encode`` knows; UTF-8 for others.
    """
    known = config.encoding.upper().replace("-", "").replace("_", "")
    size = F.octet_length(F.encode("translated", "ISO-8859-1" if known in ("LATIN1", "ISO88591") else "UTF-16LE" if known == "UTF16LE" else "UTF-8"))
    over = (size - (F.col("end") - F.col("start"))).alias("diff")
    found = spans.select(F.col("translated").alias("trans"), over).where("diff > 0")
    return found.groupBy("trans").agg(F.max("diff").alias("diff")).withColumn("short", F.col("trans") if config.cutoff_copy else F.lit(""))
