"""Greedy, order-dependent merges: one file's rows side by side in one task (survey W9, W10, J14, W12).

What comes next depends on what was consumed before, so no window can express them. Files (scenes, scripts) are bounded by
nature; many files make many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import slices

#: Rows that a worker reads as objects at once, beside those of its file.
SLICE_ROWS = 1 << 10

OPENS, CLOSES = "「『", "」』"


def balance(text: str) -> int:
    return sum(text.count(c) for c in OPENS) - sum(text.count(c) for c in CLOSES)


def _merged(rows: DataFrame, file_col: str, order: str, name_col: str, text_col: str, take) -> DataFrame:
    """``file, first, n_parts, name, message``: each file's rows in order, gathered by ``take(texts, names, i)``: where what begins at ``i`` ends, and its text.

    Files stand one after another in their partition; a worker holds one file at a time, and no group of its own is set up for it.
    """
    kind = dict(rows.dtypes)
    columns = ["file", "first", "n_parts", "name", "message"]
    wanted = rows.select(F.col(file_col).alias("file"), F.col(order).alias("first"), F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("message"))

    def merged(file, part: list[tuple]) -> Iterator[tuple]:
        places, names, texts = zip(*part, strict=True)
        i = 0
        while i < len(texts):
            j, message = take(texts, names, i)
            yield file, places[i], j - i, names[i], message
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, part, kinds = None, [], None
        make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], columns)
        for batch in slices(batches, SLICE_ROWS):
            out = []
            kinds = (batch["file"].type, batch["first"].type, pa.int32(), pa.string(), pa.string())
            for key, place, name, text in zip(*(batch[c].to_pylist() for c in ("file", "first", "name", "message")), strict=True):
                if part and key != file:
                    out += merged(file, part)
                    part = []
                file = key
                part.append((place, name, text or ""))
            if out:
                yield make(out)
        if part:
            yield make(list(merged(file, part)))

    sorted_rows = wanted.repartition("file").sortWithinPartitions("file", F.asc_nulls_last("first"))
    return sorted_rows.mapInArrow(run, f"file {kind[file_col]}, first {kind[order]}, n_parts int, name string, message string")


def merge_unclosed(rows: DataFrame, file_col: str, order: str, name_col: str, text_col: str, look_ahead: int = 8) -> DataFrame:
    """``file, first, n_parts, name, message``: a record with an open bracket takes up those after it, at most ``look_ahead``."""

    def take(texts: list, names: list, i: int) -> tuple[int, str]:
        j, open_ = i + 1, balance(texts[i])
        while open_ > 0 and j < len(texts) and j - i <= look_ahead:
            open_ += balance(texts[j])
            j += 1
        return j, "".join(texts[i:j])

    return _merged(rows, file_col, order, name_col, text_col, take)


_PAIRS = {"「": "」", "（": "）", "(": ")"}


def merge_speaker_lines(rows: DataFrame, file_col: str, order: str, speaker_col: str, text_col: str, most: int = 3) -> DataFrame:
    """``file, first, n_parts, name, message``: lines of one speaker joined with CRLF.

    A line whose opening bracket closes stands alone; an open one runs on to the line that closes any bracket; other lines
    gather, at most ``most``, until a bracket opens. A change of speaker ends all of them.
    """

    def closes(x: str) -> bool:
        return "」" in x or "）" in x or ")" in x

    def take(texts: list, names: list, i: int) -> tuple[int, str]:
        t, j = texts[i], i + 1
        if t[:1] in _PAIRS and _PAIRS[t[0]] in t:
            pass
        elif t[:1] in _PAIRS and not closes(t):
            while j < len(texts) and names[j] == names[i]:
                j += 1
                if closes(texts[j - 1]):
                    break
        else:
            while j < len(texts) and j - i < most and names[j] == names[i] and texts[j][:1] not in _PAIRS:
                j += 1
        return j, "\r\n".join(texts[i:j])

    found = _merged(rows, file_col, order, speaker_col, text_col, take)
    return found.withColumn("name", F.nullif("name", F.lit("")))


def align_inserts(new: DataFrame, old: DataFrame, file_col: str, order: str) -> DataFrame:
    """Old translations carried over to a new item list that only has insertions.

    ``new(file, order, name, message)``, ``old(file, order, name, message, trans_name, trans)``. Out: ``file, order, name,
    message, fix``: translated where the messages agree (``new_name``: only the new item has a name), else the new
    item itself (``new_item``).
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order, kind="stable"), b.sort_values(order, kind="stable")
        out, at, known = [], 0, b.to_dict("records")
        for r in a.to_dict("records"):
            name, message, fix = r["name"], r["message"], "new_item"
            if at < len(known) and known[at]["message"] == message:
                o = known[at]
                at += 1
                fix = "new_name" if pd.isna(o["name"]) and not pd.isna(name) else None
                name, message = (name if fix else o["trans_name"]), o["trans"]
            out.append((r[file_col], r[order], None if pd.isna(name) else name, message, fix))
        return pd.DataFrame(out, columns=["file", "seq", "name", "message", "fix"])

    kind = dict(new.dtypes)
    pair = new.groupBy(file_col).cogroup(old.groupBy(file_col))
    return pair.applyInPandas(run, f"file {kind[file_col]}, seq {kind[order]}, name string, message string, fix string")
