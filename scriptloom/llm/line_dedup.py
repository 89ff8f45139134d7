"""Repeated passages of three lines and more, removed after their first occurrence; DataFrame functions only.

Every three consecutive lines of a text are a window, hashed with MD5 (128 bits) over the lines. A window that occurs
more than once in the corpus keeps its first occurrence, by (doc_id, text hash, line); all later ones are dropped. The
windows overlap, so a longer passage is covered by several of them: the lines to remove are the union of the covered
positions. Counting is a partial aggregate over window hashes; the join back to the occurrences moves only hashes and
positions, and adaptive execution splits a hot hash there.

Only texts that lose lines have to meet their removed positions. A bitmap of fixed size tells the scan which may
(:func:`maybe_in`); all others are written as they are. With far more than 2**26 texts that lose lines, all move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh, materialise, maybe_in

WINDOW_LINES = 3


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, pos, key`` for each window."""
    lines = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash"),
        F.split(F.col(text_col).cast("string"), "\n", -1).alias("lines"),
    ).where(F.col("doc_id").isNotNull() & (F.size("lines") >= WINDOW_LINES))
    keys = F.transform(
        F.sequence(F.lit(1), F.size("lines") - WINDOW_LINES + 1),
        lambda i: F.unhex(F.md5(F.array_join(F.slice("lines", i, WINDOW_LINES), "\n"))),
    )
    return lines.select("doc_id", "text_hash", F.posexplode(keys).alias("pos", "key"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, removed array<int>``: the lines, from 0, that later occurrences of windows cover."""
    windows = materialise(_windows(docs, id_col, text_col), "windows")
    first = (
        windows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
        .where("n > 1")
        .select("key", "first")
    )
    later = windows.join(first, "key").where(F.struct("doc_id", "text_hash", "pos") != F.col("first"))
    covered = later.select("doc_id", "text_hash", F.explode(F.sequence("pos", F.col("pos") + WINDOW_LINES - 1)).alias("pos"))
    return covered.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("removed"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cleaned, and ``n_lines int, n_removed int`` (suffixed with ``_`` where the names are taken).

    Lines are parts between newlines, compared as they are, blank ones too. Texts of fewer than three lines, null texts
    and rows with a null id are returned as they are. Rows that repeat both id and text are one document: all get the same
    result, and none counts as a later occurrence of another. Empty tables give empty results. A line inside the first
    occurrence of one window is removed too where a later occurrence of another window covers it: every removed line
    still stands earlier in the corpus.
    """
    removed = materialise(repeated_lines(docs, id_col, text_col), "removed")
    doc, text_hash, gone, loses, parts = (fresh(docs, n) for n in ("_doc", "_text_hash", "_removed", "_loses", "_lines"))
    text = F.col(text_col).cast("string")
    source = docs.withColumn(doc, F.col(id_col).cast("long")).withColumn(text_hash, F.xxhash64(F.coalesce(text, F.lit(""))))
    source = maybe_in(source, [F.col(doc), F.col(text_hash)], removed, [F.col("doc_id"), F.col("text_hash")], loses)
    removed = removed.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("removed").alias(gone))
    # the lines are cut before the join, once a text: inside a lambda they would be cut again for each position
    lines, others = F.split(text, "\n", -1), source.where(~F.col(loses))
    met = source.where(F.col(loses)).withColumn(parts, lines).drop(text_col)
    # a merge join at every size: what is removed grows with the corpus, so no plan may count on broadcasting it
    met = met.join(removed.hint("merge"), [doc, text_hash], "left")
    # array_except hashes the positions, so a text costs its lines and not their square
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    cleaned = F.array_join(F.transform(kept, lambda k: F.get(parts, k)), "\n")

    def out(rows: DataFrame, new: Column, n_lines: Column, n_removed: Column) -> DataFrame:
        columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
        return rows.select(*columns, n_lines.alias(fresh(docs, "n_lines")), n_removed.alias(fresh(docs, "n_removed")))

    changed = out(met, cleaned, F.size(parts), F.coalesce(F.array_size(gone), F.lit(0)))
    return changed.unionByName(out(others, F.col(text_col), F.when(text.isNull(), 0).otherwise(F.size(lines)), F.lit(0)))
