"""Reports of an import: what was cut, left, repeated or can't be encoded (survey A10, A11, A13, D12, D13, X16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schema of a text configuration.
TEXT_CONFIG = (
    "replace_before_split map<string,string>, trans_replace map<string,map<string,string>>, orig_replace map<string,string>, "
    "name_replace map<string,string>, orig_keep map<string,array<string>>, dynamic_replace array<string>"
)


def text_config(texts: DataFrame, col: str = "text") -> DataFrame:
    return texts.select(F.from_json(col, TEXT_CONFIG).alias("conf")).select("conf.*")


def charset_pairs(table: dict[str, dict[str, str]], charset: str) -> dict[str, str]:
    """Replacements for a charset: those whose key contains its lower-cased name, in order."""
    out: dict[str, str] = {}
    for key, pairs in table.items():
        if charset.lower() in key:
            out |= pairs
    return out


def cut_report(rows: DataFrame, diff: Column, text_col: str, copy: bool = True) -> DataFrame:
    """``key, replacement, diff`` of translations that are too long, each once with its worst difference."""
    worst = rows.select(F.col(text_col).alias("key"), diff.alias("diff")).where("diff < 0").groupBy("key").agg(F.min("diff").alias("diff"))
    return worst.select("key", (F.col("key") if copy else F.lit("")).alias("replacement"), "diff")


def used_characters(rows: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """``ch, first, n``: distinct characters as first seen."""
    chars = rows.select(*order, F.posexplode(F.split(text_col, "")).alias("at", "ch")).where("ch <> ''")
    return chars.groupBy("ch").agg(F.min(F.struct(*order, "at")).alias("first"), F.count("*").alias("n"))


def substitution_report(chars: DataFrame, table: DataFrame) -> DataFrame:
    """``ch, substitute, state``: ``ok``, ``missing`` (no substitute) or ``repeat`` (two characters share one)."""
    joined = chars.select("ch").join(table.select("ch", "substitute"), "ch", "left")
    shared = joined.where("substitute is not null").groupBy("substitute").agg(F.count("*").alias("k"))
    state = F.when(F.col("substitute").isNull(), "missing").when(F.col("k") > 1, "repeat").otherwise("ok")
    return joined.join(shared, "substitute", "left").select("ch", "substitute", state.alias("state"))


def reason_counts(rows: DataFrame, reasons: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """How many rows each reason holds for."""
    return rows.groupBy(*(group or [])).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in reasons.items()])


#: Levels of messages, the least important first.
LEVELS = ("debug", "info", "tip", "warning", "error")


def at_least(reports: DataFrame, level: str, level_col: str = "level") -> DataFrame:
    """Messages of a level and above."""
    return reports.where(F.col(level_col).isin(*LEVELS[LEVELS.index(level) :]))
