"""The two entry points as dataflows: extract a folder, and import its translations (survey section 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExtractConfig, RuleProgram, separators_kept
from ..functions.text import split_zip
from ..operators import dialogue, dictionary, flags, items, rules, splice
from ..sources.text import lines as split_lines
from ..sources.text import units, with_newline


@dataclass(frozen=True)
class Extracted:
    """What an extraction yields, all of it lazy: captures with positions, items, and both dictionaries."""

    lines: DataFrame
    captures: DataFrame
    items: DataFrame
    lines_dictionary: DataFrame
    items_dictionary: DataFrame


def extract(texts: DataFrame, rule_text: str, config: ExtractConfig = ExtractConfig(), file_col: str = "file", text_col: str = "text") -> Extracted:
    """Runs a rule text over ``file, text`` rows. Flags reach back only with a paragraph structure."""
    program = RuleProgram.parse(rule_text, config)
    config = program.config
    texts = texts.select(file_col, text_col)
    lines = units(texts, config.separate, text_col) if config.separate else split_lines(texts, text_col)
    found = rules.events(lines, program)
    if flags.stand_alone(program):
        captured = flags.own_captures(found, [file_col])
    else:
        if not config.structure.startswith("para"):
            found = found.withColumn("captures", F.transform("captures", lambda c: c.withField("flags", F.array().cast("array<string>"))))
        captured = flags.captures(found, config, [file_col])
    made = items.from_captures(captured, [file_col], config.para_sep)
    if config.name_move_up:
        made = items.move_names_up(made, [file_col])
    order = [file_col, "line_no", "cap_no"]
    return Extracted(lines, captured, made, dictionary.first_seen(captured, "text", order), dictionary.names_and_messages(made, [file_col, "item"]))


def item_translations(items_: DataFrame, translated: DataFrame, order: list[str], config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """``text, trans array<string>`` of translated items (``name, message`` beside ``trans_name, trans``): messages line by
    line, in the order of the items, so that repeated lines get their values by occurrence."""
    pairs = items_.join(translated, order)
    names = pairs.where("name is not null").select(*order, F.lit(-1).alias("line"), F.col("name").alias("text"), F.col("trans_name").alias("t"))
    zipped = F.arrays_zip(F.split("message", "\\Q" + config.para_sep + "\\E", -1).alias("text"), split_zip(F.col("message"), F.col("trans"), config.para_sep, config.add_space, config.add_bytes, config.max_line_count).alias("t"))
    lines = pairs.where("message <> ''").select(*order, F.posexplode(zipped).alias("line", "z")).select(*order, "line", "z.text", "z.t")
    values = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line", "t"))), lambda x: x["t"])
    return names.unionByName(lines).groupBy("text").agg(values.alias("trans"))


def import_translations(texts: DataFrame, rule_text: str, translations: DataFrame, config: ExtractConfig = ExtractConfig(), file_col: str = "file", text_col: str = "text") -> DataFrame:
    """``file, text`` with ``translations(text, trans array)`` put in place; the dominant newline of each file ends its lines.

    Where a pattern separates units, only the spans that change move to their text, each text once and no unit. There a file is
    its name and text, so that rows that share a name, or have none, are files of their own, and a null text stays null.
    """
    program = RuleProgram.parse(rule_text, config)
    config = program.config
    without = ["ignore"] if config.import_names else ["ignore", "name"]
    texts = texts.select(file_col, text_col)
    if config.separate:
        texts = texts.withColumn(file_col, F.struct(F.col(file_col).alias("name"), F.xxhash64(text_col).alias("hash")))
    if config.separate and flags.stand_alone(program):
        chosen = rules.unit_captures(texts, program, file_col, text_col, frozenset(without))
    else:
        found = extract(texts, rule_text, config, file_col, text_col)
        chosen = found.captures.where(~F.arrays_overlap("keys", F.array(*map(F.lit, without))))
    joined = dictionary.occurrence_join(chosen, translations, [file_col, "line_no", "cap_no"], allow_empty=config.allow_empty)
    spans = joined.where(F.col("translated") != F.col("text")).select(file_col, "line_no", "start", "end", "translated")
    if config.separate:
        # separators that are units are there already; others are written as the option says, escapes read
        between = "" if separators_kept(config.separate) else config.separate.encode().decode("unicode_escape")
        done = splice.splice_units(texts, spans, config.separate, between, file_col, text_col)
        return done.select(F.col(file_col)["name"].alias(file_col), F.col(text_col).alias("text"))
    spliced = splice.splice(found.lines, spans, [file_col, "line_no"])
    votes = with_newline(texts.select(file_col, text_col)).select(file_col, "newline")
    return splice.rebuild_files(spliced.join(votes, file_col), file_col, "line_no", "line", F.col("newline"))


def extract_brackets(texts: DataFrame, rule_text: str, config: ExtractConfig = ExtractConfig(), file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Captures of bracketed scripts: ``file, line_no, at, start, end, text, keys, type`` (see :func:`.dialogue.bracket_events`)."""
    program = RuleProgram.parse(rule_text, config)
    found = flags.captures(dialogue.bracket_events(texts, program, file_col, text_col), program.config, [file_col], "at")
    return found.withColumn("line_no", dialogue.line_of(F.col("at")))


def extract_blocks(texts: DataFrame, config: ExtractConfig = ExtractConfig(), file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Captures of block files (see :func:`.dialogue.block_events`)."""
    found = flags.captures(dialogue.block_events(texts, file_col, text_col), config, [file_col], "at")
    return found.withColumn("line_no", dialogue.line_of(F.col("at")))


def extract_bytes(units_: DataFrame, rule_text: str, config: ExtractConfig = ExtractConfig(), keys: tuple[str, ...] = ("file",), order: str = "unit_no") -> DataFrame:
    """Captures of units of bytes, with the place and value of a length in front: what :func:`import_bytes` needs."""
    program = RuleProgram.parse(rule_text, config)
    found = rules.byte_events(units_, program)
    flat = found.where("kind = 'match'").select(*keys, order, F.posexplode("captures").alias("cap_no", "c")).where("c.text <> ''")
    marked = flags.captures(found.withColumn("captures", F.transform("captures", lambda c: c.dropFields("prefix_at", "prefix"))), program.config, list(keys), order)
    places = flat.select(*keys, order, F.col("c.start").alias("start"), "c.prefix_at", "c.prefix")
    return marked.join(places, [*keys, order, "start"])


def import_bytes(units_: DataFrame, rule_text: str, translations: DataFrame, config: ExtractConfig = ExtractConfig(), keys: tuple[str, ...] = ("file",), order: str = "unit_no") -> DataFrame:
    """``units_`` with ``translations(text, trans array)`` put in place, lengths in front made right."""
    found = extract_bytes(units_, rule_text, config, keys, order)
    config = RuleProgram.parse(rule_text, config).config
    joined = dictionary.occurrence_join(found, translations, [*keys, order, "cap_no"], allow_empty=config.allow_empty)
    return splice.splice_bytes(units_, joined, [*keys, order], config)


def import_table(df: DataFrame, columns: dict[str, DataFrame], config: ExtractConfig = ExtractConfig()) -> DataFrame:
    """A table whose cells are translated by dictionaries (``text, trans``; one for each column), ``writeOffset`` columns to the right."""
    values = {}
    for name, table in columns.items():
        firsts = table.select(F.col("text").alias(name), F.element_at("trans", 1).alias(f"_{name}"))
        df = df.join(firsts, name, "left")
        values[name] = F.when(F.col(f"_{name}") != "", F.col(f"_{name}"))
    written = splice.write_shifted(df, list(columns), config.write_offset, values)
    return written.drop(*[f"_{c}" for c in columns])
