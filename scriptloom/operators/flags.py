"""Flags that reach back to the capture before, and intervals that hold until they end (survey W1 to W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ExtractConfig, RuleProgram


def stand_alone(program: RuleProgram) -> bool:
    """Whether no capture's keys depend on other lines: flags reach back only with a paragraph structure, and without intervals
    all that a line can do to the capture before it is to end what is unfinished."""
    roles = [r for rule in program.rules if rule.kind == "search" for r in rule.roles()]
    return not program.config.structure.startswith("para") and all(r.interval is None and "unfinish" not in r.keys for r in roles)


def own_captures(events: DataFrame, file_cols: list[str], line_col: str = "line_no") -> DataFrame:
    """What :func:`captures` gives where captures :func:`stand_alone`, line by line: no window, no shuffle."""
    rows = events.where("kind = 'match'").select(*file_cols, line_col, F.posexplode(F.filter("captures", lambda c: c["text"] != "")).alias("cap_no", "c"))
    return rows.select(*file_cols, line_col, "cap_no", "c.start", "c.end", "c.text", "c.keys", "c.type")


def captures(events: DataFrame, config: ExtractConfig, file_cols: list[str], line_col: str = "line_no") -> DataFrame:
    """One row for each capture: ``file_cols, line_no, cap_no, start, end, text, keys, type`` after all flags.

    Only the next event of the file touches a line's last capture, so one window over the file's events is enough: the flags
    of the following match (and a skip's own) are brought back with ``lead`` and folded into the capture's keys.
    """
    events = _with_intervals(events, config, file_cols, line_col)
    w = Window.partitionBy(*file_cols).orderBy(line_col)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    # what a matched line does to the capture before it: each capture's own flags, and a name ends what is unfinished
    ops = F.flatten(F.transform("captures", lambda c: F.concat(c.flags, F.when(F.array_contains(c["keys"], "name"), F.array(F.lit("-unfinish"))).otherwise(F.array().cast("array<string>")))))
    lines = events.withColumn("ops", F.when(F.col("kind") == "match", ops)).where((F.col("kind") == "skip") | (F.size("captures") > 0))
    lines = lines.withColumn("next_kind", F.lead("kind").over(w)).withColumn("next_ops", F.first("ops", ignorenulls=True).over(after))
    none = F.array().cast("array<string>")
    skip_ops = none if config.skip_ignore_unfinish else F.array(F.lit("-unfinish"))
    reached = F.when(F.col("next_kind") == "match", F.coalesce("next_ops", none)).when(
        F.col("next_kind") == "skip", F.concat(skip_ops, F.coalesce("next_ops", none)) if config.skip_ignore_ctrl else skip_ops
    ).otherwise(none)
    rows = lines.select(*file_cols, line_col, "kind", F.size("captures").alias("n"), reached.alias("reached"), F.posexplode_outer("captures").alias("cap_no", "c"))
    rows = rows.where("kind = 'match' and c is not null")
    is_last = F.col("cap_no") == F.col("n") - 1
    live = is_last if config.name_keep_ctrl else is_last & ~F.array_contains("c.keys", "name")

    def fold(keys, op):
        key = F.substring(op, 2, 1 << 20)
        blocked = F.coalesce(F.contains(F.col("c.blocks"), key), F.lit(False))
        return F.when(F.substring(op, 1, 1) == "-", F.array_remove(keys, key)).when(blocked, keys).otherwise(F.array_union(keys, F.array(key)))

    held = F.when(F.col("c.interval") != "", F.array_union("c.keys", F.array("c.interval"))).otherwise(F.col("c.keys"))
    keys = F.aggregate(F.when(live, F.col("reached")).otherwise(none), held, fold)
    return rows.select(*file_cols, line_col, "cap_no", "c.start", "c.end", "c.text", keys.alias("keys"), "c.type")


def _with_intervals(events: DataFrame, config: ExtractConfig, file_cols: list[str], line_col: str) -> DataFrame:
    """``events`` whose captures' ``interval`` is the key that holds there ('' for none), without empty captures.

    Inside a line, what holds at a capture is the last start or end up to it; before that, the last of an earlier line, unless
    a skip came between. So lines are the rows of the window, not captures.
    """
    last = lambda until: F.element_at(F.filter(F.transform(F.slice("captures", 1, until), lambda c: c["interval"]), lambda x: x.isNotNull()), -1)
    said = F.when(F.size(F.filter("captures", lambda c: c["interval"].isNotNull())) > 0, last(F.size("captures")))
    reset = F.lit(None).cast("string") if config.skip_ignore_unfinish else F.when(F.col("kind") == "skip", F.lit(""))
    before = Window.partitionBy(*file_cols).orderBy(line_col).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_said", F.coalesce(said, reset))
    rows = rows.withColumn("_held", F.coalesce(F.last("_said", ignorenulls=True).over(before), F.lit("")))
    state = F.struct(F.col("_held").alias("held"), F.array().cast(events.schema["captures"].dataType).alias("out"))

    def step(s, c):
        held = F.coalesce(c["interval"], s["held"])
        kept = F.when(c["text"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(c.withField("interval", held))))
        return F.struct(held.alias("held"), kept.alias("out"))

    return rows.withColumn("captures", F.aggregate("captures", state, step)["out"]).drop("_said", "_held")


def fill_interval(df: DataFrame, starts, ends, partition: list[str], order: list[str], name: str = "inside") -> DataFrame:
    """``name``: whether the row stands from a start (included) to an end (excluded)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(starts, True).when(ends, False)
    return df.withColumn(name, F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))
