"""Look-ups by range, order and neighbourhood (survey J8 to J22, W7, W11 to W13, P24, P25)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_forward(rows: DataFrame, keys: DataFrame, on: str, value: str, partition: list[str]) -> DataFrame:
    """``rows`` plus ``found_key, found``: the nearest key at or after ``on`` in ``keys(partition, on, value)``.

    A union and one window instead of a range join: each row looks ahead to the first key row of its partition.
    """
    k = keys.select(*partition, F.col(on), F.col(value).alias("_v"), F.lit(1).alias("_is_key"))
    r = rows.withColumn("_v", F.lit(None).cast(keys.schema[value].dataType)).withColumn("_is_key", F.lit(0))
    both = r.unionByName(k, allowMissingColumns=True)
    # at equal places rows stand before keys, so that a key there is found
    w = Window.partitionBy(*partition).orderBy(on, "_is_key").rowsBetween(0, Window.unboundedFollowing)
    hit = F.first(F.when(F.col("_is_key") == 1, F.struct(F.col(on).alias("k"), "_v")), ignorenulls=True).over(w)
    found = both.withColumn("_hit", hit).where("_is_key = 0")
    return found.select(*rows.columns, F.col("_hit.k").alias("found_key"), F.col("_hit._v").alias("found"))


def nearest_value(target: Column, values: Column) -> Column:
    """The element of an ascending array nearest to ``target``; of two equally near the left one."""
    return F.array_sort(F.transform(values, lambda v: F.struct(F.abs(v - target).alias("d"), v.alias("v"))))[0]["v"]


def range_lookup(value: Column, table: list[tuple[int, int, str]]) -> Column:
    """The label of the first (low, high, label) whose closed range holds the value; null for none."""
    return reduce(lambda rest, row: F.when(value.between(row[0], row[1]), F.lit(row[2])).otherwise(rest), reversed(table), F.lit(None).cast("string"))


def running_offsets(rows: DataFrame, length: Column, partition: list[str], order: list[str]) -> DataFrame:
    """``offset`` of each unit, the sum of the lengths before it, and ``next_offset`` (null for the last)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return rows.withColumn("offset", before).withColumn("next_offset", F.lead("offset").over(w))


def shift_addresses(addresses: DataFrame, deltas: DataFrame, partition: list[str], addr: str = "addr", point: str = "point", diff: str = "diff") -> DataFrame:
    """``shifted``: an address plus the deltas of all points before it. A union and a running sum, no range join."""
    d = deltas.select(*partition, F.col(point).alias("_at"), F.col(diff).alias("_d"), F.lit(1).alias("_kind"))
    a = addresses.withColumn("_at", F.col(addr)).withColumn("_d", F.lit(0)).withColumn("_kind", F.lit(0))
    both = a.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(*partition).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shifted", F.col(addr) + F.sum("_d").over(w)).where("_kind = 0").drop("_at", "_d", "_kind")


def context_valid(line: Column, patterns: dict[int, str], partition: list[str], order: list[str]) -> Column:
    """Whether the lines at given distances (negative: before) match their patterns; a missing line doesn't."""
    w = Window.partitionBy(*partition).orderBy(*order)
    at = lambda k: line if k == 0 else F.lead(line, k).over(w) if k > 0 else F.lag(line, -k).over(w)
    return reduce(lambda a, b: a & b, [F.coalesce(F.regexp_like(at(k), F.lit(p)), F.lit(False)) for k, p in sorted(patterns.items())])


def copy_previous(line: Column, matches: Column, partition: list[str], order: list[str]) -> Column:
    """Lines that match take the text of the last line before them that doesn't; chains copy on."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    source = F.last(F.when(~matches, line), ignorenulls=True).over(w)
    return F.when(matches, F.coalesce(source, line)).otherwise(line)


def look_back(value: Column, barrier: Column, partition: list[str], order: list[str], rows: DataFrame, most: int = 19, name: str = "found") -> DataFrame:
    """``name``: the nearest value at most ``most`` rows before, not beyond a barrier row (which itself isn't looked at)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    run = F.sum(barrier.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*partition, "_run").orderBy(*order).rowsBetween(-most, -1)
    return rows.withColumn("_run", run).withColumn("_stop", barrier).withColumn(name, F.last(F.when(~F.col("_stop"), value), ignorenulls=True).over(back)).drop("_run", "_stop")


def carry_pages(rows: DataFrame, kind: Column, speaker: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Dialogue strings with their speaker and page. ``kind``: ``text``, ``page``, ``name``, or anything else (another call).

    The speaker is the last name before; a string survives if the next row that is neither text nor name is a page; pages
    are numbered from 0, without the empty ones.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = rows.withColumn("_kind", kind)
    said = F.last(F.when(F.col("_kind") == "name", speaker), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.first(F.when(~F.col("_kind").isin("text", "name"), F.col("_kind")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    page = F.sum((F.col("_kind") == "page").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("speaker", said).withColumn("_ends", ends).withColumn("_page", F.coalesce(page, F.lit(0))).where("_kind = 'text' and _ends = 'page'")
    return kept.withColumn("page", F.dense_rank().over(Window.partitionBy(*partition).orderBy("_page")) - 1).drop("_kind", "_ends", "_page")


def compare_sides(left: DataFrame, right: DataFrame, key: str, content: str) -> DataFrame:
    """``key, state``: ``missing`` on the right or ``diff`` in content; rows that only the right has aren't reported."""
    r = right.select(key, F.sha2(content, 256).alias("_r"), F.lit(True).alias("_there"))
    joined = left.select(key, F.sha2(content, 256).alias("_l")).join(r, key, "left")
    state = F.when(F.col("_there").isNull(), "missing").when(~F.col("_l").eqNullSafe(F.col("_r")), "diff")
    return joined.select(key, state.alias("state")).where("state is not null")


def unreferenced(ids: DataFrame, *used: DataFrame, key: str) -> DataFrame:
    """Ids that none of the other tables has."""
    return reduce(lambda rest, u: rest.join(u.select(key).distinct(), key, "left_anti"), used, ids.select(key).distinct())


def two_hop(calls: DataFrame, functions: DataFrame, names: DataFrame) -> DataFrame:
    """``calls(addr)`` with the speaker of their function: address to id to name, ``chr_<id>`` where an id has no name."""
    joined = calls.join(functions.select("addr", "chr_id"), "addr", "left").join(names.select("chr_id", F.col("name").alias("_n")), "chr_id", "left")
    return joined.withColumn("speaker", F.coalesce("_n", F.concat(F.lit("chr_"), F.col("chr_id")))).drop("_n")


def custom_order(rows: DataFrame, order: DataFrame, key: str, last: int = 999999) -> DataFrame:
    """``sort_key``: the place that an order table gives a name, unknown names last."""
    return rows.join(order.select(key, F.col("ord").alias("_o")), key, "left").withColumn("sort_key", F.coalesce("_o", F.lit(last))).drop("_o")


def update_by_id(rows: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` replaced where ``updates`` has the row's id."""
    joined = rows.join(updates.select(key, F.col(value).alias("_new")), key, "left")
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_new")


def learned_names(rows: DataFrame, variable: Column, definition: Column, partition: list[str], order: list[str], name: str = "learned") -> DataFrame:
    """The name a variable stands for: that of its first definition in the file, which is the text right after it."""
    w = Window.partitionBy(*partition).orderBy(*order)
    rows = rows.withColumn("_var", variable).withColumn("_def", F.when(definition, F.lead("text").over(w)))
    first = Window.partitionBy(*partition, "_var").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.first("_def", ignorenulls=True).over(first)).drop("_var", "_def")


def jump_targets(commands: DataFrame, file_cols: list[str], address: str, target: str, least: int = 0) -> DataFrame:
    """``commands`` plus ``target_no``: the number of the command that stands at a jump's target; null where none does.

    Targets below ``least`` aren't jumps. ``commands`` has ``command_no``.
    """
    places = commands.select(*file_cols, F.col(address).alias(target), F.col("command_no").alias("target_no"))
    return commands.join(places.where(F.col(target) >= least), [*file_cols, target], "left")
