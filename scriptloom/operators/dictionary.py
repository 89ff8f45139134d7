"""Translation dictionaries: first-seen keys, many values, joins by occurrence (survey A1 to A11, J1 to J6, W8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh
from .scan import positions


#: Bits of the order behind its first column, in a decimal of 38 digits.
_REST = 62


def packed_order(rows: DataFrame, order: list[str]) -> Column | None:
    """One number that sorts as ``order`` does, or None where its columns don't fit.

    A struct can't be a hash aggregate's value, a decimal can: so the first whole number takes the high digits and up to two
    more, places that count from 0, take 31 bits each (a negative one is an error).
    """
    kinds = dict(rows.dtypes)
    if any(kinds[c] not in ("bigint", "int", "smallint", "tinyint") for c in order) or len(order) > 3 or any(kinds[c] == "bigint" for c in order[1:]):
        return None
    packed = F.col(order[0]).cast("decimal(38,0)") * F.lit(1 << _REST).cast("decimal(19,0)")
    for k, c in enumerate(order[1:]):
        place = F.when(F.col(c) < 0, F.raise_error(F.lit(f"a place in {c} is negative")).cast("long")).otherwise(F.col(c).cast("long"))
        packed = packed + F.call_function("shiftleft", place, F.lit(31 * (1 - k)))
    return packed.cast("decimal(38,0)")


def _whole_part(a: Column, b: Column) -> Column:
    """The integer quotient of two decimals, as a long."""
    return F.call_function("div", a.cast("decimal(38,0)"), b)


def unpacked_order(packed: Column, rows: DataFrame, order: list[str]) -> Column:
    """The struct of ``order`` that :func:`packed_order` made a number of."""
    whole = F.lit(1 << _REST).cast("decimal(19,0)")
    rest = F.pmod(packed, whole).cast("long")
    high = _whole_part(packed - rest.cast("decimal(19,0)"), whole)
    kinds = dict(rows.dtypes)
    parts = [high.cast(kinds[order[0]]).alias(order[0])]
    for k, c in enumerate(order[1:]):
        parts.append(F.call_function("shiftright", rest, F.lit(31 * (1 - k))).bitwiseAND(F.lit((1 << 31) - 1)).cast(kinds[c]).alias(c))
    return F.struct(*parts)


def first_seen(rows: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """``text, first``: each distinct text and the place, a struct of ``order``, where it is first seen.

    One partial aggregate, by hash where the order can be packed into a number.
    """
    packed = packed_order(rows, order)
    if packed is None:
        return rows.groupBy(F.col(text_col).alias("text")).agg(F.min(F.struct(*order)).alias("first"))
    found = rows.groupBy(F.col(text_col).alias("text")).agg(F.min(packed).alias("_first"))
    return found.select("text", unpacked_order(F.col("_first"), rows, order).alias("first"))


def names_and_messages(items: DataFrame, order: list[str]) -> DataFrame:
    """First-seen dictionary of names and messages; an item's name comes before its message, an empty filler doesn't count."""
    names = items.where("name is not null").select(*order, F.lit(0).alias("part"), F.col("name").alias("text"))
    messages = items.where("message <> '' or name is null").select(*order, F.lit(1).alias("part"), F.col("message").alias("text"))
    return first_seen(names.unionByName(messages), "text", [*order, "part"])


def occurrence_join(rows: DataFrame, translations: DataFrame, order: list[str], text_col: str = "text", allow_empty: bool = False, most: int | None = None) -> DataFrame:
    """``rows`` plus ``translated``: dictionary values dealt to the occurrences of their key, from the end.

    ``translations`` has ``text, trans array<string>``; its keys are distinct, and ``order`` tells the occurrences of a key
    apart. The r-th occurrence from the end takes value ``max(m - r + 1, 1)`` of m. Unknown keys keep their text, and so do
    empty values unless ``allow_empty``. ``most``: the length of the longest ``trans``, where it is known; else one job finds it.

    Only the last m - 1 occurrences of a key get another value than its first. So ranks are taken of these alone, by a window
    with a fixed limit that drops all others before the shuffle: the commonest line of a corpus isn't sorted as a whole. Their places
    go to the dictionary's side, a short list for each key, and the rows are joined once.
    """
    trans, lasts, rank, at = fresh(rows, "_trans", "_lasts", "_rank", "_at")
    table = translations.select(F.col("text").alias(text_col), F.col("trans").alias(trans))
    if most is None:
        most = table.agg(F.max(F.size(trans))).first()[0] or 0
    if most > 1:
        last = Window.partitionBy(text_col).orderBy(*[F.desc(c) for c in order])
        ranked = rows.select(text_col, *order).withColumn(rank, F.row_number().over(last)).where(F.col(rank) < most)
        places = ranked.groupBy(text_col).agg(F.collect_list(F.struct(F.struct(*order).alias(at), F.col(rank).alias(rank))).alias(lasts))
        joined = rows.join(table.join(places, text_col, "left"), text_col, "left")
        own = F.get(F.filter(lasts, lambda x: x[at] == F.struct(*order)), F.lit(0))[rank]
    else:
        joined, own = rows.join(table, text_col, "left"), F.lit(1)
    first = F.element_at(trans, 1)
    by_rank = F.element_at(trans, F.greatest(F.size(trans) - own + 1, F.lit(1)))
    value = F.when(F.size(trans) > 0, F.when(own.isNull(), first).otherwise(by_rank))
    kept = F.coalesce(value if allow_empty else F.when(value != "", value), F.col(text_col))
    return joined.select(*rows.columns, kept.alias("translated"))


def overlay(layers: DataFrame, value: str, layer: str, order: list[str], text_col: str = "text") -> DataFrame:
    """``text, value, layer, first`` of dictionaries in layers, such as appended folders: a key has the value of its newest layer.

    Inside a layer the last value in the order counts. ``first`` is the place where the key is seen first, in the oldest
    layer that has it, so a new layer doesn't move old keys. A null layer is the oldest; null values count like others.
    """
    places = [layer, *order]
    newest = F.max_by(F.struct(value, layer), F.struct(*places))
    found = layers.groupBy(F.col(text_col).alias("text")).agg(newest.alias("_new"), F.min(F.struct(*places)).alias("first"))
    return found.select("text", F.col("_new")[value].alias(value), F.col("_new")[layer].alias(layer), "first")


def unlayered(rows: DataFrame, layers: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text no layer has: what the next layer is made of. One anti-join against all layers; null texts stay."""
    return rows.join(layers.select(text_col).distinct(), text_col, "left_anti")


def keep_first(translations: DataFrame) -> DataFrame:
    """A dictionary with the first value of each key only."""
    return translations.withColumn("trans", F.slice("trans", 1, 1))


def positional_zip(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str], left_col: str, right_col: str) -> DataFrame:
    """``pos, left, right`` of two ordered lists; raises where their lengths differ.

    Positions come from a range partitioning and partition offsets, so neither list passes through one task.
    """
    a = with_position(left, order_left).select("pos", F.col(left_col).alias("left"))
    b = with_position(right, order_right).select("pos", F.col(right_col).alias("right"), F.lit(True).alias("_there"))
    a = a.withColumn("_here", F.lit(True))
    both = a.join(b, "pos", "full_outer")
    uneven = F.col("_here").isNull() | F.col("_there").isNull()
    checked = F.when(uneven, F.raise_error(F.lit("the lists differ in length")).cast("string")).otherwise(F.col("right"))
    return both.select("pos", "left", checked.alias("right"))


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` plus its position, from 0, in the order, which may be of any columns."""
    return positions(df, order, name)


def append_lines(new: DataFrame, old: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text the old dictionary doesn't have."""
    return new.join(old.select(F.col(text_col)).distinct(), text_col, "left_anti")


def append_items(items: DataFrame, old: DataFrame, texts: Column, text_col: str = "text") -> DataFrame:
    """Items of which any of ``texts`` (an array column) is new."""
    own, = fresh(items, "_t")
    exploded = items.withColumn(own, F.explode(texts))
    new = exploded.join(old.select(F.col(text_col).alias(own)).distinct(), own, "left_anti")
    return new.select(*items.columns).distinct()


def replace_names(rows: DataFrame, names: DataFrame, name_col: str, when: Column | None = None) -> DataFrame:
    """``name_col`` replaced by ``names(old, new)`` where it equals an old name; names in the table are distinct."""
    new, = fresh(rows, "_new")
    joined = rows.join(names.select(F.col("old").alias(name_col), F.col("new").alias(new)), name_col, "left")
    hit = F.col(new).isNotNull() & (when if when is not None else F.lit(True))
    return joined.withColumn(name_col, F.when(hit, F.col(new)).otherwise(F.col(name_col))).drop(new)


def last_wins(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Union of dictionaries in which a later value replaces an earlier one, at the earlier one's place."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("first"))


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, and ``n_skipped``: a partial aggregate, not a window, so hot keys don't gather."""
    value = F.struct(*order, *[c for c in rows.columns if c not in (*order, *keys)])
    found = rows.groupBy(*keys).agg(F.min(value).alias("_v"), (F.count("*") - 1).alias("n_skipped"))
    return found.select(*keys, "_v.*", "n_skipped")


def conflicts(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the first one written for their key."""
    first = rows.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("first_value"))
    return rows.join(first, keys).where(~F.col(value).eqNullSafe(F.col("first_value")))


def file_markers(files: DataFrame, order: str) -> DataFrame:
    """``marker``: 1 for the first file of a list, 3 for the last, 2 in between; a single file is first."""
    low, high = files.agg(F.min(order), F.max(order)).first()
    return files.withColumn("marker", F.when(F.col(order) == F.lit(low), 1).when(F.col(order) == F.lit(high), 3).otherwise(2))
