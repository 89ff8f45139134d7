"""Scans of a table in its order: positions, neighbours and carried values over files and corpora of any size.

A window over a file holds the whole file in one task. Here the order is range-partitioned, by splitters that Spark samples from
the whole order, and written once. What crosses the border of a partition is one row a partition: a count, a last value or a
first one. These rows, as many as partitions, are scanned together; everything else stays inside its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh, written


def _placed(rows: DataFrame, order: list[str]) -> tuple[DataFrame, str, str]:
    """``rows``, range-partitioned and written, with the partition of each and its place in the order (ascending, with gaps)."""
    part, place = fresh(rows, "_part", "_place")
    keys = [F.asc_nulls_first(c) for c in order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = sorted_rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id())
    return written(numbered, "ordered"), part, place


def positions(rows: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """``rows`` and the position of each, from 0, in the order (nulls first). Rows that tie stand in any order."""
    placed, part, place = _placed(rows, order)
    first, count, before = fresh(placed, "_first", "_count", "_before")
    parts = placed.groupBy(part).agg(F.min(place).alias(first), F.count("*").alias(count))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select(part, first, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    found = placed.join(F.broadcast(parts), part).withColumn(before, F.col(place) - F.col(first) + F.col(before))
    return found.select(*rows.columns, F.col(before).alias(name))


def carried(rows: DataFrame, value: Column | str, order: list[str], name: str, keys: list[str] | None = None, inclusive: bool = True) -> DataFrame:
    """``rows`` and ``name``: the last value that isn't null at or before each row, of rows with equal ``keys`` (null equals null).
    A value that is the name of a column is that column.

    ``inclusive=False``: strictly before it. A key may have any share of the rows: it is cut like the rest of the order.
    """
    keys = keys or []
    key, own = fresh(rows, "_key", "_value")
    own = value if isinstance(value, str) else own
    # the columns of a key move inside it alone
    marked = (rows if isinstance(value, str) else rows.withColumn(own, value)).withColumn(key, F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))).drop(*keys)
    placed, part, place = _placed(marked, [key, *[c for c in order if c not in keys]])
    inside, strict, first, last, carry, kind = fresh(placed, "_inside", "_strict", "_first", "_last", "_carry", "_kind")
    w = Window.partitionBy(part, key).orderBy(place)
    seen = placed.withColumn(inside, F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumn(strict, F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    edges = seen.groupBy(part).agg(F.min_by(key, place).alias(first), F.max_by(F.struct(key, inside), place).alias(last))
    ends = edges.select(part, F.col(last)[key].alias(key), F.col(last)[inside].alias(carry), F.lit(1).alias(kind))
    begins = edges.select(part, F.col(first).alias(key), F.lit(None).cast(placed.schema[own].dataType).alias(carry), F.lit(0).alias(kind))
    border = Window.partitionBy(key).orderBy(part, kind).rowsBetween(Window.unboundedPreceding, 0)
    known = ends.unionByName(begins).withColumn(carry, F.last(carry, ignorenulls=True).over(border)).where(F.col(kind) == 0)
    known = known.select(part, F.col(key).alias(first), carry)
    found = seen.join(F.broadcast(known), part)
    before = F.when(F.col(key).eqNullSafe(F.col(first)), F.col(carry))
    columns = [F.col(key)[c].alias(c) if c in keys else F.col(c) for c in rows.columns]
    return found.select(*columns, F.coalesce(F.col(inside if inclusive else strict), before).alias(name))


def following(rows: DataFrame, value: Column | str, order: list[str], name: str) -> DataFrame:
    """``rows`` and ``name``: the value (a column that is there, or another) of the next row in the order, null for the last."""
    own = value if isinstance(value, str) else fresh(rows, "_value")[0]
    placed, part, place = _placed(rows if isinstance(value, str) else rows.withColumn(own, value), order)
    ahead, final, first, next_first = fresh(placed, "_ahead", "_final", "_first", "_next")
    w = Window.partitionBy(part).orderBy(place)
    seen = placed.withColumn(ahead, F.lead(own).over(w)).withColumn(final, F.lead(F.lit(True)).over(w).isNull())
    parts = placed.groupBy(part).agg(F.min_by(own, place).alias(first)).withColumn(next_first, F.lead(first).over(Window.orderBy(part)))
    found = seen.join(F.broadcast(parts.select(part, next_first)), part)
    return found.select(*rows.columns, F.when(F.col(final), F.col(next_first)).otherwise(F.col(ahead)).alias(name))


def learned_names(rows: DataFrame, variable: str, definition: Column, text: Column, order: list[str], name: str = "learned", keep: list[str] | None = None) -> DataFrame:
    """``rows`` and ``name``: what a variable stands for where it is used, the text after its last definition before that row.

    ``definition`` tells the rows that define their variable; a definition at the end of everything has no text and defines nothing.
    ``keep``: the columns that are wanted, all if it is None. Others don't move: each text does once, to the row before it, and from
    there on only those that define something.
    """
    keep = rows.columns if keep is None else keep
    said, defines, after = fresh(rows, "_said", "_defines", "_after")
    needed = list(dict.fromkeys([*keep, variable, *order]))
    slim = rows.select(*needed, text.alias(said), (definition & F.col(variable).isNotNull()).alias(defines))
    ahead = following(slim, said, order, after)
    # what a definition tells stands at its row alone
    told = ahead.select(*needed, F.when(F.col(defines), F.col(after)).alias(after))
    return carried(told, after, order, name, [variable], inclusive=False).select(*keep, name)


def filled_interval(rows: DataFrame, starts: Column, ends: Column, order: list[str], name: str = "inside") -> DataFrame:
    """``rows`` and whether each lies inside an interval: from a start (itself included) to the next end (itself not)."""
    event = F.when(starts, F.lit(1)).when(ends, F.lit(0))
    last, = fresh(rows, "_event")
    return carried(rows, event, order, last).select(*rows.columns, (F.coalesce(F.col(last), F.lit(0)) == 1).alias(name))


def copied_previous(rows: DataFrame, text: Column, matches: Column, order: list[str], name: str = "text") -> DataFrame:
    """``rows`` and ``name``: a row that matches takes the text of the last row before it that doesn't, if there is one."""
    source, = fresh(rows, "_source")
    found = carried(rows, F.when(~matches, text), order, source, inclusive=False)
    return found.withColumn(name, F.when(matches, F.coalesce(F.col(source), text)).otherwise(text)).drop(source)
