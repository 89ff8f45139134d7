"""Ranks and running sums inside groups of any size, with DataFrame functions only.

A window over a whole group would put a hot group into one task. Here the order is cut into buckets by a function that
never decreases along it: bucket totals are summed first, and only the rows of one bucket are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets whose totals are summed together.
SPAN = 64


def hashed_order(*parts: Column) -> Column:
    """A seeded random order that other engines can repeat: the MD5 of the parts, joined by colons, in hex."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hashed_bucket(order: Column, digits: int = 3) -> Column:
    """The bucket of an order made by :func:`hashed_order`: 16**digits even shares, in order."""
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("int")


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """``group, bucket, name``: the sum of ``amount`` over the earlier buckets of the group, and ``extra`` aggregates.

    Two levels: totals of spans of ``SPAN`` buckets are summed along the group, and those of buckets inside their span, so
    that a group with many buckets isn't one task's rows.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_amount"), *[c.alias(n) for n, c in (extra or {}).items()])
    totals = totals.withColumn("_span", F.floor(F.col(bucket) / SPAN).cast("int"))
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda keys, order: F.coalesce(F.sum("_amount").over(earlier(keys, order)), F.lit(0)).cast("long")
    spans = totals.groupBy(*group, "_span").agg(F.sum("_amount").alias("_amount"))
    spans = spans.select(*group, "_span", summed(group, "_span").alias("_spans_before"))
    inside = totals.withColumn("_before_inside", summed([*group, "_span"], bucket))
    found = inside.join(spans, [*group, "_span"])
    return found.select(*group, bucket, (F.col("_spans_before") + F.col("_before_inside")).alias(name), *(extra or {}))


def ranks(df: DataFrame, group: list[str], bucket: str, order: list[str], name: str, bounded: bool = False) -> DataFrame:
    """``df`` and the rank, from 0, of each row in its group. ``bounded``: groups times buckets have a proven bound."""
    offsets = bucket_offsets(df, group, bucket, F.lit(1), "_before")
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(F.broadcast(offsets) if bounded else offsets, [*group, bucket])
    return joined.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside")
