"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame functions only.

Every input partition is a run, aggregated by digest before anything moves. Partitions then exchange runs in binomial rounds
(recursive halving with a fan of ``2**k`` instead of 2). A run has a place, a number of ``ROUNDS`` digits of k bits: at first
its partition's. In a round the partitions whose places differ in one digit exchange parts of their sorted runs: each row
goes where that digit equals the one of its digest, so ``2**k`` runs meet in one place and are merged by a sorted aggregate,
which keeps the identifier that stays and adds the group sizes. After the last round all digits of a place are the digest's,
so one merged run is spread over all places in digest order.

A row moves once a round; a group shrinks at every level, to one row for each run that is left, so copies of one text are
never gathered, and no place gets more than ``2**k`` rows of a digest. The fan follows the number of partitions, so places
are as many as these, and a place holds about what a partition held.

The key of a group is the SHA-256 of the text, its length and a second, independent 64-bit hash; all of them are compared
when rows are merged. That verifies a match at every level without moving texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import fresh, materialise

#: Rounds, and the bits of a digit at most: 2**(3 * 6) places.
ROUNDS = 3
MAX_BITS = 6

_KEY = ["digest", "n_bytes", "second"]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _key(text: Column) -> list[Column]:
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.lit("second"), text).alias("second"),
    ]


def fan_bits(partitions: int) -> int:
    """Bits of a digit, so that places are at least as many as the partitions."""
    return min(MAX_BITS, max(1, -(-max(0, partitions - 1).bit_length() // ROUNDS)))


def _merge(rows: DataFrame, pick, bits: int) -> DataFrame:
    """One row for each digest of ``rows`` with a ``run``: ``keep`` (id, row) and ``group_size``."""
    fan = 1 << bits
    runs = rows.withColumn("place", F.pmod("run", F.lit(fan**ROUNDS)).cast("int"))
    runs = runs.groupBy("run", "place", *_KEY).agg(pick(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")).drop("run")
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")  # 32 bits
    for k in range(ROUNDS):
        shift = bits * (ROUNDS - 1 - k)
        old = F.expr(f"shiftright(place, {shift}) & {fan - 1}")
        new = F.pmod(F.call_function("shiftright", head, F.lit(32 - bits * (k + 1))), F.lit(fan)).cast("int")
        # the exchange of the round: a place is one task's, so its runs stay together and are merged in order
        runs = runs.withColumn("place", F.col("place") + (new - old) * (1 << shift)).repartition("place").sortWithinPartitions("place", *_KEY)
        runs = runs.groupBy("place", *_KEY).agg(pick("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return runs.drop("place")


def exact_duplicates(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, keep_id long, group_size long, kept boolean, text_sha256 string``.

    Texts are equal when their UTF-8 is identical, which is told by SHA-256, length and a second hash; null counts as empty. Of equal texts the row with the largest
    (``keep="max"``) or smallest (``"min"``) id stays. A null id ranks below all others and stays only where its whole
    group has none (``keep_id`` is then null). Of rows that repeat both id and text exactly one is ``kept``. An empty
    table gives an empty result. Other columns are ignored.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_key(_text(text_col)))
    numbered = source.withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id())
    rows = materialise(numbered, "digests")
    bits = fan_bits((rows.agg(F.max("run")).first()[0] or 0) + 1)
    groups = _merge(rows if keep == "max" else rows.where("doc_id is not null"), pick, bits)
    if keep == "min":
        groups = _merge_nulls(rows, groups, bits)
    return rows.join(groups, _KEY).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _merge_nulls(rows: DataFrame, groups: DataFrame, bits: int) -> DataFrame:
    """Adds the rows with null ids, which sort first, behind all others."""
    nulls = _merge(rows.where("doc_id is null"), F.min, bits)
    both = groups.withColumn("last", F.lit(0)).unionByName(nulls.withColumn("last", F.lit(1)))
    return both.groupBy(*_KEY).agg(F.min_by("keep", "last").alias("keep"), F.sum("group_size").alias("group_size"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row, unchanged, of each group of equal texts: the one that :func:`exact_duplicates` keeps.

    Of rows that repeat both id and text one stays, whichever.
    """
    name = fresh(docs, "_row_key")
    ids = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    row_key = F.sha2(F.concat_ws(":", ids, F.sha2(_text(text_col), 256)), 256)
    wanted = exact_duplicates(docs, keep, id_col, text_col).where("kept").select(
        F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256"), 256).alias(name)
    )
    # joined and deduplicated by the same key: the texts move once
    return docs.withColumn(name, row_key).join(wanted, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
