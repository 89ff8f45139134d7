"""Length buckets that waste the fewest padding tokens, and token-budget batches inside them.

1. Token counts (native) are gathered into one global histogram with a bin for each length that occurs: a partial
   aggregate. Texts of D different lengths have D * D / 2 tokens at least, so a corpus of N tokens has at most sqrt(2 N)
   bins: 5.5 million for the 1.5e13 tokens of 100 TB, and as many pairs of numbers on the driver.
2. Dynamic programming on the driver over the histogram finds the boundaries with the least total padding. The best last
   bucket of a longer prefix never begins earlier than that of a shorter one, so each round divides and conquers: with B
   buckets it costs B * D * log(D).
3. Each bucket is put in a seeded order and cut into batches of ``floor(token_budget / boundary)`` rows, at least one. Ranks
   come from bucket totals and windows over 1/4096 of a bucket each, so a bucket with most of the rows is many tasks' work.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import hashed_bucket, hashed_order, ranks
from ._spark import materialise
from .mixing import count_tokens

@dataclass(frozen=True)
class Packing:
    buckets: int = 16
    token_budget: int = 65536
    seed: int = 42


def _cheapest(before: np.ndarray, rows: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix of the lengths the least ``before[i]`` plus the padding of one bucket from i to its end, and that i.

    The first of equal i counts. First i never decrease, so they are found for every other prefix of a grid that gets finer,
    each between those of its neighbours; all of one level are compared at once.
    """
    n = len(lengths)
    best, at = np.full(n + 1, _NEVER), np.zeros(n + 1, np.int64)
    low, high = np.zeros(n + 2, np.int64), np.full(n + 2, n, np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    known = np.zeros(n + 2, bool)
    while step:
        j = np.arange(step, n + 1, step)
        j = j[~known[j]]
        left, right = np.maximum(j - step, 0), np.minimum(j + step, n + 1)
        a = np.where(known[left], low[left], 0)
        b = np.minimum(np.where(known[right], high[right], n), j - 1)
        size = b - a + 1
        ends = np.cumsum(size)
        i = np.arange(ends[-1]) - np.repeat(ends - size - a, size) if len(j) else np.empty(0, np.int64)
        k = np.repeat(j, size)
        cost = np.where(before[i] >= _NEVER, _NEVER, before[i] + (rows[k] - rows[i]) * lengths[k - 1] - (tokens[k] - tokens[i]))
        if len(j):
            least = np.minimum.reduceat(cost, ends - size)
            hits = np.flatnonzero(cost == np.repeat(least, size))
            first = hits[np.searchsorted(hits, ends - size)]
            best[j], at[j] = least, i[first]
            low[j] = high[j] = i[first]
            known[j] = True
        step >>= 1
    return best, at


#: More than any padding: what no bucketing reaches.
_NEVER = np.int64(1) << 62


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries, each one of the ascending ``lengths``, of at most ``buckets`` buckets with the least total padding.

    Of equal solutions the one with fewer buckets, then with lower boundaries from the last on. All sums are integers of 64
    bits, so rows times the longest length must stay below 2**62.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = lengths.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    tokens = np.concatenate([[0], np.cumsum(counts.astype(np.int64) * lengths)])
    cost = np.full(n + 1, _NEVER)
    cost[0] = 0
    back, totals = [], []
    for _ in range(min(buckets, n)):
        cost, from_ = _cheapest(cost, rows, tokens, lengths)
        back.append(from_)
        totals.append(cost[n])
    found, j = [], n
    for from_ in reversed(back[: int(np.argmin(totals)) + 1]):
        found.append(int(lengths[j - 1]))
        j = from_[j]
    return found[::-1]


def pack(docs: DataFrame, packing: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, tokens long, bucket int, boundary long, batch_id long, slot int, padding long``.

    ``batch_id`` counts from 0 inside a bucket, ``slot`` inside a batch; padding fills a row up to the boundary. Texts are
    never cut: the last boundary is at least the longest length, and a row longer than the token budget is a batch of its own.
    Null and empty texts have length 0. Rows with equal ids, null ids included, follow each other by length in the order of a bucket. An
    empty table gives an empty result. Other columns are ignored.
    """
    base = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), count_tokens(F.col(text_col)).alias("tokens")), "tokens")
    # one row for each length that occurs, at most sqrt(2 * tokens)
    seen = base.groupBy("tokens").agg(F.count("*").alias("n")).toArrow().sort_by("tokens")
    edges = best_boundaries(seen["tokens"].to_numpy(), seen["n"].to_numpy(), packing.buckets)
    limits = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(limits, lambda e: e < F.col("tokens"))).cast("int")
    rows = base.withColumn("bucket", bucket).withColumn("boundary", F.get(limits, F.col("bucket")))
    rows = rows.withColumn("order", hashed_order(F.lit(packing.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("share", hashed_bucket(F.col("order")))
    rows = ranks(rows, ["bucket"], "share", ["order", "tokens"], "rank", bounded=True)
    size = F.greatest(F.lit(1), F.expr(f"{packing.token_budget} div greatest(boundary, 1)"))
    return rows.select(
        "doc_id", "tokens", "bucket", "boundary",
        F.floor(F.col("rank") / size).cast("long").alias("batch_id"),
        (F.col("rank") % size).cast("int").alias("slot"),
        (F.col("boundary") - F.col("tokens")).alias("padding"),
    )
