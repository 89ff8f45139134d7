"""Toxicity by a classifier chain: categories in a fixed order, each linear model fed with the earlier probabilities.

Features are the distinct words of a text and their beginnings of 4 to 8 letters (insults are inflected), hashed to 2**20
numbers, present or not. For training, the earlier categories' probabilities come from models that haven't seen the row
(out-of-fold), so that a later model meets probabilities as unsure as they will be in use; the final models see the whole
sample. Models are FTRL logistic regressions whose L1 term leaves a few thousand weights, so scoring looks up each distinct
word once and adds what is left. Fitted on a bounded sample of labelled rows (``TRAIN_ROWS``); every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, fresh
from .ftrl import Ftrl, labelled_sample, out_of_fold, sigmoid, train

#: Labelled rows that a chain is fitted on, at most.
TRAIN_ROWS = 8192
FOLDS = 4
SIZE = 1 << 20
SETTINGS = Ftrl(alpha=0.3, l1=3.0, l2=0.1, epochs=4)
#: A document is rejected if any category is as likely as this.
REJECT = 0.3
_CACHE_ROWS = 200_000

_TOKEN = re.compile(r"\w+")
_PREFIXES = (4, 5, 6, 7, 8)


def word_features(word: str) -> list[int]:
    from xxhash import xxh64_intdigest

    parts = [word, *(f"\x01{word[:k]}" for k in _PREFIXES if len(word) >= k)]
    return [xxh64_intdigest(p.encode("utf-8", "surrogatepass")) >> 44 for p in parts]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = {f for w in set(_TOKEN.findall((text or "").lower())) for f in word_features(w)}
    i = np.array(sorted(found), np.int64)
    return i, np.ones(len(i))


@dataclass(frozen=True)
class Chain:
    """Non-zero hashed weights (n x categories), weights of earlier probabilities, intercepts."""

    categories: tuple[str, ...]
    weights: dict[int, tuple[float, ...]]
    links: np.ndarray
    intercepts: np.ndarray

    def scorer(self):
        """A function from a text to the probability of each category; remembers what each word adds."""
        known: dict[str, tuple[int, ...]] = {}
        count = len(self.categories)

        def run(text: str | None) -> list[float]:
            found: set[int] = set()
            for w in set(_TOKEN.findall((text or "").lower())):
                hit = known.get(w)
                if hit is None:
                    if len(known) >= _CACHE_ROWS:
                        known.clear()
                    hit = known[w] = tuple(f for f in word_features(w) if f in self.weights)
                if hit:
                    found.update(hit)
            sums = self.intercepts + np.sum([self.weights[f] for f in sorted(found)] or np.zeros((1, count)), axis=0)
            out: list[float] = []
            for k in range(count):
                out.append(float(sigmoid(sums[k] + self.links[k, :k] @ np.array(out))) if k else float(sigmoid(sums[0])))
            return out

        return run


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over ``categories``: name to a boolean or 0/1 column of ``labels``, in the order of the chain."""
    names = list(categories)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    rows, y = labelled_sample(docs, known, names, features, TRAIN_ROWS, id_col, text_col)
    count = len(names)
    links, intercepts = np.zeros((count, count)), np.zeros(count)
    table: dict[int, list[float]] = {}
    folds, earlier = np.arange(len(rows)) % FOLDS, np.zeros((len(rows), 0), np.float32)
    for k in range(count if rows else 0):
        size = SIZE + k  # features SIZE to SIZE + k - 1 are the earlier probabilities
        w = train(rows, y[:, k], size, SETTINGS, earlier)
        links[k, :k], intercepts[k] = w[SIZE:size], w[size]
        for i in np.flatnonzero(w[:SIZE]):
            table.setdefault(int(i), [0.0] * count)[k] = float(w[i])
        if k + 1 < count:
            p = out_of_fold(rows, y[:, k], folds, size, SETTINGS, earlier)
            earlier = np.column_stack([earlier, p.astype(np.float32)])
    return Chain(tuple(names), {i: tuple(v) for i, v in table.items()}, links, intercepts)


def score(docs: DataFrame, chain: Chain, reject: float = REJECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, p_<category> double ..., toxic boolean``.

    Null and empty texts have the probabilities of the intercepts. Rows that repeat an id, or have none, are scored each. An
    empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = chain.scorer()
        for batch in batches:
            p = np.array([scorer(t.as_py()) for t in batch.column(1)]).reshape(-1, len(names))
            columns = [pa.array(p[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array((p >= reject).any(axis=1))], ["doc_id", *names, "toxic"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in names), "toxic boolean"]))


def drop_toxic(docs: DataFrame, chain: Chain, reject: float = REJECT, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a category is at least ``reject`` likely; the others unchanged."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, "_toxic")

    @F.pandas_udf("boolean")
    def toxic(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = chain.scorer()
        for part in parts:
            yield pd.Series([max(scorer(t)) >= reject for t in part], dtype=bool)

    return docs.withColumn(name, toxic(F.col(text_col).cast("string"))).where(~F.col(name)).select(*docs.columns)
