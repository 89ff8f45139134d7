"""Quality of texts: hashed word n-gram logistic regression with FTRL updates, scored as sparse dot products.

A text is cut into words and runs of punctuation. Words in capitals share one token, and a word that repeats the one
before makes one fixed pair, so that shouting and stuttering are learned whatever the words. Single tokens and pairs are
hashed to 2**20 features with their counts, scaled to length 1. The model is 4 MB at most whatever the input; it is fitted
on a bounded sample of labelled rows (``TRAIN_ROWS``), and every text is scored whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches
from .ftrl import Ftrl, dot, labelled_sample, sigmoid, train

#: Labelled rows that a model is fitted on, at most.
TRAIN_ROWS = 8192
SIZE = 1 << 20
SETTINGS = Ftrl(alpha=1.0, l1=0.01, l2=0.01, epochs=4)

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHE_ROWS = 200_000


class _Tokens(dict):
    """Hash of each token, computed once; emptied when it gets large."""

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _CACHE_ROWS:
            self.clear()
        shout = len(token) > 1 and token.isupper()
        self[token] = found = xxh64_intdigest("\x01capitals" if shout else token.lower().encode("utf-8", "surrogatepass"))
        return found


_TOKENS = _Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and values of a text; none for a text without tokens."""
    words = _TOKEN.findall(text or "")
    t = np.fromiter(map(_TOKENS.__getitem__, words), np.uint64, len(words))
    pairs = (t[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (t[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    pairs[t[:-1] == t[1:]] = 0
    i, n = np.unique(np.concatenate([t, pairs]) >> np.uint64(44), return_counts=True)
    x = n.astype(np.float64)
    return i.astype(np.int64), x / max(1.0, np.sqrt(x @ x))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learned from labelled rows that aren't held out; without any, all are zero."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("target"))
    known = known.where(~held_out(F.col("doc_id")))
    rows, y = labelled_sample(docs, known, ["target"], features, TRAIN_ROWS, id_col, text_col)
    return train(rows, y[:, 0], SIZE, SETTINGS) if rows else np.zeros(SIZE + 1)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, held_out boolean, score double, predicted int``.

    Null, empty and blank texts have no features: their score is that of the intercept. A null id isn't held out. Rows that
    repeat an id are scored each. An empty table gives an empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(sigmoid(dot(features(t.as_py()), weights))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
