"""Logistic regression over hashed features, learned one row at a time with FTRL-proximal updates (McMahan et al., 2013)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches


#: Compressed features that a sample sends to the driver, at most.
SAMPLE_BYTES = 64 << 20


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    epochs: int = 4
    seed: int = 42


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Sparse(Sequence):
    """Rows of distinct feature numbers and their values, in one array each; no values are kept where all are 1."""

    def __init__(self, ends: np.ndarray, numbers: np.ndarray, values: np.ndarray | None):
        self.ends, self.numbers, self.values = ends, numbers, values

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, r):
        if not 0 <= r < len(self):
            raise IndexError(r)
        a, b = self.ends[r], self.ends[r + 1]
        return self.numbers[a:b], np.broadcast_to(np.float32(1), b - a) if self.values is None else self.values[a:b]


def _weights(z: np.ndarray, n: np.ndarray, how: Ftrl) -> np.ndarray:
    return np.where(np.abs(z) <= how.l1, 0.0, (np.sign(z) * how.l1 - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, how: Ftrl, extra: np.ndarray | None = None) -> np.ndarray:
    """Weights of ``size`` features and, last, the intercept. A row has distinct feature numbers and their values.

    ``extra`` holds each row's values of the last features, one in each column.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    extra = np.zeros((len(rows), 0), np.float32) if extra is None else extra
    every = np.arange(size - extra.shape[1], size + 1)  # features of each row, the intercept included
    rng = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for r in rng.permutation(len(rows)):
            numbers, values = rows[r]
            i, x = np.concatenate([numbers, every]), np.concatenate([values, extra[r], [1.0]])
            zi, ni = z[i], n[i]
            w = _weights(zi, ni, how)
            g = (sigmoid(w @ x) - labels[r]) * x
            g2 = ni + g * g
            z[i] = zi + g - (np.sqrt(g2) - np.sqrt(ni)) / how.alpha * w
            n[i] = g2
    for a in range(0, size + 1, 1 << 16):  # in place and by parts: these arrays are the largest of the driver
        part = slice(a, a + (1 << 16))
        z[part] = _weights(z[part], n[part], how)
    return z


def dot(row: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    return float(weights[row[0]] @ row[1] + weights[-1])


def out_of_fold(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, folds: np.ndarray, size: int, how: Ftrl, extra: np.ndarray | None = None) -> np.ndarray:
    """Probability of each row by a model that was trained on the other folds."""
    out = np.zeros(len(rows))
    extra = np.zeros((len(rows), 0), np.float32) if extra is None else extra
    for fold in np.unique(folds):
        inside = np.flatnonzero(folds == fold)
        others = np.flatnonzero(folds != fold)
        w = train([rows[r] for r in others], labels[others], size, how, extra[others])
        out[inside] = [sigmoid(dot(rows[r], w) + extra[r] @ w[size - extra.shape[1] : size]) for r in inside]
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], featurise, most: int, id_col: str, text_col: str) -> tuple[Sparse, np.ndarray]:
    """Features and targets of at most ``most`` labelled rows, the first in the order of MD5(id), and their targets.

    Labels with a null id or target are left out; of labels that repeat an id the smallest stays, and of texts that do the
    one whose features sort first. The sample of ids is bounded by ``most``, so it is broadcast; the texts are read by the
    executors, and only sparse features come back, as compressed differences: one row for each id, and in the order of the
    sample no more than ``SAMPLE_BYTES`` of them.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *targets]))
    known = known.groupBy("doc_id").agg(F.min(F.struct(*targets)).alias("y")).select("doc_id", *[F.col(f"y.{t}").cast("int").alias(t) for t in targets])
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *targets)
    names = ", ".join(f"{t} int" for t in targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [featurise(t.as_py()) for t in batch.column(1)]
            i = pa.array([zlib.compress(np.diff(f[0], prepend=0).astype("<u4").tobytes()) for f in found], pa.binary())
            x = pa.array([zlib.compress(f[1].astype("<f4").tobytes()) for f in found], pa.binary())
            n = pa.array([len(f[0]) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), i, x, n, *batch.columns[2:]], ["doc_id", "i", "x", "n", *targets])

    found = rows.mapInArrow(run, f"doc_id long, i binary, x binary, n long, {names}")
    found = found.groupBy("doc_id").agg(F.min(F.struct("i", "x", "n", *targets)).alias("f")).select("doc_id", "f.*")
    # a window over ``most`` rows at most
    first = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = found.withColumn("bytes", F.sum(F.length("i") + F.length("x")).over(first))
    got = sized.where(F.col("bytes") <= SAMPLE_BYTES).drop("bytes").toArrow()
    order = np.argsort(got["doc_id"].to_numpy())  # sorted in place of the rows, which would be copied
    ends = np.concatenate([[0], np.cumsum(got["n"].to_numpy()[order], dtype=np.int64)])
    unpacked = lambda name, kind: (np.frombuffer(zlib.decompress(got[name][int(k)].as_py()), kind) for k in order)
    numbers = np.empty(ends[-1], np.int32)
    for r, differences in enumerate(unpacked("i", "<u4")):
        numbers[ends[r] : ends[r + 1]] = np.cumsum(differences)
    values = None
    if not all((x == 1).all() for x in unpacked("x", "<f4")):
        values = np.empty(ends[-1], np.float32)
        for r, x in enumerate(unpacked("x", "<f4")):
            values[ends[r] : ends[r + 1]] = x
    y = [got[t].to_numpy()[order] for t in targets]
    return Sparse(ends, numbers, values), np.array(y, np.float64).reshape(len(targets), -1).T
