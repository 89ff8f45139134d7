"""Stupid-backoff scores (Brants et al., 2007) of every text against the counts of the whole corpus.

A word w after v scores ``c(v w) / c(v)`` if the pair was seen ``min_count`` times, else ``0.4 * c(w) / N``; the first word
of a text scores ``c(w) / N``. A text's score is the sum of the logarithms. Counts are those of the corpus itself, so with the
published ``min_count`` of 1 every pair has a count; with 2, a pair that no other place confirms backs off.

The relations, and where they are cut:

1. One pass over the texts counts words (a row for each distinct word of a run of about a million) and, in the same
   rows, pairs so frequent in a run that they may be frequent everywhere. One aggregate by hash gives the word table.
2. Frequent words and pairs have a proven bound in number (a word seen ``N / 2**20`` times is one of ``2**20`` at most), so
   they are broadcast. Everything else is joined by hash; no hash left there holds more than ``2**-18`` of the rows.
3. A second pass explodes the texts to pairs. Frequent pairs stay in a short list with their document. All others go to the
   bucket of their hash, packed: frequent words as ranks by frequency, the rest as hashes, sorted, in planes of bytes, of
   which the high ones are nearly all zero. In its
   bucket a pair meets all its occurrences: the bucket's count table is built and joined there, and summed per document.
4. What still lacks the count of an infrequent word is joined to the word table, one row for each such word and document.
5. All parts are summed per document.

Words and pairs are hashed to 64 bits. Two of d hashes are expected to collide, and to share a count, d * d / 2**65 times: never
with a million words, and a few times with ten billion distinct pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, materialise
from .simhash import words

BACKOFF = 0.4
MIN_COUNT = 1
#: Words of a run, and pairs in a bucket, about.
RUN_WORDS = 1 << 20
BUCKET_PAIRS = 1 << 20
#: A word is frequent from N / 2**20 on, a pair from N / 2**18 on; a run of n words proposes pairs seen n / 2**18 times.
WORD_BITS = 20
PAIR_BITS = 18
_CACHE_ROWS = 200_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= _CACHE_ROWS:
            self.clear()
        self[word] = found = xxh64_intdigest(word)
        return found


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits from two words' hashes."""
    z = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w << np.uint64(16))) * np.uint64(0xC2B2AE3D27D4EB4F)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(32))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Runs of whole texts: the rows' other columns, the number of words of each, and all words' hashes."""
    cache = _Hashes()
    ids, sizes, parts, n = [], [], [], 0
    for batch in batches:
        others = zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)
        for row, text in zip(others, batch.columns[-1], strict=True):
            w = words(text.as_py())
            ids.append(row)
            sizes.append(len(w))
            parts.append(np.fromiter(map(cache.__getitem__, w), np.uint64, len(w)))
            n += len(w)
            if n >= RUN_WORDS:
                yield ids, np.array(sizes, np.int64), np.concatenate(parts)
                ids, sizes, parts, n = [], [], [], 0
    if ids:
        yield ids, np.array(sizes, np.int64), np.concatenate(parts)


def _pairs(sizes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions whose word follows another of the same text."""
    follows = np.ones(len(h), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0]
    follows[starts] = False
    return np.flatnonzero(follows)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Numbers below 256**size as planes of bytes, the highest first: runs of zeros for what compresses them."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].T).tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - size :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


class _Words:
    """Words as three-byte codes: the rank by frequency of a frequent word, or ``OTHER`` with the hash in a list beside."""

    OTHER = (1 << 24) - 1

    def __init__(self, word: np.ndarray, n: np.ndarray) -> None:
        self.word, order = word, np.argsort(-n, kind="stable")
        self.by_rank, self.rank = word[order], np.empty(len(word), np.int64)
        self.rank[order] = np.arange(len(word))

    def codes(self, h: np.ndarray) -> np.ndarray:
        hit, where = _find(self.word, h)
        return np.where(hit, self.rank[where], self.OTHER) if len(self.word) else np.full(len(h), self.OTHER)

    def hashes(self, codes: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        known = codes != self.OTHER
        out[known], out[~known] = self.by_rank[codes[known]], others
        return out


def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is in the ascending table, and where."""
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


def _unsigned(hashes: list[int]) -> np.ndarray:
    """Hashes as they are before Spark, which has signed numbers only."""
    return np.array(hashes, np.int64).view(np.uint64)


def count_words(texts: DataFrame) -> DataFrame:
    """``v, w long, n long``: words (w null) with their counts in the corpus; pairs with what runs proposed of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, h in _runs(batches):
            word, n = np.unique(h, return_counts=True)
            at = _pairs(sizes, h)
            key, first, m = np.unique(pair_key(h[at - 1], h[at]), return_index=True, return_counts=True)
            often = m * 2**PAIR_BITS >= len(h)
            first, m = at[first[often]], m[often]
            v, w = np.concatenate([word, h[first - 1]]).view(np.int64), h[first].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.concat_arrays([pa.nulls(len(word), pa.int64()), pa.array(w)]), pa.array(np.concatenate([n, m]))], ["v", "w", "n"])

    return texts.mapInArrow(run, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, n_words long, log_score double, mean_log_score double``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Null, empty and blank texts have no words: score 0, mean null. Rows
    that repeat an id, or have none, are counted and scored each. An empty table gives an empty result. Other columns are
    ignored.
    """
    if min_count < 1:
        raise ValueError("min_count must be 1 or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = materialise(count_words(source), "words")
    total = table.where("w is null").agg(F.sum("n")).first()[0] or 0
    known = table.where("w is null").select(F.col("v").alias("word"), "n")
    frequent = known.where(F.col("n") * 2**WORD_BITS >= total).collect()
    word, word_n = _unsigned([r["word"] for r in frequent]), np.array([r["n"] for r in frequent], np.float64)
    order = np.argsort(word)
    word, word_n = word[order], word_n[order]
    word_log, ranked = np.log(word_n), _Words(word, word_n)
    # what runs propose is half of a frequent pair's count or more, and at most 2**19 pairs can have that much
    proposed = table.where(F.col("w").isNotNull() & (F.col("n") * 2 ** (PAIR_BITS + 1) >= total) & (F.col("n") >= min_count)).collect()
    pv, pw = (_unsigned([r[c] for r in proposed]) for c in ("v", "w"))
    key = pair_key(pv, pw)
    order = np.argsort(key)
    key, pv = key[order], pv[order]
    buckets = int(max(1, -(-total // BUCKET_PAIRS)))
    log_total = float(np.log(max(1, total)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for named, sizes, h in _runs(batches):
            rows = np.array([r for r, _ in named], np.int64)
            owner = np.repeat(np.arange(len(rows)), sizes)
            at = _pairs(sizes, h)
            v, w, doc = h[at - 1], h[at], owner[at]
            k = pair_key(v, w)
            hit, where = _find(key, k)
            # documents with their frequent pairs, and the first word of each
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            ends = np.cumsum(np.bincount(doc[hit], minlength=len(rows)))
            lists, begins = where[hit], np.concatenate([[0], ends[:-1]])
            signed = h.view(np.int64)
            first = [int(signed[s]) if n else None for s, n in zip(starts, sizes, strict=True)]
            columns = {
                "bucket": pa.array((rows % buckets).astype(np.int32)), "row": pa.array(rows), "doc_id": pa.array([d for _, d in named], pa.int64()), "n": pa.array(sizes), "first": pa.array(first, pa.int64()),
                "often": pa.array([_planes(np.diff(np.sort(lists[b:e]), prepend=0), 4) for b, e in zip(begins, ends, strict=True)], pa.binary()),
            }
            yield _batch(columns, len(rows))
            found, n = np.unique(lists, return_counts=True)
            yield _batch({"bucket": pa.array((rows[:1] % buckets).astype(np.int32)), "often": pa.array([found.astype("<u4").tobytes()]), "v": pa.array([n.astype("<i8").tobytes()])}, 1)
            # all other pairs, by bucket and first word
            codes, at = ranked.codes(h), at[~hit]
            v, w, doc, b = codes[at - 1], codes[at], doc[~hit], (k[~hit] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b << 24 | v)
            v, w, doc, b, at = v[order], w[order], doc[order], b[order], at[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
            out = []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                local, index = np.unique(doc[s:e], return_inverse=True)
                others = [_planes(h[place[s:e][code[s:e] == ranked.OTHER]], 8) for code, place in ((v, at - 1), (w, at))]
                out.append((int(b[s]), _planes(np.diff(v[s:e], prepend=0), 3), _planes(w[s:e], 3), *others, _planes(index, 4), _planes(rows[local], 8)))
            if out:
                b, *packed = zip(*out, strict=True)
                yield _batch({"bucket": pa.array(b, pa.int32()), **{c: pa.array(x, pa.binary()) for c, x in zip(("v", "w", "v_others", "w_others", "doc", "ids"), packed, strict=True)}}, len(b))

    def count_and_join(group: pa.Table) -> pa.Table:
        rows = group.filter(pc.is_valid(group["row"]))
        tallies = group.filter(pc.and_(pc.is_null(group["row"]), pc.is_null(group["doc"])))
        runs = group.filter(pc.is_valid(group["doc"]))
        out = [pa.table({"row": rows["row"], "doc_id": rows["doc_id"], "n": rows["n"], "word": rows["first"], "times": pa.array(np.ones(len(rows), np.int64)), "often": rows["often"]})]
        if len(tallies):
            i = np.concatenate([np.frombuffer(x, "<u4") for x in tallies["often"].to_pylist()])
            n = np.concatenate([np.frombuffer(x, "<i8") for x in tallies["v"].to_pylist()])
            i, back = np.unique(i, return_inverse=True)
            out.append(pa.table({"word": pa.array(i.astype(np.int64)), "times": pa.array(np.bincount(back, n, len(i)).astype(np.int64))}))
        if len(runs):
            read = lambda c, size: [_from_planes(x, size) for x in runs[c].to_pylist()]
            v = np.concatenate([ranked.hashes(np.cumsum(x).astype(np.int64), o) for x, o in zip(read("v", 3), read("v_others", 8), strict=True)])
            w = np.concatenate([ranked.hashes(x.astype(np.int64), o) for x, o in zip(read("w", 3), read("w_others", 8), strict=True)])
            ids = [_from_planes(x, 8).astype(np.int64) for x in runs["ids"].to_pylist()]
            doc = np.concatenate([i[_from_planes(x, 4).astype(np.int64)] for i, x in zip(ids, runs["doc"].to_pylist(), strict=True)])
            _, back, n = np.unique(pair_key(v, w), return_inverse=True, return_counts=True)
            n = n[back]
            seen = n >= min_count
            part = np.where(seen, np.log(n), np.log(BACKOFF) - log_total)
            lacks, sign = np.where(seen, v, w), np.where(seen, -1, 1)
            hit, where = _find(word, lacks)
            if len(word):
                part = part + np.where(hit, sign * word_log[where], 0.0)
            doc_ids, doc = np.unique(doc, return_inverse=True)
            out.append(pa.table({"row": pa.array(doc_ids), "part": pa.array(np.bincount(doc, part, len(doc_ids)))}))
            doc, lacks, sign = doc[~hit], lacks[~hit], sign[~hit]
            out.append(pa.table({"row": pa.array(doc_ids[doc]), "word": pa.array(lacks.view(np.int64)), "times": pa.array(sign.astype(np.int64))}))
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("part", pa.float64()), ("word", pa.int64()), ("times", pa.int64()), ("often", pa.binary())])
        full = [pa.table({f.name: t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in schema}, schema=schema) for t in out]
        return pa.concat_tables(full)

    numbered = source.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text")
    exploded = numbered.mapInArrow(explode, ", ".join(f"{n} {t}" for n, t in _EXPLODED))
    parts = materialise(exploded.groupBy("bucket").applyInArrow(count_and_join, "row long, doc_id long, n long, part double, word long, times long, often binary"), "parts")

    tallies = parts.where("row is null").groupBy("word").agg(F.sum("times").alias("n")).collect()
    pair_log = np.zeros(len(key))
    pair_log[[r["word"] for r in tallies]] = np.log([r["n"] for r in tallies]) if tallies else 0.0
    hit, where = _find(word, pv)  # the first word of a frequent pair is frequent
    pair_log -= word_log[where] if len(word) else 0.0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.array([pair_log[np.cumsum(_from_planes(x, 4).astype(np.int64))].sum() if x else 0.0 for x in batch.column(2).to_pylist()])
            known_first = batch.column(1).to_pylist()
            part -= np.array([0.0 if f is None else log_total for f in known_first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part)], ["row", "part"])

    often = parts.where("n is not null").select("row", "word", "often").mapInArrow(finish, "row long, part double")
    lacking = parts.where("row is not null and word is not null").select("word", "row", "times")
    joined = lacking.join(known, "word").select("row", (F.log("n") * F.col("times")).alias("part"))
    sums = parts.where("row is not null and n is null and word is null").select("row", "part").unionByName(often).unionByName(joined)
    sums = sums.groupBy("row").agg(F.sum("part").alias("part"))
    found = parts.where("n is not null").select("row", "doc_id", "n").join(sums, "row", "left")
    return found.select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("part", F.lit(0.0)).alias("log_score"),
        F.when(F.col("n") > 0, F.col("part") / F.col("n")).alias("mean_log_score"),
    )


_EXPLODED = [("bucket", "int"), ("row", "long"), ("doc_id", "long"), ("n", "long"), ("first", "long"), ("often", "binary"), ("v", "binary"), ("w", "binary"), ("v_others", "binary"), ("w_others", "binary"), ("doc", "binary"), ("ids", "binary")]


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, kinds[t]) for c, t in _EXPLODED], [c for c, _ in _EXPLODED])
