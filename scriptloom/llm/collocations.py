"""Collocations: phrases whose words occur together far more often than apart, by exact counts.

1. A first pass over the texts hashes every phrase into ``2**SLOT_BITS`` slots and counts these: a sketch with one row, whose
   counts are upper bounds of the phrases'. Its slots are dealt to buckets and summed there, so that no task holds it whole;
   what comes back is a bit a slot, whether ``min_count`` was reached (32 MB at any input size, broadcast). The same pass counts words.
   Words are told apart by 64-bit hashes inside a task only; beyond that, by their bytes.
2. A second pass counts the phrases whose bit is set, all that can reach ``min_count`` among them, task by task: each goes once, with
   its count, from a table of about ``AUTOMATON_BYTES`` to a bucket of about ``BUCKET_PHRASES``. Phrases are told apart like words.
3. Each bucket adds its counts up by the phrases' bytes; those below the threshold, which only shared a slot, go. The texts are read twice
   at any size, and what moves grows with them.
4. Cuts, scores, the rule on longer phrases and the ranks are joins and aggregates of candidates with the counts of their parts.

A phrase of ``min_count`` occurrences has parts of as many, so the counts of parts are words' or other candidates' counts. With far
more than ``2**SLOT_BITS`` distinct phrases the sketch moves more phrases than it should: larger buckets, the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, materialise
from .lm_score import _find, _from_planes, _planes, pair_key

MIN_COUNT = 10
MAX_WORDS = 3
#: A longer phrase with half the occurrences of one inside it replaces that.
ABSORB_PERCENT = 50
TOP = 2000
SLOT_BITS = 28
_BUCKETS = 64
#: Bytes of a run; words that a task counts together; phrases of a bucket; bytes of the phrases that a task counts together, at 16 each (automata
#: of so many bytes counted them before).
RUN_BYTES = 1 << 20
RUN_WORDS = 1 << 19
BUCKET_PHRASES = 1 << 14
AUTOMATON_BYTES = 4 << 20
NO_LANG = "und"

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(10 if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\n"


def folded(text: bytes | None) -> bytes:
    """A text with A-Z lower-cased, line breaks for what ends a piece, and spaces for what ends a word."""
    return (text or b"").translate(_FOLD)


def _tables(places: int = 64) -> np.ndarray:
    """A number for each byte at each place of a word: sums of them are the words' hashes."""
    z = np.arange(1, places * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_TABLES = _tables()


class _Run:
    """Whole texts, one language after another: where their words are, and hashes of these."""

    def __init__(self, texts: dict[str, list[bytes]]) -> None:
        self.langs = list(texts)
        of_lang = [_BREAK.join(texts[lang]) + _BREAK for lang in self.langs]
        self.bytes = b"".join(of_lang)
        data = np.frombuffer(self.bytes, np.uint8)
        line = data == 10
        letter = (data != 32) & ~line
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(line, dtype=np.int32)
        #: Whether a piece ends after each word.
        self.ends = np.ones(len(self.start), bool)
        self.ends[:-1] = breaks[self.start[1:]] != breaks[self.end[:-1] - 1]
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(size.sum(), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        value = _TABLES[(place & 63) << 8 | data[letter]]
        far = np.flatnonzero(place > 63)
        value[far] *= (place[far] >> 6).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4E) + np.uint64(1)
        h = np.add.reduceat(value, first) if len(first) else value
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        self.hash = h ^ (h >> np.uint64(32))
        self.lang = np.searchsorted(np.cumsum([len(x) for x in of_lang]), self.start, side="right")
        seed = np.array([int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "big") for lang in self.langs], np.uint64)
        self.key = pair_key(seed[self.lang], self.hash)

    def phrases(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 2: at which words phrases of that length begin, and their keys."""
        key, ok = self.key, np.ones(len(self.key), bool)
        for n in range(2, most + 1):
            ok = ok[:-1] & ~self.ends[n - 2 : len(self.ends) - 1]
            key = pair_key(key[:-1], self.hash[n - 1 :])
            at = np.flatnonzero(ok)
            yield n, at, key[at]

    def words(self, at: np.ndarray, n: int = 1) -> list[bytes]:
        """The n words from each given one on, with single spaces between."""
        found = [self.bytes[b:e] for b, e in zip(self.start[at].tolist(), self.end[at + n - 1].tolist(), strict=True)]
        if n > 1:
            wide = np.flatnonzero(self.end[at + n - 1] - self.start[at] > sum((self.end - self.start)[at + k] for k in range(n)) + n - 1)
            for i in wide.tolist():
                found[i] = b" ".join(x for x in found[i].split(b" ") if x)
        return found


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """Runs from batches of ``lang, text``."""
    texts: dict[str, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = folded(text.as_py())
            texts.setdefault(lang, []).append(found)
            n += len(found) + 1
            if n >= RUN_BYTES:
                yield _Run(texts)
                texts, n = {}, 0
    if texts:
        yield _Run(texts)


class _Words:
    """The words, or phrases, of a task's runs with their counts."""

    def __init__(self) -> None:
        self.key, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lang, self.word = np.zeros(0, object), np.zeros(0, object)

    def add(self, r: _Run, keys: np.ndarray | None = None, at: np.ndarray | None = None, length: int = 1) -> None:
        """The words of a run; or phrases of ``length`` words with ``keys`` that begin at the words ``at``."""
        key, first, n = np.unique(r.key if keys is None else keys, return_index=True, return_counts=True)
        known, there = _find(self.key, key)
        self.n[there[known]] += n[known]
        new, key, n = first[~known], key[~known], n[~known]
        new = new if at is None else at[new]
        place = np.searchsorted(self.key, key)
        word = np.empty(len(new), object)
        word[:] = r.words(new, length)
        lang = np.array(r.langs, object)[r.lang[new]]
        self.key, self.n, self.lang, self.word = (np.insert(x, place, y) for x, y in ((self.key, key), (self.n, n), (self.lang, lang), (self.word, word)))

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = {"lang": pa.array(self.lang, pa.string()), "word": pa.array(self.word, pa.binary()), "n": pa.array(self.n)}
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(self.key), f.type)) for f in schema], schema=schema)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return key >> np.uint64(64 - bits)


def _remixed(key: np.ndarray) -> np.ndarray:
    """Keys whose low bits depend on all bits, so that they deal phrases to buckets evenly."""
    z = key ^ (key >> np.uint64(31))
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(30))


def _first_pass(docs: DataFrame, most: int, bits: int) -> DataFrame:
    """``lang, word, n`` rows of words, and ``bucket, slots, counts`` rows of the sketch."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64()), ("bucket", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])
    inside = bits - (_BUCKETS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for r in _runs(batches):
            words.add(r)
            if len(words.key) > RUN_WORDS:
                yield words.batch(schema)
                words = _Words()
            keys = [k for _, _, k in r.phrases(most)]
            slots, n = np.unique(_slot(np.concatenate(keys), bits), return_counts=True)
            cut = np.searchsorted(slots, np.arange(_BUCKETS + 1, dtype=np.uint64) << np.uint64(inside))
            full = [b for b in range(_BUCKETS) if cut[b] < cut[b + 1]]
            none = pa.nulls(len(full))
            yield pa.RecordBatch.from_arrays([
                none.cast(pa.string()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(full, pa.int32()),
                pa.array([_planes(np.diff(slots[cut[b] : cut[b + 1]], prepend=np.uint64(b) << np.uint64(inside)), 4) for b in full], pa.binary()),
                pa.array([_planes(n[cut[b] : cut[b + 1]], 4) for b in full], pa.binary()),
            ], schema=schema)
        if len(words.key):
            yield words.batch(schema)

    return docs.mapInArrow(run, "lang string, word binary, n long, bucket int, slots binary, counts binary")


def _frequent_slots(sketch: DataFrame, min_count: int, bits: int) -> np.ndarray:
    """A bit for each slot. The driver gets ``2**(bits - 3)`` bytes in all."""
    inside = bits - (_BUCKETS.bit_length() - 1)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, bucket = np.zeros(1 << inside, np.uint32), None
        for batch in batches:
            for b, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bucket = b
                at = np.cumsum(_from_planes(slots, 4)).astype(np.int64)
                # a slot beyond the threshold stays there: no sum can wrap
                sums[at] = np.minimum(sums[at].astype(np.uint64) + _from_planes(counts, 4), np.uint64(min_count)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(sums >= min_count).tobytes()], pa.binary())], ["bucket", "bits"])

    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    size = len(bitmap) // _BUCKETS
    for r in sketch.groupBy("bucket").applyInArrow(total, "bucket int, bits binary").collect():
        bitmap[r["bucket"] * size : (r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def _counted(docs: DataFrame, bitmap: np.ndarray, most: int, bits: int, min_count: int) -> DataFrame:
    """``lang, phrase binary, n long``: the exact counts of all phrases that occur ``min_count`` times, which are among those whose slot did."""
    buckets = np.uint64(max(1, int(np.bitwise_count(bitmap).sum()) // BUCKET_PHRASES))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])

    def dealt(found: _Words) -> pa.RecordBatch:
        """A row for each language and bucket: its phrases, separated by breaks, and their counts."""
        names = found.lang.tolist()
        langs = sorted(set(names))
        of = np.fromiter(map({lang: k for k, lang in enumerate(langs)}.__getitem__, names), np.int64, len(names))
        place = of * int(buckets) + (_remixed(found.key) % buckets).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, word, n = place[order], found.word[order], found.n[order]
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        spans = list(zip(cut, [*cut[1:], len(place)], strict=True))
        lang, bucket = np.divmod(place[cut], int(buckets))
        columns = [pa.array([langs[i] for i in lang], pa.string()), pa.array(bucket.astype(np.int32)), pa.array([_BREAK.join(word[b:e]) for b, e in spans], pa.binary())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([_planes(n[b:e], 8) for b, e in spans], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Words()
        for r in _runs(batches):
            for length, at, key in r.phrases(most):
                slot = _slot(key, bits)
                hit = (shared.value[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
                found.add(r, key[hit], at[hit], length)
            if 16 * len(found.key) > AUTOMATON_BYTES:
                yield dealt(found)
                found = _Words()
        if len(found.key):
            yield dealt(found)

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, int] = {}
        for batch in batches:
            for phrases, counts in zip(batch.column("phrases"), batch.column("counts"), strict=True):
                for phrase, n in zip(phrases.as_py().split(_BREAK), _from_planes(counts.as_py(), 8).view(np.int64).tolist(), strict=True):
                    sums[phrase] = sums.get(phrase, 0) + n
        often = [(phrase, n) for phrase, n in sums.items() if n >= min_count]
        columns = [[key[0].as_py()] * len(often), [x for x, _ in often], [n for _, n in often]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["lang", "phrase", "n"])

    kept = docs.mapInArrow(run, "lang string, bucket int, phrases binary, counts binary")
    return kept.groupBy("lang", "bucket").applyInArrow(total, "lang string, phrase binary, n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text", slot_bits: int = SLOT_BITS) -> tuple[DataFrame, DataFrame]:
    """Words ``lang, phrase binary, n long`` and phrases of 2 to ``max_words`` words with ``n >= min_count``, both written tables."""
    if slot_bits < _BUCKETS.bit_length() + 2:
        raise ValueError("every bucket needs a byte of slots")
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    first = materialise(_first_pass(source, max_words, slot_bits), "sketch")
    words = materialise(first.where("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")), "words")
    bitmap = _frequent_slots(first.where("bucket is not null").select("bucket", "slots", "counts"), min_count, slot_bits)
    discard(first)
    counts = materialise(_counted(source, bitmap, max_words, slot_bits, min_count), "phrases")
    return words, counts


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, absorb_percent: int = ABSORB_PERCENT, lang_col: str = "lang", text_col: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``, numbers long.

    Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words. ``n`` counts a
    language's words, ``a`` the occurrences of a phrase inside pieces, overlapping ones too. Candidates have 2 to ``max_words`` words
    and ``a >= min_count``. A candidate is cut into two parts that occur ``l`` and ``r`` times, with the score
    ``floor(1000000 a a / (l r))`` (exact, in decimals of 38 digits: counts below 5e15); its lowest cut counts, of equal ones that with the shorter
    first part. Candidates inside a longer candidate with ``absorb_percent`` of their occurrences or more are dropped. The order is
    score and ``a`` descending, then the phrase bytewise.

    A null language is ``und``. Null, empty and blank texts have no words; a word may be of any length and any other characters. Ids are
    ignored and repeated rows count each. An empty table gives an empty result. Other columns are ignored.
    """
    if min_count < 1 or max_words < 2:
        raise ValueError("min_count must be 1 or more, max_words 2 or more")
    words, counts = phrase_counts(docs, min_count, max_words, lang_col, text_col, slot_bits)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    # parts of a phrase occur as often as the phrase at least
    parts = words.where(F.col("n") >= min_count).unionByName(counts)
    split = counts.withColumn("words", F.split(F.col("phrase").cast("string"), " "))
    cuts = split.select(
        "lang", "phrase", F.col("n").alias("a"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").cast("binary").alias("first"), F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").cast("binary").alias("rest"),
        ))).alias("cut"),
    ).select("lang", "phrase", "a", "cut.*")
    of = lambda part, n: parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    exact = lambda *names: [F.col(c).cast("decimal(16,0)") for c in names]
    a, l, r = exact("a", "l", "r")
    cuts = cuts.withColumn("above", a * a * F.lit(1000000).cast("decimal(7,0)")).withColumn("below", l * r).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = split.where(F.size("words") > 2).select("lang", F.col("n").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda k: F.array_join(F.slice("words", k, n), " ")),
    ))).alias("phrase"))
    inside = inside.groupBy("lang", F.col("phrase").cast("binary").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb_percent))
    kept = kept.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
