"""Repeated passages of 50 bytes and more, removed after their first document, by a distributed merge sort of suffixes.

A text of 50 bytes and more is read through windows of 50 bytes. A window's anchor is one of its 19 strings of 32 bytes: where the
smallest hash of its strings of 13 bytes stands, the leftmost of equal ones, modulo 19 (a mod-minimizer: about one place in 15 is an
anchor). It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Hashes decide only what is
an anchor and what is sent; equality is always that of bytes.

1. A first pass counts anchors in a sketch of ``2**SLOT_BITS`` slots, as phrases are counted for collocations. An anchor alone in its
   slot starts no repeated window and isn't sent (distributed duplicate detection, as in prefix-doubling string sorting).
2. A second pass cuts, at each other anchor, the suffix that its windows reach (32 to 50 bytes) and the bytes before it (up to 18), and
   sorts runs of suffixes. Of equal entries of a run only the smallest document's is sent; the others' windows are known to be
   repeated. What is sent is front-coded: the length of the prefix shared with the entry before, and the rest.
3. Runs are cut at splitters from a bounded sample and exchanged. Each range is merged by a loser tree that knows for every
   entry the prefix it shares with the last winner: the longer one wins without a look at the bytes, and of equal ones bytes are
   compared from there on. It yields the order and the common prefixes of neighbours.
4. Two windows at offset o are equal where suffixes share 50 - o bytes and the bytes before them o: both are ranges in sorted orders. The
   smallest document of each class keeps its window.
5. Removed ranges go to their documents, of which only those that lose bytes move.

A group of copies of any size sends one entry a run for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, discard, fresh, materialise, maybe_in
from .collocations import _BUCKETS, _frequent_slots, _slot
from .lm_score import _from_planes, _planes

#: Bytes of a window, and of the strings of which it has an anchor.
WINDOW = 50
ANCHOR = 32
LEFT = WINDOW - ANCHOR
SMALL = 4 + (ANCHOR - 4) % (LEFT + 1)
SLOT_BITS = 29
#: Bytes hashed together, anchors counted together, entries of a sorted run, entries of a range, sampled anchors.
SLICE = 1 << 18
RUN_ANCHORS = 1 << 20
RUN_ENTRIES = 1 << 18
RANGE_ENTRIES = 1 << 17
SAMPLE = 1 << 17
#: Where a null id stands.
_LAST = (1 << 63) - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SMALL_MIX = np.uint32(0x9E3779B1)
#: A place in a slice and, above it, the high bits of a hash are one number of 32 bits.
_PLACE = np.uint32(SLICE - 1)


def _byte_codes() -> np.ndarray:
    z = np.arange(1, 257, dtype=np.uint64) * _MIX
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z >> np.uint64(32)).astype(np.uint32)


_CODES = _byte_codes()


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts side by side in ``data`` (a slice at most): place, evenly spread hash, and the first and last window of each."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none.astype(np.uint64), none, none
    h, span = _CODES[data], 1
    while span < 8:
        h = h[:-span] * _SMALL_MIX + h[span:]
        h ^= h >> np.uint32(15)
        span *= 2
    h = (h[: 8 - SMALL] * _SMALL_MIX + h[SMALL - 8 :]) * _SMALL_MIX  # of strings of SMALL bytes
    h ^= h >> np.uint32(15)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint32)
    wide, span = WINDOW - SMALL + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: span - wide], least[wide - span :])
    window = np.arange(len(least), dtype=np.int32)
    ahead = (least & _PLACE).astype(np.int32) - window
    for _ in range((WINDOW - SMALL) // (LEFT + 1)):  # modulo LEFT + 1
        ahead -= (ahead > LEFT) * np.int32(LEFT + 1)
    place = window + ahead
    for e in ends[:-1].tolist():
        place[max(0, e - WINDOW + 1) : e] = -1  # windows of two texts
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(place) - 1]])
    whole = place[new] >= 0
    new, last = new[whole], last[whole]
    place = place[new].astype(np.int64)
    words = data[place[:, None] + np.arange(ANCHOR)].view("<u8")
    key = words[:, 0] * _MIX
    for k in range(1, ANCHOR // 8):
        key = (key ^ (key >> np.uint64(31))) * _MIX + words[:, k] * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return place, key ^ (key >> np.uint64(31)), new, last


class _Slice:
    """Texts, or parts of long ones, side by side: where they end, whose they are and where in their text they begin."""

    def __init__(self, parts: list[tuple]) -> None:
        self.data = np.frombuffer(b"".join(p[-1] for p in parts), np.uint8)
        self.ends = np.cumsum([len(p[-1]) for p in parts])
        self.doc, self.hash, self.begin = (np.array([p[i] for p in parts], np.int64) for i in range(3))
        self.place, self.key, self.first, self.last = anchors(self.data, self.ends)

    def owner(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, text hash and place in the text of some anchors."""
        at = self.place[which]
        part = np.searchsorted(self.ends, at, side="right")
        starts = self.ends - np.diff(self.ends, prepend=0)
        return self.doc[part], self.hash[part], self.begin[part] + at - starts[part]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Slice]:
    """Slices of batches of ``doc, hash, text``; parts of one text overlap by a window less a byte."""
    parts, n = [], 0
    for batch in batches:
        for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            for begin in range(0, max(1, len(text) - WINDOW + 1), SLICE - WINDOW + 1):
                part = text[begin : begin + SLICE]
                if n + len(part) > SLICE:
                    yield _Slice(parts)
                    parts, n = [], 0
                parts.append((doc, key, begin, part))
                n += len(part)
    if parts:
        yield _Slice(parts)


def _count_anchors(texts: DataFrame, bits: int, every: int) -> DataFrame:
    """``bucket, slots, counts`` of the sketch, and ``slots, sample`` of one slot in ``every``: a slot and its anchor's bytes."""
    inside = bits - (_BUCKETS.bit_length() - 1)
    schema = pa.schema([("bucket", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary()), ("sample", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, n = [], 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(slots), return_counts=True)
            cut = np.searchsorted(found, np.arange(_BUCKETS + 1, dtype=np.uint64) << np.uint64(inside))
            full = [b for b in range(_BUCKETS) if cut[b] < cut[b + 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()),
                pa.array([_planes(np.diff(found[cut[b] : cut[b + 1]], prepend=np.uint64(b) << np.uint64(inside)), 4) for b in full], pa.binary()),
                pa.array([_planes(np.minimum(times[cut[b] : cut[b + 1]], 2), 4) for b in full], pa.binary()),
                pa.nulls(len(full), pa.binary()),
            ], schema=schema)

        for s in _slices(batches):
            slot = _slot(s.key, bits)
            slots.append(slot)
            n += len(slot)
            at = np.flatnonzero((slot * _MIX >> np.uint64(32)) % np.uint64(every) == 0)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(at), pa.int32()), pa.array([int(x).to_bytes(8, "big") for x in slot[at]], pa.binary()), pa.nulls(len(at), pa.binary()),
                pa.array([s.data[p : p + ANCHOR].tobytes() for p in s.place[at]], pa.binary()),
            ], schema=schema)
            if n >= RUN_ANCHORS:
                yield counted()
                slots, n = [], 0
        if slots:
            yield counted()

    return texts.mapInArrow(run, "bucket int, slots binary, counts binary, sample binary")


def _columns(x: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian numbers of 8 bytes, the first column first."""
    padded = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    padded[:, : x.shape[1]] = x
    return list(padded.view(">u8").astype(np.uint64).T)


def _shared(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row shares with the row before; 0 for the first."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])
        out[1:] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return out


def _union(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each key (small numbers) joined where they overlap or touch."""
    if not len(key):
        return key, begin, end
    wide = np.int64(end.max() + 2)
    low, high = begin + key * wide, end + key * wide
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    key = key[order][new]
    return key, low[new] - key * wide, high[np.concatenate([new[1:] - 1, [len(low) - 1]])] - key * wide


_SENT = [
    ("part", pa.int32()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rest", pa.binary()), ("left_sizes", pa.binary()), ("left", pa.binary()),
    ("doc", pa.binary()), ("hash", pa.binary()), ("place", pa.binary()),
]
_SENT_SCHEMA = pa.schema(_SENT)
_SENT_SQL = ", ".join(f"{n} {'int' if t == pa.int32() else 'binary'}" for n, t in _SENT)


def _packed(data: bytes) -> bytes:
    """Compressed, with the size in front."""
    return len(data).to_bytes(4, "big") + pa.compress(data, "zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "big"), "zstd", asbytes=True)


def _known(doc: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Ranges that are removed, as rows whose ``shared`` is null, in parts below zero."""
    pairs, index = np.unique(np.stack([doc, key], axis=1), axis=0, return_inverse=True)
    i, begin, end = _union(index.ravel(), begin, end)
    out = {"part": pa.array((-1 - (pairs[i[:1], 1] & 63)).astype(np.int32)), "doc": pa.array([pairs[i, 0].tobytes()], pa.binary()), "hash": pa.array([pairs[i, 1].tobytes()], pa.binary())}
    out |= {"place": pa.array([begin.tobytes()], pa.binary()), "rest": pa.array([end.tobytes()], pa.binary())}
    return pa.RecordBatch.from_arrays([out[n] if n in out else pa.nulls(1, t) for n, t in _SENT], schema=_SENT_SCHEMA)


def _sorted_run(right: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a run of entries sends: its smallest documents' entries by range, front-coded, and ranges known to be removed."""
    order = np.lexsort((place, key, doc, left_size, *reversed(_columns(left)), size, *reversed(_columns(right))))
    right, size, left, left_size, doc, key, place = (x[order] for x in (right, size, left, left_size, doc, key, place))
    same = np.zeros(len(right), bool)
    same[1:] = (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1) & (size[1:] == size[:-1]) & (left_size[1:] == left_size[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(right))))
    later = doc > doc[first]
    if later.any():
        yield _known(doc[later], key[later], (place - left_size)[later], (place + size)[later])
    right, size, left, left_size, doc, key, place = (x[~later] for x in (right, size, left, left_size, doc, key, place))
    part = np.searchsorted(splitters, np.ascontiguousarray(right[:, :ANCHOR]).view(f"S{ANCHOR}").ravel(), side="right")
    shared = _shared(right, size)
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    shared[begins] = 0
    column = np.arange(WINDOW)
    for b, e in zip(begins, [*begins[1:], len(part)], strict=True):
        r, l = right[b:e], left[b:e]
        rest = r[(column >= shared[b:e, None]) & (column < size[b:e, None])]
        before = l[np.arange(LEFT) < left_size[b:e, None]]
        yield pa.RecordBatch.from_arrays([
            pa.array([part[b]], pa.int32()),
            *[pa.array([_packed(x.tobytes())], pa.binary()) for x in (shared[b:e].astype(np.uint8), size[b:e].astype(np.uint8), rest, left_size[b:e].astype(np.uint8), before)],
            *[pa.array([_packed(_planes(x[b:e].view(np.uint64), 8))], pa.binary()) for x in (doc, key, place)],
        ], schema=_SENT_SCHEMA)


def _send(texts: DataFrame, bitmap: np.ndarray, splitters: np.ndarray, bits: int) -> DataFrame:
    """Sorted runs of the suffixes at anchors that share their slot, cut into ranges."""
    shared = texts.sparkSession.sparkContext.broadcast((bitmap, splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, splitters = shared.value
        held, n = [], 0
        for s in _slices(batches):
            slot = _slot(s.key, bits)
            hit = np.flatnonzero((bitmap[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1)
            if not len(hit):
                continue
            at, first, last = s.place[hit], s.first[hit], s.last[hit]
            size, left_size = last + WINDOW - at, at - first
            cells = at[:, None] + np.arange(WINDOW)
            right = np.where(np.arange(WINDOW) < size[:, None], s.data[np.minimum(cells, len(s.data) - 1)], 0).astype(np.uint8)
            cells = at[:, None] - 1 - np.arange(LEFT)  # the nearest byte first
            left = np.where(np.arange(LEFT) < left_size[:, None], s.data[np.maximum(cells, 0)], 0).astype(np.uint8)
            held.append((right, size, left, left_size, *s.owner(hit)))
            n += len(hit)
            if n >= RUN_ENTRIES:
                yield from _sorted_run(*map(np.concatenate, zip(*held, strict=True)), splitters)
                held, n = [], 0
        if held:
            yield from _sorted_run(*map(np.concatenate, zip(*held, strict=True)), splitters)

    return texts.mapInArrow(run, _SENT_SQL)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Sorted runs (strings, and the length of the prefix each shares with the one before) merged by a loser tree.

    Returns the run of each string in order, the string's number in it, and the prefix it shares with the string before.
    Known prefixes are never compared again: each loser keeps the length that it shares with the last winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [s for s, _ in runs] + [[] for _ in range(k - len(runs))]
    lengths = [p for _, p in runs]
    current = [s[0] if s else None for s in strings]
    common, number = [0] * k, [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser, whose common prefix with the winner is kept."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        ca, cb = common[a], common[b]
        if ca != cb:
            return (a, b) if ca > cb else (b, a)
        if x == y:
            if b < a:
                a, b = b, a
            common[b] = len(x)
            return a, b
        most = min(len(x), len(y))
        while ca < most and x[ca] == y[ca]:
            ca += 1
        if ca == most and len(x) < len(y) or ca < most and x[ca] < y[ca]:
            common[b] = ca
            return a, b
        common[a] = ca
        return b, a

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    of_run, of_number, shared = [], [], []
    while current[winner] is not None:
        of_run.append(winner)
        i = number[winner]
        of_number.append(i)
        shared.append(common[winner])
        i += 1
        if i < len(strings[winner]):
            number[winner], current[winner], common[winner] = i, strings[winner][i], lengths[winner][i]
        else:
            current[winner] = None
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1
    return of_run, of_number, shared


def later_windows(shared: np.ndarray, size: np.ndarray, left: np.ndarray, left_size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For sorted entries and each offset (a column): whether the window there also starts in a smaller document."""
    n = len(size)
    out = np.zeros((n, LEFT + 1), bool)
    if not n:
        return out
    group = np.cumsum(shared < ANCHOR)
    order = np.lexsort((left_size, *reversed(_columns(left)), group))
    near = _shared(left[order], left_size[order])
    near[np.concatenate([[True], np.diff(group[order]) > 0])] = -1
    for o in range(LEFT + 1):
        use = np.flatnonzero((left_size >= o) & (size >= WINDOW - o))
        if not len(use):
            continue
        before = np.empty(n, np.int64)
        before[order] = np.cumsum(near < o)
        key = (np.cumsum(shared < WINDOW - o) * (n + 1) + before)[use]
        by = np.argsort(key, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) > 0]))
        least = np.minimum.reduceat(doc[use][by], begins)
        least = np.repeat(least, np.diff(np.concatenate([begins, [len(by)]])))
        out[use[by], o] = doc[use][by] > least
    return out


def _merge_range(group: pa.Table) -> pa.Table:
    """Removed ranges ``doc, hash, begin, end`` of one range of suffixes, or of ranges known before."""
    out: list[tuple] = []
    runs, parts = [], []
    for row in group.to_pylist():
        if row["shared"] is None:
            out.append(tuple(np.frombuffer(row[c], np.int64) for c in ("doc", "hash", "place", "rest")))
            continue
        row = {c: _unpacked(x) for c, x in row.items() if c != "part"}
        shared, sizes, rest, strings, last, at = row["shared"], row["sizes"], row["rest"], [], b"", 0
        for p, n in zip(shared, sizes, strict=True):
            last = last[:p] + rest[at : at + n - p]
            at += n - p
            strings.append(last)
        runs.append((strings, list(shared)))
        left_size = np.frombuffer(row["left_sizes"], np.uint8).astype(np.int64)
        left = np.zeros((len(left_size), LEFT), np.uint8)
        left[np.arange(LEFT) < left_size[:, None]] = np.frombuffer(row["left"], np.uint8)
        parts.append((np.frombuffer(sizes, np.uint8).astype(np.int64), left, left_size, *[_from_planes(row[c], 8).view(np.int64) for c in ("doc", "hash", "place")]))
    if runs:
        run, number, shared = (np.array(x, np.int64) for x in merge(runs))
        begins = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        at = begins[run] + number
        size, left, left_size, doc, key, place = (np.concatenate(x)[at] for x in zip(*parts, strict=True))
        # anchors of one document alone repeat nothing
        cut = np.flatnonzero(shared < ANCHOR)
        counts = np.diff(np.concatenate([cut, [len(shared)]]))
        several = np.repeat(np.minimum.reduceat(doc, cut) < np.maximum.reduceat(doc, cut), counts)
        shared, size, left, left_size, doc, key, place = (x[several] for x in (shared, size, left, left_size, doc, key, place))
        later = later_windows(shared, size, left, left_size, doc)
        edge = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)  # windows at offsets from low to high - 1
        out.append((doc[i], key[i], place[i] - high + 1, place[i] - low + WINDOW))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    return pa.table(dict(zip(("doc", "hash", "begin", "end"), map(pa.array, columns), strict=True)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, doc, hash, text``: texts in UTF-8 and their keys, the id and, only if some id repeats, the text's hash."""
    doc, text = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unique = docs.groupBy(doc.alias("doc")).count().where("count > 1").isEmpty()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), doc.alias("doc"), (F.lit(0).cast("long") if unique else F.xxhash64(text)).alias("hash"), text.cast("binary").alias("text"))


def repeated_ranges(keyed: DataFrame, slot_bits: int = SLOT_BITS) -> DataFrame:
    """``doc long, hash long, begin long, end long``: byte ranges to remove, some of them overlapping, of the texts with these keys; a written table."""
    if slot_bits < _BUCKETS.bit_length() + 2:
        raise ValueError("every bucket needs a byte of slots")
    spark = keyed.sparkSession
    texts = keyed.where(F.octet_length("text") >= WINDOW).select("doc", "hash", "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    every = max(1, size // (LEFT // 2 + 1) // SAMPLE)
    counted = materialise(_count_anchors(texts, slot_bits, every), "anchors")
    bitmap = _frequent_slots(counted.where("bucket is not null").select("bucket", "slots", "counts"), 2, slot_bits)
    sampled = counted.where("bucket is null").select("slots", "sample").collect()
    discard(counted)
    slots = np.array([int.from_bytes(r["slots"], "big") for r in sampled], np.int64)
    kept = np.array([bytes(r["sample"]) for r in sampled], f"S{ANCHOR}")[(bitmap[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1]
    ranges = int(max(1, -(-len(kept) * every // RANGE_ENTRIES)))
    kept.sort()
    splitters = np.unique(kept[np.arange(1, ranges) * len(kept) // ranges]) if ranges > 1 else kept[:0]
    sent = _send(texts, bitmap, splitters, slot_bits)
    return materialise(sent.groupBy("part").applyInArrow(_merge_range, "doc long, hash long, begin long, end long"), "ranges")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text, ranges`` to ``key, kept, spans``."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for key, text, ranges in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            text, spans = text.as_py(), []
            for begin, end in sorted((r["begin"], r["end"]) for r in ranges.as_py() or ()):
                if spans and begin <= spans[-1]["end"]:
                    spans[-1]["end"] = max(end, spans[-1]["end"])
                else:
                    spans.append({"begin": begin, "end": end})
            edges = [0, *(x for s in spans for x in (s["begin"], s["end"])), len(text)]
            kept = b"".join(text[b:e] for b, e in zip(edges[::2], edges[1::2], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.schema.field(0).type), pa.array([kept], pa.binary()), pa.array([spans], kind)], ["key", "kept", "spans"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS) -> DataFrame:
    """One row for each input row: ``doc_id long, n_bytes long, kept binary, spans array<struct<begin long, end long>>``.

    Of the text's UTF-8 (null: empty), ``kept`` lacks every byte that a string of ``WINDOW`` bytes covers which also starts in a document
    with a smaller id; ``spans`` are the removed runs, in order, as long as can be. Strings are judged on the input and never span
    documents; what remains may begin or end inside a character. Rows with the same id don't remove each other's bytes; equal rows get
    equal results. Null ids are after all others and alike. Texts shorter than a window stay. An empty table gives an
    empty result. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    source = _keyed(docs, id_col, text_col)
    found = repeated_ranges(source, slot_bits)
    ranges = materialise(found.groupBy("doc", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")), "spans")
    discard(found)
    loses = fresh(source, "loses")
    source = maybe_in(source, [F.col("doc"), F.col("hash")], ranges, [F.col("doc"), F.col("hash")], loses)
    met = source.where(F.col(loses)).join(ranges.hint("merge"), ["doc", "hash"], "left")
    spans = "array<struct<begin: long, end: long>>"
    changed = met.select("doc_id", "text", "ranges").mapInArrow(_cut, f"key long, kept binary, spans {spans}").select(
        F.col("key").alias("doc_id"), (F.octet_length("kept") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])).alias("n_bytes"), "kept", "spans"
    )
    same = source.where(~F.col(loses)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("kept"), F.array().cast(spans).alias("spans"))
    return changed.unionByName(same)
