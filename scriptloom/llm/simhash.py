"""SimHash near-duplicates, found with vantage-point trees under Hamming distance.

Plan, all of it over whole texts and all rows:

1. Fingerprint every text (Arrow batches, vectorised bit counts); the text is read once and never shuffled.
2. Collapse equal fingerprints to their smallest id, so a group of exact copies of any size is one row from here on.
3. Cut the fingerprint into blocks. Two fingerprints that differ in at most ``t`` bits differ in at most
   ``floor(t / blocks)`` bits of some block (pigeonhole), so one vantage-point tree per block searched with that small
   radius finds every pair. A single tree over all 64 bits is exact as well, but distances to a vantage point spread by
   4 bits only, and a radius of 3 puts more than half of the rows on a boundary at each level.
4. The top of each tree is built on the driver from a bounded sample; its leaves are shards. Every fingerprint goes to
   its home shard and, where the triangle inequality can't rule out a partner behind a boundary, to the overlapping
   shards with a higher number, so each pair meets exactly once.
   A shard that is larger than a task may hold (fingerprints that share a block value can't be split by any tree of that
   block) is dealt into tiles by hash, and each pair of tiles is a task.
5. Each shard continues the tree in memory down to small leaves and compares inside them. It returns links of each
   fingerprint to the root of its set, not pairs: at most one row for each row it got.
6. Connected components over those links.

Where a candidate only becomes a link by a comparison of texts (``similar_documents``), no set may be formed from unproven
pairs. There candidates are sought twice: first a few partners of each row, near by fingerprint and with a min-hash key in common,
whose proven links join most of each group, then every pair whose two rows are still in different components.

The first search is a sketch and only saves work. The second misses nothing: sets of similarity s have a shingle in common among
the first ``n - ceil(s * n) + 1`` of each, in any order that is the same for all (prefix filter), so pairs meet by these
shingles, and all that a pair is dropped for proves it too different: sizes, parity bitmaps, and the number of shingles that
the prefixes have in common. A bounded sample puts common shingles last in the order; the order decides what it costs, never
what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._spark import bounded_batches, discard, fresh, materialise, maybe_in

#: Rows of the sample that the top of a tree is built from, at most, and the deepest that it gets (16384 shards a block).
SAMPLE_ROWS = 1 << 16
MAX_DEPTH = 14
#: Fingerprints that a task gets of one shard, at most about; a larger shard is compared in pairs of tiles.
TASK_ROWS = 1 << 20
#: Shards are split in memory down to this many rows.
LEAF_ROWS = 512
#: Candidate pairs are compared in this number of tiles, squared.
TILES = 64
#: Shingles whose bits are counted at once; below 2**24, float32 counts are exact.
COUNT_ROWS = 1 << 15
#: Shingles that are hashed again at once for all min-hashes of a text.
MIN_ROWS = 1 << 12
#: Rows with one min-hash key for which :func:`separate_with_key` is meant; :func:`similar_documents` has no such limit.
GROUP_ROWS = 1 << 10
#: Rows with one min-hash key that all look for their nearest; where more share it, a row looks at ``NEIGHBOURS`` before it.
NEAREST_ROWS = 1 << 5
NEIGHBOURS = 4
#: Texts, about, whose shingles are counted for the order of prefixes, and common shingles that it puts last, at most.
ORDER_ROWS = 1 << 13
ORDER_SHINGLES = 1 << 16
#: Rows with one shingle of their prefixes that a task compares with each other; more are dealt to tiles.
PREFIX_ROWS = 1 << 13


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, width: int, distinct: bool = False) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words; fewer words make one shingle, none make no shingle."""
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    n = max(1, len(w) - width + 1)
    parts = zip(*(w[i:] for i in range(width)), strict=False) if len(w) >= width else [tuple(w)]
    found = np.fromiter(map(xxh64_intdigest, map(b" ".join, parts), repeat(42)), dtype=np.uint64, count=n)
    return np.unique(found) if distinct else found


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of SplitMix64 over a shifted state)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(hashes: np.ndarray, n64: int = 1) -> np.ndarray:
    """``n64`` words of 64 bits: a bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    out = np.zeros(n64, np.uint64)
    for k in range(n64 if len(hashes) else 0):
        h = _remix(hashes, k) if k else hashes
        counts = np.zeros(64, np.float64)
        for at in range(0, len(h), COUNT_ROWS):
            part = np.ascontiguousarray(h[at : at + COUNT_ROWS]).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
            counts += np.ones(len(bits), np.float32) @ bits
        out[k] = np.packbits((counts * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each of ``bits`` classes of hashes, whether it holds an odd number of them, in words of 64 bits."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def min_hash_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys, each of the minima of ``rows`` permutations of the hashes; no hashes: no keys.

    Two sets of similarity s agree in a minimum with chance s, so in a key with chance ``s**rows``.
    """
    if not len(hashes):
        return np.empty(0, np.uint64)
    by = _remix(np.arange(bands * rows, dtype=np.uint64), 11) | np.uint64(1)
    low = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), MIN_ROWS):
        low = np.minimum(low, (by[:, None] * hashes[at : at + MIN_ROWS]).min(axis=1))
    keys = np.arange(bands, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        keys = _remix(keys ^ part, 1)
    return keys


def prefix_shingles(hashes: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first ``n - ceil(similarity * n) + 1`` of n distinct hashes, those of ``common`` (ascending) last, by their ``times``."""
    if not len(hashes):
        return hashes
    late = np.zeros(len(hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = np.where(common[at] == hashes, times[at], 0)
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, late))[:size]]


def common_shingles(docs: DataFrame, search: Search, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``ORDER_ROWS`` texts have, ascending, and how many: the commonest ``ORDER_SHINGLES``."""
    rows = docs.count()
    chosen = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) < int(min(1, ORDER_ROWS / max(1, rows)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t.as_py(), search.width, True).view(np.int64))], ["shingle"])

    counted = _keyed(docs, id_col, text_col).where(chosen).select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = counted.where("n > 1").orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    common, times = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(common)
    return common[order], times[order]


def can_be_similar(n: np.ndarray, bitmaps: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """False only where sets of shingles can't be so similar (Sandes et al., 2020).

    Each element that only one of two sets has flips one bit of its parity bitmap, so the sets differ in as many elements as the
    bitmaps in bits, at least. That bounds the elements in common from above; sizes alone do as well.
    """
    both = n[i] + n[j]
    differ = np.abs(n[i] - n[j])
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        bits = np.bitwise_count(bitmaps[i[part]] ^ bitmaps[j[part]]).sum(axis=1, dtype=np.int64)
        differ[part] = np.maximum(differ[part], bits)
    common = (both - differ) // 2
    return common * (1 + similarity) >= both * similarity - 1e-6


@dataclass(frozen=True)
class Search:
    """How fingerprints are made and compared.

    ``blocks`` of ``64 * n64 / blocks`` bits are searched with ``radius``; with ``blocks * (radius + 1) > max_bits``
    every pair within ``max_bits`` is found.
    """

    width: int = 3
    n64: int = 1
    distinct: bool = False
    max_bits: int = 3
    blocks: int = 2
    radius: int = 1
    #: Own rows of a shard, about. Copies across boundaries grow with the depth, so long fingerprints get large shards.
    shard_rows: int = 1 << 16
    task_rows: int = TASK_ROWS
    #: Where only the nearest partner is asked for, one within so many bits is near enough.
    close_bits: int = 0
    #: Bits of the parity bitmap of a set of shingles, a multiple of 64; 0: none is made.
    parity_bits: int = 0
    #: Min-hash keys of a set of shingles, and the minima that each is made of; 0: none are made.
    bands: int = 0
    band_rows: int = 4

    @property
    def block_bits(self) -> int:
        return 64 * self.n64 // self.blocks

    @property
    def exact(self) -> bool:
        return self.blocks * (self.radius + 1) > self.max_bits


#: The production search: three-word shingles, 64 bits, at most 3 differing bits.
EXACT_64 = Search()
#: For a similarity of 0.8 or more on five-word shingles: texts at 0.8 differ in 15 % of the bits (48 of 320), so a
#: 16-bit block differs in at most one bit with chance 0.28, and one of 20 blocks does with chance 0.9986. Pairs within
#: ``max_bits`` (0.8 plus more than five standard deviations) are candidates; their shingle sets are then compared exactly.
#: Min-hash keys are the same with chance 0.8**4, and one of 20 is with chance 0.99997.
SIMILAR_320 = Search(width=5, n64=5, distinct=True, max_bits=84, blocks=20, radius=1, shard_rows=1 << 19, close_bits=16, parity_bits=512, bands=20)


def _pack(rows: np.ndarray) -> list[bytes]:
    size = rows.shape[1] * 8
    raw = np.ascontiguousarray(rows).astype(">u8").tobytes()
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _unpack(column: pa.ChunkedArray | pa.Array, n64: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(array):
        return np.empty((0, n64), np.uint64)
    start = np.frombuffer(array.buffers()[1], np.int32, 1, 4 * array.offset)[0]  # all values have one length
    return np.frombuffer(array.buffers()[2], ">u8", len(array) * n64, int(start)).astype(np.uint64).reshape(-1, n64)


def _block(fps: np.ndarray, block: int, bits: int) -> np.ndarray:
    word, shift = divmod(block * bits, 64)
    mask = np.uint64(2**bits - 1 if bits < 64 else 2**64 - 1)
    return (fps[:, word] >> np.uint64(shift)) & mask


def fingerprints(docs: DataFrame, search: Search = EXACT_64, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """``doc_id long, text_hash long, fp binary, digest binary`` for each row: the hash of the text as it is, the words of the
    fingerprint, big-endian, and 128 bits that stand for the shingles it was made from; with ``search.parity_bits`` also their
    number and parity bitmap, ``n long, parity binary``, with ``search.bands`` their min-hash keys, ``keys array<long>``, and
    with a ``similarity`` those that a text so similar must share one of, ``prefix array<long>`` (see :func:`prefix_shingles`).
    Null text counts as empty."""
    bounded_batches(docs.sparkSession)
    more = ["n", "parity"] if search.parity_bits else []
    keyed = ["keys"] if search.bands else []
    order = common_shingles(docs, search, id_col, text_col) if similarity is not None else None
    first = ["prefix"] if order else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows, digests, sizes, bitmaps, keys, prefixes = [], [], [], [], [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), search.width, search.distinct)
                rows.append(fingerprint(hashes, search.n64))
                digests.append(xxh3_128_digest(hashes.tobytes()))
                if more:
                    sizes.append(len(hashes))
                    bitmaps.append(parity(hashes, search.parity_bits))
                if keyed:
                    keys.append(min_hash_keys(hashes, search.bands, search.band_rows).view(np.int64))
                if first:
                    prefixes.append(prefix_shingles(hashes, similarity, *order).view(np.int64))
            if rows:
                columns = [batch.column(0), batch.column(1), pa.array(_pack(np.array(rows)), pa.binary()), pa.array(digests, pa.binary())]
                columns += [pa.array(sizes, pa.int64()), pa.array(_pack(np.array(bitmaps)), pa.binary())] if more else []
                columns += [pa.array(x, pa.list_(pa.int64())) for x, there in ((keys, keyed), (prefixes, first)) if there]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "digest", *more, *keyed, *first])

    schema = "doc_id long, text_hash long, fp binary, digest binary" + ", n long, parity binary" * bool(more) + ", keys array<long>" * bool(keyed) + ", prefix array<long>" * bool(first)
    return _keyed(docs, id_col, text_col).mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_hash, text``: id and hash name a document, also where an id repeats with another text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


class Tree:
    """Top of a vantage-point tree in heap order: node i has children 2i (near) and 2i + 1 (far)."""

    def __init__(self, depth: int, bits: int, sample: np.ndarray, radius: int, seed: int = 42) -> None:
        self.depth, self.bits, self.radius = depth, bits, radius
        self.point = np.zeros(2**depth, np.uint64)
        self.cut = np.full(2**depth, bits // 2, np.int64)
        rng = np.random.default_rng(seed)
        parts = {1: sample}
        for node in range(1, 2**depth):
            part = parts.pop(node, sample[:0])
            if len(part):
                self.point[node], self.cut[node] = choose(part, bits, radius, rng)
            near = np.bitwise_count(part ^ self.point[node]) <= self.cut[node]
            parts[2 * node], parts[2 * node + 1] = part[near], part[~near]

    def shards(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value its home shard and the overlapping shards above it: row numbers, shards, whether home."""
        row, node, home = np.arange(len(values)), np.ones(len(values), np.int64), np.ones(len(values), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(values[row] ^ self.point[node]).astype(np.int64)
            near = d <= self.cut[node]
            to_near, to_far = d - self.radius <= self.cut[node], d + self.radius > self.cut[node]
            row, node, home = (
                np.concatenate([row[to_near], row[to_far]]),
                np.concatenate([2 * node[to_near], 2 * node[to_far] + 1]),
                np.concatenate([(home & near)[to_near], (home & ~near)[to_far]]),
            )
        leaf = node - 2**self.depth
        own = np.zeros(len(values), np.int64)
        own[row[home]] = leaf[home]
        keep = home | (leaf > own[row])
        return row[keep], leaf[keep], home[keep]


def choose(part: np.ndarray, bits: int, radius: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int]:
    """The vantage point and cut, of a few, that split a sample evenly with the fewest rows near the boundary."""
    best = None
    for point in part[rng.integers(0, len(part), tries)]:
        count = np.bincount(np.bitwise_count(part ^ point), minlength=bits + 1)
        below = np.cumsum(count) / len(part)
        for cut in range(bits):
            smaller = min(below[cut], 1 - below[cut])
            edge = count[max(0, cut - radius + 1) : cut + radius + 1].sum() / len(part)
            score = abs(0.5 - smaller) + edge
            if best is None or score < best[0]:
                best = (score, point, cut)
    return best[1], best[2]


class _Links:
    """Links found in one shard, folded into sets as they come; or the nearest lower partner of each row."""

    def __init__(self, home: np.ndarray, nearest: bool, close: int = -1) -> None:
        n = len(home)
        self.root, self.nearest, self.close, self.visitor = np.arange(n), nearest, close, ~home
        self.best = np.full(n, np.iinfo(np.int64).max)

    def undecided(self, q: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The rows of ``q`` about which a comparison with ``h`` can still say something new.

        If ``h`` is one set already, its members needn't meet again; that keeps a dense group from costing its square.
        A row that is near enough to a partner asks for none, but a visitor must still be found by the rows of ``h`` above
        it: it is never in ``h`` itself.
        """
        if self.nearest:
            asks = self.best >= (self.close + 1) << 40
            return q[asks[q] | self.visitor[q] & (q < h[asks[h]].max(initial=-1))]
        roots = self.root[h]
        return q[self.root[q] != roots[0]] if (roots == roots[0]).all() else q

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        high, low = np.maximum(a, b), np.minimum(a, b)
        if self.nearest:
            np.minimum.at(self.best, high, d.astype(np.int64) << 40 | low)
            return
        root = self.root
        while len(high):
            m = np.minimum(root[high], root[low])
            np.minimum.at(root, root[high], m)
            np.minimum.at(root, root[low], m)
            while not np.array_equal(up := root[root], root):
                root = up
            apart = root[high] != root[low]
            high, low = high[apart], low[apart]
        self.root = root

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if self.nearest:
            row = np.flatnonzero(self.best < np.iinfo(np.int64).max)
            return row, self.best[row] & ((1 << 40) - 1)
        row = np.flatnonzero(self.root != np.arange(len(self.root)))
        return row, self.root[row]


def _leaves(values: np.ndarray, home: np.ndarray, search: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The leaves of a shard's tree: rows that ask and the home rows that they are compared with."""
    rng, stack = np.random.default_rng(42), [(np.arange(len(values)), np.flatnonzero(home))]
    while stack:
        q, h = stack.pop()
        if not len(q) or not len(h):
            continue
        if len(h) > LEAF_ROWS:
            point, cut = choose(values[h[:: max(1, len(h) // 1024)]], search.block_bits, search.radius, rng, tries=4)
            dq, near = np.bitwise_count(values[q] ^ point).astype(np.int64), np.bitwise_count(values[h] ^ point) <= cut
            if 0.02 < near.mean() < 0.98:
                stack.append((q[dq - search.radius <= cut], h[near]))
                stack.append((q[dq + search.radius > cut], h[~near]))
                continue
        yield q, h


def _compare(fps: np.ndarray, values: np.ndarray, q: np.ndarray, h: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of ``q`` and ``h`` within the radius in the block and ``max_bits`` in all, and their distances."""
    i, j = np.nonzero(np.bitwise_count(values[q][:, None] ^ values[h][None, :]) <= search.radius)
    i, j = q[i], h[j]
    d = np.zeros(len(i), np.int64)
    for k in range(search.n64):
        d = d + np.bitwise_count(fps[i, k] ^ fps[j, k])
        ok = d <= search.max_bits
        i, j, d = i[ok], j[ok], d[ok]
    ok = i != j
    return i[ok], j[ok], d[ok]


def link_shard(fps: np.ndarray, values: np.ndarray, home: np.ndarray, search: Search, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links among the home rows of a shard and from its visitors to them; rows stand in order of their ids."""
    links = _Links(home, nearest, search.close_bits)
    short = values.astype(f"u{max(1, search.block_bits // 8)}")  # pairs are compared by block first
    for q, h in _leaves(values, home, search):
        for at in range(0, len(h), 4 * LEAF_ROWS):
            others = h[at : at + 4 * LEAF_ROWS]
            for start in range(0, len(q), 1024):
                part = links.undecided(q[start : start + 1024], others)
                if len(part):
                    links.add(*_compare(fps, short, part, others, search))
    return links.pairs()


def separate_shard(fps: np.ndarray, block: int, home: np.ndarray, label: np.ndarray, search: Search, possible: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a shard whose labels differ, as they are found, but for those that aren't ``possible``. A pair that meets in
    several blocks is given in the first."""
    values = _block(fps, block, search.block_bits)
    short = values.astype(f"u{max(1, search.block_bits // 8)}")
    for q, h in _leaves(values, home, search):
        h = h[np.argsort(label[h], kind="stable")]  # then most of a large component fills chunks that its rows can skip
        for at in range(0, len(h), 4 * LEAF_ROWS):
            others = h[at : at + 4 * LEAF_ROWS]
            one = label[others[0]] == label[others[-1]]
            for start in range(0, len(q), 1024):
                part = q[start : start + 1024]
                if one:
                    part = part[label[part] != label[others[0]]]
                if not len(part):
                    continue
                i, j, _ = _compare(fps, short, part, others, search)
                ok = (label[i] != label[j]) & ((i > j) | ~home[i])  # two home rows meet twice
                i, j = i[ok], j[ok]
                for k in range(block):
                    ok = np.bitwise_count(_block(fps[i], k, search.block_bits) ^ _block(fps[j], k, search.block_bits)) > search.radius
                    i, j = i[ok], j[ok]
                if possible:
                    ok = possible(i, j)
                    i, j = i[ok], j[ok]
                if len(i):
                    yield np.maximum(i, j), np.minimum(i, j)


def _routed(reps: DataFrame, search: Search) -> DataFrame:
    """Copies of ``rep long, fp binary, label long`` for each block and shard that the row belongs to or visits.

    ``i`` and ``j`` name the pair of tiles of the shard that a copy is for, ``tile`` its own; both are 0 in a shard that one
    task can hold.
    """
    n = reps.count()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n) / search.shard_rows)))))
    sample = reps.select("fp").orderBy(F.xxhash64("fp")).limit(min(SAMPLE_ROWS, 256 << depth)).collect() if depth else []
    sample = np.frombuffer(b"".join(bytes(r.fp) for r in sample), ">u8").astype(np.uint64).reshape(-1, search.n64)
    trees = [Tree(depth, search.block_bits, _block(sample, k, search.block_bits), search.radius) for k in range(search.blocks)]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((search.blocks, 1 << depth), np.int64)
        for batch in batches:
            fps = _unpack(batch.column(0), search.n64)
            for k, tree in enumerate(trees):
                counts[k] += np.bincount(tree.shards(_block(fps, k, search.block_bits))[1], minlength=1 << depth)
        k, shard = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(shard), pa.array(counts[k, shard])], ["block", "shard", "n"])

    # one row for each block and shard at most: blocks * 2**MAX_DEPTH
    counted = reps.select("fp").mapInArrow(sizes, "block long, shard long, n long").groupBy("block", "shard").agg(F.sum("n").alias("n"))
    tiles = np.ones((search.blocks, 1 << depth), np.int64)
    for r in counted.where(F.col("n") > search.task_rows).collect() if n > search.task_rows else []:
        tiles[r["block"], r["shard"]] = -(-2 * r["n"] // search.task_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _unpack(batch.column(1), search.n64)
            mixed = _remix(np.bitwise_xor.reduce(fps, axis=1), 7) >> np.uint64(33)
            for k, tree in enumerate(trees):
                row, leaf, home = tree.shards(_block(fps, k, search.block_bits))
                of = tiles[k, leaf]
                tile = (mixed[row] % of.astype(np.uint64)).astype(np.int64)
                for other in range(int(of.max(initial=1))):
                    here = of > other
                    low, high = np.minimum(tile[here], other), np.maximum(tile[here], other)
                    at = pa.array(row[here])
                    keys = [pa.array(x.astype(np.int32)) for x in (np.full(len(low), k), leaf[here], low, high, tile[here])]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(home[here]), *(c.take(at) for c in batch.columns)], [*_ROUTE, "home", *batch.schema.names])

    return reps.mapInArrow(route, ", ".join([*(f"{c} int" for c in _ROUTE), "home boolean", *(f"{c} {t}" for c, t in reps.dtypes)]))


_ROUTE = ["block", "shard", "i", "j", "tile"]
_TASK = ["block", "shard", "i", "j"]


def candidate_links(reps: DataFrame, search: Search, nearest: bool = False) -> DataFrame:
    """``a long, b long`` with a > b: links between the rows of ``rep long, fp binary``.

    ``nearest`` false: a spanning forest of all pairs within ``max_bits`` that share a shard, which leaves connected
    components as they are. ``nearest`` true: for each row and shard, the nearest of the partners with a smaller id, or
    one within ``close_bits``.
    """

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        fps, block = _unpack(table["fp"], search.n64), table["block"][0].as_py()
        rep, home = table["rep"].to_numpy(), table["home"].to_numpy(zero_copy_only=False)
        a, b = link_shard(fps, _block(fps, block, search.block_bits), home, search, nearest)
        return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64())})

    return _routed(reps.select("rep", "fp"), search).groupBy(*_TASK).applyInArrow(link, "a long, b long").distinct()


def separate_pairs(reps: DataFrame, search: Search, similarity: float | None = None) -> DataFrame:
    """``a long, b long`` with a > b: every pair of ``rep long, fp binary, label long`` that the search finds and whose labels
    differ, once. A shard's pairs are returned as they are found and never held together. With a ``similarity``, ``reps`` has
    ``n`` and ``parity`` too, and pairs that these prove less similar aren't made: so near misses cost a comparison of bitmaps."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("rep")
        fps, block = _unpack(table["fp"], search.n64), table["block"][0].as_py()
        rep, home, label = table["rep"].to_numpy(), table["home"].to_numpy(zero_copy_only=False), table["label"].to_numpy()
        tile = table["tile"].to_numpy() if table["i"][0].as_py() != table["j"][0].as_py() else None
        possible = None
        if similarity is not None:
            n, bitmaps = table["n"].to_numpy(), _unpack(table["parity"], search.parity_bits // 64)
            possible = lambda i, j: can_be_similar(n, bitmaps, i, j, similarity)
        for a, b in separate_shard(fps, block, home, label, search, possible):
            if tile is not None:  # pairs inside a tile belong to the task of that tile alone
                across = tile[a] != tile[b]
                a, b = a[across], b[across]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], ["a", "b"])

    columns = ["rep", "fp", "label", *(["n", "parity"] if similarity is not None else [])]
    return _routed(reps.select(*columns), search).groupBy(*_TASK).applyInArrow(pairs, "a long, b long")


def shared_keys(reps: DataFrame) -> DataFrame:
    """``key long, rep long, next long, rows long``: the keys of ``rep long, keys array<long>`` that several rows have, the row's key
    after each (after the last, its first), and how many rows have it."""
    after = F.col("keys")[(F.col("at") + 1) % F.size("keys")]
    keys = reps.select("rep", "keys", F.posexplode("keys").alias("at", "key")).select("key", "rep", after.alias("next"))
    rows = keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    return keys.join(rows.hint("merge"), "key").select("key", "rep", "next", "rows")


def _longs(column: str, n: int) -> Column:
    """The ``n`` words of 64 bits of a binary column, as an array of longs."""
    return F.array(*[F.conv(F.hex(F.substring(column, 8 * k + 1, 8)), 16, -10).cast("long") for k in range(n)])


def _differing(x: str, y: str, n: int) -> Column:
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(1, n)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))


def _met(groups: DataFrame, reps: DataFrame, search: Search, columns: list[Column], also: Column | None = None) -> DataFrame:
    """Pairs ``x``, ``y`` of rows with one key, x the one of larger rep, whose fingerprints are within ``max_bits``."""
    rows = groups.join(reps.select("rep", _longs("fp", search.n64).alias("bits"), *columns).hint("merge"), "rep")
    near = _differing("x.bits", "y.bits", search.n64) <= search.max_bits
    order = F.col("x.rep") > F.col("y.rep")
    on = (F.col("x.key") == F.col("y.key")) & order & (near if also is None else also & near)
    return rows.alias("x").join(rows.alias("y").hint("merge"), on)


def nearest_with_key(groups: DataFrame, reps: DataFrame, search: Search) -> DataFrame:
    """``a long, b long`` with a > b: for each row of ``key long, rep long`` the nearest of the smaller reps that have its key.

    ``reps`` has ``rep long, fp binary``; reps are at least 0 and below 2**56.
    """
    far = F.shiftleft(_differing("x.bits", "y.bits", search.n64).cast("long"), 56).bitwiseOR(F.col("y.rep"))
    found = _met(groups, reps, search, []).groupBy("x.key", "x.rep").agg(F.min(far).alias("b"))
    return found.select(F.col("rep").alias("a"), F.col("b").bitwiseAND(F.lit((1 << 56) - 1)).alias("b")).distinct()


def _possible(search: Search, similarity: float) -> Column:
    """Whether sizes ``n`` and parity bitmaps ``odd`` of ``x`` and ``y`` allow that similarity (see :func:`can_be_similar`)."""
    both = F.col("x.n") + F.col("y.n")
    differ = F.greatest(F.abs(F.col("x.n") - F.col("y.n")), _differing("x.odd", "y.odd", search.parity_bits // 64).cast("long"))
    return F.floor((both - differ) / 2) * (1 + similarity) >= both * similarity - 1e-6


def neighbours_with_key(groups: DataFrame, reps: DataFrame, search: Search, similarity: float) -> DataFrame:
    """``a long, b long`` with a > b: pairs of ``key long, rep long, next long`` with one key that stand at most ``NEIGHBOURS`` places
    apart where the rows of the key are in order of ``next``, within ``max_bits`` and not proven less similar. So a row is compared
    with a few others, first with those of another key in common, however many have its key. ``reps`` has ``rep, fp, n, parity``."""
    row = F.struct("rep", _longs("fp", search.n64).alias("bits"), _longs("parity", search.parity_bits // 64).alias("odd"), "n")
    rows = groups.join(reps.select("rep", row.alias("x")).hint("merge"), "rep")
    order = Window.partitionBy("key").orderBy("next", "rep")
    before = F.explode(F.array(*[F.col(f"y{k}") for k in range(1, NEIGHBOURS + 1)])).alias("y")
    pairs = rows.select("x", *[F.lag("x", k).over(order).alias(f"y{k}") for k in range(1, NEIGHBOURS + 1)]).select("x", before)
    found = pairs.where(F.col("y").isNotNull() & (_differing("x.bits", "y.bits", search.n64) <= search.max_bits) & _possible(search, similarity))
    return found.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()


def separate_with_key(groups: DataFrame, reps: DataFrame, search: Search, similarity: float) -> DataFrame:
    """``a long, b long`` with a > b: every pair of ``key long, rep long`` with one key whose labels differ, once, but for those
    that sizes and parity bitmaps prove less similar (see :func:`can_be_similar`). ``reps`` has ``rep, fp, n, parity, label``."""
    columns = [_longs("parity", search.parity_bits // 64).alias("odd"), F.col("n"), F.col("label")]
    pairs = _met(groups, reps, search, columns, (F.col("x.label") != F.col("y.label")) & _possible(search, similarity))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def separate_with_prefix(reps: DataFrame, search: Search, similarity: float) -> DataFrame:
    """``a long, b long`` with a > b: every pair of ``rep, n, parity, prefix, label`` whose labels differ and whose prefixes meet,
    once, but for those that are proven less similar.

    Shingles of one label are dropped before rows are copied for the rest. Of two sets, all that stands up to the end of the prefix
    that ends first is in both prefixes, so what they have in common is at most what the prefixes have, and the rest of that set:
    ``ceil(s * n) - 1`` shingles. Where ``PREFIX_ROWS`` rows and more share a shingle, pairs of tiles of them are tasks of their own.
    """
    tokens = reps.select("rep", "label", F.explode("prefix").alias("key"))
    several = tokens.groupBy("key").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    tiles = F.ceil(F.col("rows") / PREFIX_ROWS).cast("int")
    met = tokens.join(several.select("key", tiles.alias("tiles")).hint("merge"), "key").select("key", "rep", "tiles")
    rows = reps.select("rep", "label", "n", _longs("parity", search.parity_bits // 64).alias("odd"))
    rows = met.join(rows.hint("merge"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    x = rows.select("*", other.alias("with")).select("*", F.col("own").alias("i"), F.col("with").alias("j"))
    y = rows.select("*", other.alias("with")).select("*", F.col("with").alias("i"), F.col("own").alias("j"))
    on = (F.col("x.rep") > F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & _possible(search, similarity)
    for c in ("key", "i", "j"):
        on = (F.col(f"x.{c}") == F.col(f"y.{c}")) & on
    pairs = x.alias("x").join(y.alias("y").hint("merge"), on)
    counted = pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n")).agg(F.count("*").alias("common"))
    most = F.col("common") + F.ceil(F.greatest("m", "n") * similarity - 1e-6) - 1
    return counted.where(most * (1 + similarity) >= (F.col("m") + F.col("n")) * similarity - 1e-6).select("a", "b")


def near_duplicates(docs: DataFrame, search: Search = EXACT_64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id long, fingerprint string, component_id long``.

    Fingerprints within ``search.max_bits`` are linked; ``component_id`` is the smallest id reachable by links, the
    row's own included. Null or empty text: fingerprint zero, linked like any other. A null id can't be named by a
    component: such rows get their fingerprint, a null component, and link nothing. Rows that repeat an id are returned
    each and are one node: whatever is linked to one of their texts is reachable from all, so they share a component. An
    empty table gives an empty result. Other columns are ignored. Ids are numbers or numeric texts.
    """
    if not search.exact:
        raise ValueError("this search can miss pairs: use similar_documents")
    fps = materialise(fingerprints(docs, search, id_col, text_col).select("doc_id", "fp"), "fingerprints")
    reps = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps = materialise(reps, "representatives")
    # an id that stands at several fingerprints joins them
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("_low"), F.max("fp").alias("_high")).where("_low <> _high")
    shared = fps.join(several.select("doc_id"), "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    merged = components(candidate_links(reps, search).unionByName(shared), "a", "b")
    named = reps.join(merged, reps.rep == merged.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; 1 if neither has one."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def similar_documents(docs: DataFrame, similarity: float = 0.8, search: Search = SIMILAR_320, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text_hash long, component_id long, kept boolean`` for each document with a near duplicate.

    A document is an id and a text; ``text_hash`` (XXH64 of the text, null as empty) tells apart texts that share an id.
    A link holds only if the Jaccard similarity of the two sets of ``search.width``-word shingles, computed over the whole
    texts, is at least ``similarity``, and every such pair is in one component. First each row is compared with its nearest by
    fingerprint among those that share a min-hash key, or with a few neighbours where many do; then all pairs that are still apart
    and whose prefixes meet (:func:`separate_with_prefix`), which no similar pair escapes. So the comparisons grow with the documents and with the pairs of near misses. ``component_id`` is the smallest id
    of the component; of each component the document with the smallest (id, hash) is ``kept``. Texts without words are
    similar to each other. Rows with a null id have no duplicates; rows that repeat id and text are one document. An empty
    table gives an empty result. Other columns, whatever their names, are ignored. Ids are numbers or numeric texts.
    """
    bounded_batches(docs.sparkSession)
    fps = fingerprints(docs, search, id_col, text_col, similarity).where("doc_id is not null").dropDuplicates(["doc_id", "text_hash"])
    fps = materialise(fps.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    # one row for equal sets of shingles only: equal fingerprints of different sets are candidates like any others
    reps = materialise(fps.groupBy("fp", "digest", "n", "parity").agg(F.min("node").alias("rep"), *[F.first(c).alias(c) for c in fps.columns if c in ("keys", "prefix")]), "representatives")
    equal = fps.join(reps, ["fp", "digest"]).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    names = fps.select("node", "doc_id", "text_hash")
    texts = _keyed(docs, id_col, text_col)
    # without keys no row is proposed a partner here, and all pairs meet by prefixes
    shared = materialise(shared_keys(reps if search.bands else reps.withColumn("keys", F.array().cast("array<long>"))), "shared")
    few = F.col("rows") <= NEAREST_ROWS
    links = nearest_with_key(shared.where(few).select("key", "rep"), reps, search)
    links = links.unionByName(neighbours_with_key(shared.where(~few).select("key", "rep", "next"), reps, search, similarity))
    links = materialise(links.distinct(), "candidates")
    proven = proven_pairs(links, names, texts, similarity, search.width)
    joined = materialise(components(proven.unionByName(equal), "a", "b"), "joined")
    named = reps.join(joined.hint("merge"), reps.rep == joined.node, "left")
    named = materialise(named.select("rep", "n", "parity", "prefix", F.coalesce("component", "rep").alias("label")), "labelled")
    apart = separate_with_prefix(named, search, similarity)
    apart = materialise(apart.join(links.hint("merge"), ["a", "b"], "left_anti"), "apart")
    more = proven_pairs(apart, names, texts, similarity, search.width)
    merged = components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")
    for done in (reps, shared, links, joined, named, apart):
        discard(done)
    merged = merged.join(names, "node")
    first = merged.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    found = merged.join(first, "component")
    return found.select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("first")).alias("kept"))


def proven_pairs(pairs: DataFrame, names: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of ``a long, b long`` whose texts have shingle sets at least so similar.

    ``names`` says which ``doc_id, text_hash`` a ``node`` is, ``texts`` has their ``text``. Pairs are dealt to ``TILES`` squared
    tiles by the hashes of both nodes. A text goes once to each tile that has a pair of it, at most ``2 * TILES`` times
    however many pairs it has, and is cut into shingles once there.
    """
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(TILES)).cast("int")
    tiled = materialise(pairs.select("a", "b", tile("a").alias("i"), tile("b").alias("j")), "tiled")
    wanted = tiled.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    # candidates only: the texts of documents without one aren't moved
    # (merge joins at every size: both sides grow with the corpus, so no plan may count on broadcasting one)
    key = ["doc_id", "text_hash"]
    some = materialise(names.join(wanted.select("node").distinct().hint("merge"), "node"), "wanted")
    columns = [F.col(c) for c in key]
    moved = maybe_in(texts, columns, some, columns, "_wanted").where("_wanted").drop("_wanted")
    moved = moved.join(some.hint("merge"), key).select("node", "text").dropDuplicates(["node"])
    there = wanted.join(moved.hint("merge"), "node")

    def verify(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        at = {d: k for k, d in enumerate(texts["node"].to_pylist())}
        column, sets = texts["text"], {}

        def shingles(doc: int) -> np.ndarray:
            if doc not in sets:
                sets[doc] = shingle_hashes(column[at[doc]].as_py(), width, True)
            return sets[doc]

        ok = [a in at and b in at and jaccard(shingles(a), shingles(b)) >= similarity for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    there = there.select(F.col("i").alias("k"), F.col("j").alias("l"), "node", "text")
    return tiled.groupBy("i", "j").cogroup(there.groupBy("k", "l")).applyInArrow(verify, "a long, b long")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, search: Search = SIMILAR_320, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, unchanged, of each group of :func:`similar_documents`: the one that it calls kept.

    A text that shares its id with another is judged by itself. Of rows that repeat id and text one stays. Rows with a
    null id all stay. An empty table gives an empty result; columns of any name stay as they are.
    """
    found = similar_documents(docs, similarity, search, id_col, text_col)
    doc, text_hash, own = (fresh(docs, n) for n in ("_doc", "_text_hash", "_own"))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash))
    keyed = docs.withColumn(doc, F.col(id_col).cast("long")).withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    keyed = keyed.withColumn(own, F.when(F.col(doc).isNull(), F.monotonically_increasing_id()))
    # joined and deduplicated by the same keys: the texts move once
    return keyed.join(gone.hint("merge"), [doc, text_hash], "left_anti").dropDuplicates([doc, text_hash, own]).select(*docs.columns)
