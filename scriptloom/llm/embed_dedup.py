"""Near-duplicate vectors: an exact metric range join on the unit sphere.

Two unit vectors have cosine ``c`` at distance ``sqrt(2 - 2c)``, so cosine >= 0.9 is a range join of radius 0.447. Pivots
from a bounded sample partition the vectors: each goes to the cell of its nearest pivot. A partner within the radius can
lie in another cell only if the triangle inequality allows it. With ``a`` and ``b`` the distances of x to its own pivot p
and to another pivot q, every point that is nearer to q lies beyond the plane halfway between p and q, and x is
``(b*b - a*a) / (2 * |pq|)`` away from that; and the cell of q reaches no farther than its radius ``R``, so ``b - R`` is a bound
as well. Where neither exceeds the radius, x is copied to the cell of q, for q after p only: each pair meets once. Cells
join independently, by blocks of a matrix product in single precision, and whatever comes near the threshold is decided in
double precision.

A cell is joined in blocks: its own vectors, and those copied to it, are dealt into blocks of bounded size, and each pair of
blocks is a task of its own, so neither a dense cell nor the many copies of an unselective one fill a worker's memory. A
task returns its link counts and links to the roots of its sets, never pairs. Equal vectors are collapsed beforehand, so
a group of exact copies is one row with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import bounded_batches, materialise
from .simhash import _Links

#: Vectors of the sample that pivots are chosen from, pivots at most, and vectors in a cell, about.
SAMPLE_ROWS = 8192
MAX_PIVOTS = 1024
CELL_ROWS = 4096
#: Bytes of a cell's own vectors, and of those copied to it, that a task gets, about.
OWN_BYTES = 4 << 20
COPIED_BYTES = 16 << 20
#: Vectors of a block at least, however long they are.
LEAST_ROWS = 64
#: Rounding of distances, allowed for in bounds.
EPS = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; first by their largest component, so that nothing overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def slack(dim: int) -> float:
    """By how much a cosine of unit vectors in single precision can be off: the rounding of both vectors and of ``dim``
    products and sums, each at most 2**-24. Values so near to the threshold are computed again in double precision."""
    return (2 * dim + 16) * 2.0**-24


def _matrix(column: pa.ChunkedArray | pa.Array, dtype: str = "<f8") -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1) if raw else np.empty((0, 1))


def _usable(values: list | None) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    row = np.array(values, np.float64)
    return row if np.isfinite(row).all() and row.any() else None


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, dim, unit``: the unit vector as bytes of doubles; null where a vector links with nothing."""
    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_usable(v.as_py()) for v in batch.column(1)]
            found = [None if r is None else unit(r[None, :]).astype("<f8").tobytes() for r in rows]
            dims = [None if r is None else len(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(found, pa.binary())], ["vec_id", "dim", "unit"])

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return source.mapInArrow(run, "vec_id long, dim int, unit binary")


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first traversal: each pivot is the sample point farthest from those before it."""
    chosen = [0]
    near = np.full(len(sample), np.inf)
    while len(chosen) < min(k, len(sample)):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        nxt = int(near.argmax())
        if near[nxt] <= EPS:
            break
        chosen.append(nxt)
    return sample[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * rows @ pivots.T))


def join_blocks(units: np.ndarray, copies: np.ndarray, first: np.ndarray, alone: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link counts of the rows of a task (each link weighted with the partner's copies), and links to set roots.

    The rows of the ``first`` block are compared with the others or, where the block is ``alone``, with each other.
    """
    small = units.astype(np.float32)
    links, counts, h = _Links(np.ones(len(units), bool), False), np.zeros(len(units), np.int64), np.flatnonzero(first)
    rows = h if alone else np.flatnonzero(~first)
    step = max(1, (1 << 22) // max(1, len(h)))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        others = h[at:] if alone else h
        i, j = np.nonzero(small[part] @ small[others].T >= threshold - slack(units.shape[1]))
        i, j = part[i], others[j]
        if alone:
            once = i < j
            i, j = i[once], j[once]
        sure = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            sure[k : k + (1 << 16)] = (units[i[k : k + (1 << 16)]] * units[j[k : k + (1 << 16)]]).sum(axis=1) >= threshold
        i, j = i[sure], j[sure]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        links.add(i, j, np.zeros(len(i)))
    return (counts, *links.pairs())


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector: ``vec_id long, n_links long, component_id long, kept boolean``.

    Vectors of the same dimension link at a cosine of ``threshold`` or more in double precision. ``n_links`` counts the other
    rows whose vectors are linked directly, exact copies included; ``component_id`` is the smallest id reachable. Vectors that
    are null, empty or zero, or hold null or non-finite components, link with nothing and are their own component. Rows that
    repeat an id are vectors of their own and one node of the graph: what is linked to one of them is reachable from all, and
    they count as linked only where their vectors are. Rows with a null id are left out of the links and returned each, with
    no links and, as nothing can name them, null for component and ``kept``. An empty table gives an empty result. Other
    columns are ignored. Ids are numbers or numeric texts.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    units = materialise(unit_vectors(vectors, id_col, vector_col), "units")
    usable = units.where("vec_id is not null and unit is not null")
    reps = usable.groupBy("unit").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    reps = reps.withColumn("dim", (F.length("unit") / 8).cast("int"))
    counted, links = None, None
    for (dim, n) in [(r["dim"], r["n"]) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()]:
        cells = _cells(reps.where(F.col("dim") == dim), n, threshold)
        c, e = cells.where("root is null").select("rep", "links"), cells.where("root is not null").select("rep", "root")
        counted, links = (c, e) if counted is None else (counted.unionByName(c), links.unionByName(e))
    nothing = F.lit(0).cast("long").alias("n_links")
    single = units.where("vec_id is null or unit is null").select("vec_id", nothing, F.col("vec_id").alias("component_id"))
    if counted is None:
        return single.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    rows = materialise(usable.join(reps.select("unit", "rep"), "unit").select("vec_id", "rep"), "rows")
    # ids that stand at more than one vector join them
    shared = rows.groupBy("vec_id").agg(F.min("rep").alias("root"), F.max("rep").alias("last")).where("root < last")
    shared = rows.join(shared, "vec_id").where("rep > root").select("rep", "root")
    merged = components(links.unionByName(shared), "rep", "root")
    sums = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    found = reps.select("rep", "low", "copies").join(sums, "rep", "left").join(merged, F.col("rep") == F.col("node"), "left").drop("node")
    found = found.withColumn("component", F.coalesce("component", "rep"))
    lows = found.groupBy("component").agg(F.min("low").alias("component_id"))
    found = found.join(lows, "component").select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(found, "rep").select("vec_id", "n_links", "component_id")
    return linked.unionByName(single).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _cells(reps: DataFrame, n: int, threshold: float) -> DataFrame:
    """``rep, links, root``: partial link counts (root null) and links to set roots."""
    radius = float(np.sqrt(2 - 2 * threshold)) + EPS
    k = int(min(MAX_PIVOTS, max(1, -(-n // CELL_ROWS))))
    sample = reps.select("unit").orderBy(F.xxhash64("unit")).limit(SAMPLE_ROWS).collect()
    pivots = choose_pivots(np.frombuffer(b"".join(bytes(r["unit"]) for r in sample), "<f8").reshape(len(sample), -1), k)
    row_bytes = 8 * pivots.shape[1]
    own_rows, copied_rows = max(LEAST_ROWS, OWN_BYTES // row_bytes), max(LEAST_ROWS, COPIED_BYTES // row_bytes)
    apart = distances(pivots, pivots)
    np.fill_diagonal(apart, np.inf)

    def targets(d: np.ndarray, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's own cell, and which cells after it may hold a partner."""
        own = d.argmin(axis=1)
        a = d[np.arange(len(d)), own]
        near = ((d * d - (a * a)[:, None]) / (2 * apart[own]) <= radius) & (np.arange(len(pivots))[None, :] > own[:, None])
        return own, near if reach is None else near & (d - reach[None, :] <= radius)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, mine, copied = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column(0)), pivots)
                own, near = targets(d)
                np.maximum.at(far, own, d.min(axis=1))
                mine += np.bincount(own, minlength=len(pivots))
                copied += near.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(far), dtype=np.int32)), pa.array(far), pa.array(mine), pa.array(copied)], ["cell", "far", "mine", "copied"])

    reach, own_blocks, copied_blocks = np.zeros(len(pivots)), np.ones(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    sizes = reps.select("unit").mapInArrow(survey, "cell int, far double, mine long, copied long")
    for r in sizes.groupBy("cell").agg(F.max("far").alias("far"), F.sum("mine").alias("mine"), F.sum("copied").alias("copied")).collect():
        reach[r["cell"]] = r["far"]
        own_blocks[r["cell"]], copied_blocks[r["cell"]] = max(1, -(-r["mine"] // own_rows)), -(-r["copied"] // copied_rows)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, near = targets(distances(_matrix(batch.column(2)), pivots), reach)
            rep = batch.column(0).to_numpy()
            mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            out: list[tuple[np.ndarray, ...]] = []  # rows, cells, blocks of either side, whether of the first
            block = (mixed % own_blocks[own].astype(np.uint64)).astype(np.int64)
            every = np.arange(len(rep))
            for k in range(int(own_blocks[own].max())):
                there = every[own_blocks[own] > k]
                b = block[there]
                out.append((there, own[there], np.minimum(b, k), np.maximum(b, k), b <= k))
            for k in range(int(copied_blocks[own].max())):
                there = every[copied_blocks[own] > k]
                out.append((there, own[there], block[there], own_blocks[own[there]] + k, np.ones(len(there), bool)))
            row, cell = np.nonzero(near)
            v = own_blocks[cell] + (mixed[row] % np.maximum(copied_blocks[cell], 1).astype(np.uint64)).astype(np.int64)
            for k in range(int(own_blocks[cell].max()) if len(cell) else 0):
                there = own_blocks[cell] > k
                out.append((row[there], cell[there], np.full(there.sum(), k), v[there], np.zeros(there.sum(), bool)))
            row, cell, i, j, first = (np.concatenate(x) for x in zip(*out, strict=True))
            at = pa.array(row)
            for s in range(0, len(row), 4096):
                e = s + 4096
                keys = [pa.array(x[s:e].astype(np.int32)) for x in (cell, i, j)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(first[s:e]), *[batch.column(c).take(at[s:e]) for c in range(3)]], ["cell", "i", "j", "first", "rep", "copies", "unit"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, first = table["rep"].to_numpy(), table["first"].to_numpy(zero_copy_only=False)
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        counts, a, b = join_blocks(_matrix(table["unit"]), table["copies"].to_numpy(), first, alone, threshold)
        some = np.flatnonzero(counts)
        return pa.table({
            "rep": pa.array(np.concatenate([rep[some], rep[a]]), pa.int64()),
            "links": pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)]), pa.int64()),
            "root": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rep[b], pa.int64())]),
        })

    routed = reps.select("rep", "copies", "unit").mapInArrow(route, "cell int, i int, j int, first boolean, rep long, copies long, unit binary")
    return materialise(routed.groupBy("cell", "i", "j").applyInArrow(join, "rep long, links long, root long"), "cells")
