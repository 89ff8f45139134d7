import numpy as np
import pytest

from scriptloom.llm import embed_dedup as d


def brute(rows, threshold):
    """For each row with an id: links, component and whether it is kept; an id is one node."""
    rows = [(i, v) for i, v in rows if i is not None]
    ok = [bool(v) and None not in v and np.isfinite(np.array(v, float)).all() and bool(np.any(np.array(v, float))) for _, v in rows]
    at = [np.array(v, float) if good else None for good, (_, v) in zip(ok, rows, strict=True)]
    near = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    links = [[y for y in range(len(rows)) if y != x and ok[y] and near(at[x], at[y])] if ok[x] else [] for x in range(len(rows))]
    out = []
    for x, (i, _) in enumerate(rows):
        seen, todo = {i}, [i] if ok[x] else []
        while todo:
            node = todo.pop()
            for y in range(len(rows)):
                if rows[y][0] == node and ok[y]:
                    new = {rows[z][0] for z in links[y]} - seen
                    seen |= new
                    todo += new
        out.append((i, len(links[x]), min(seen), min(seen) == i))
    return sorted(out)


def vectors(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = [c + rng.normal(size=dim) * s for c in centres for s in (0, 0, 0.05, 0.1, 0.2, 0.3, 0.4, 2.0)]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    n = len(out)
    hard = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1e-30] * dim, [1e30] * dim, [1.0, 0.0], [0.95, 0.01]]
    return out + [(n + k, v) for k, v in enumerate(hard)] + [(None, [1.0] * dim), (5, out[5][1]), (5, out[200][1]), (17, None), (17, [-x for x in out[17][1]])]


@pytest.mark.parametrize("cell", [24, 100_000])
@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_range_join(spark, monkeypatch, cell, threshold):
    monkeypatch.setattr(d, "CELL_ROWS", cell)
    if cell < 100:
        monkeypatch.setattr(d, "OWN_BYTES", 10 * 8 * 16)
        monkeypatch.setattr(d, "COPIED_BYTES", 16 * 8 * 16)
        monkeypatch.setattr(d, "LEAST_ROWS", 1)
    rows = vectors()
    df = spark.createDataFrame([(i, v, 3, True) for i, v in rows], "vec_id long, embedding array<float>, label int, kept boolean").repartition(5)
    got = d.near_vectors(df, threshold).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == brute(rows, threshold)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, None)]


def test_an_id_with_two_vectors_joins_them(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in d.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_large_group_of_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000, [1.0, 2.0, 3.01]), (1001, [-1.0, 0.0, 0.0])]
    got = {r.vec_id: tuple(r)[1:] for r in d.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1001] == (0, 1001, True) and all(got[i] == (500, 0, i == 0) for i in [*range(500), 1000])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert d.near_vectors(df).count() == 0
    assert d.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1
    with pytest.raises(ValueError):
        d.near_vectors(df, 0.0)
