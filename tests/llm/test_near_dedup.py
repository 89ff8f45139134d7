from dataclasses import replace

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptloom.llm import simhash as s


def plain_fingerprint(text):
    """Word by word, hash by hash, bit by bit."""
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


BASE = [f"word{i} other{i * 7 % 31} more{i * 3 % 17}" for i in range(120)]
TEXTS = [
    (1, "A b  C\td"), (2, "a B c D"), (3, None), (4, ""), (5, " \n"), (6, "one"), (7, "One"), (8, "é à ü"), (9, "É à ü"),
    (10, " ".join(BASE)), (11, " ".join(BASE[:-1])), (12, " ".join(BASE) + " tail"), (13, "x " * 5000), (14, "x " * 5001), (14, "again"), (2, "a B c D"), (None, "a b c d"),
]


def test_fingerprints_and_components(spark):
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in TEXTS], "doc_id long, text string, fp int, component_id string")
    got = s.near_duplicates(df).collect()
    assert len(got) == len(TEXTS)
    fps = [(i, plain_fingerprint(t)) for i, t in TEXTS]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in fps)
    named = [(i, f) for i, f in fps if i]
    # an id is one node, whatever the number of its texts
    expected = closure({i for i, _ in named}, [(a, b) for a, f in named for b, g in named if (f ^ g).bit_count() <= 3 and a != b])
    assert expected[14] == 13
    assert all(r.component_id == expected.get(r.doc_id) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_duplicates(df).count() == 0
    assert s.drop_near_duplicates(df).count() == 0


@pytest.mark.parametrize("task_rows", [s.TASK_ROWS, 60])
@pytest.mark.parametrize("search", [s.EXACT_64, s.Search(max_bits=7, blocks=4, radius=1), s.Search(n64=2, max_bits=7, blocks=4, radius=1)])
def test_trees_find_every_pair(spark, monkeypatch, search, task_rows):
    """Deep trees over clustered fingerprints: the links join exactly what brute force joins."""
    search = replace(search, shard_rows=64, task_rows=task_rows)
    monkeypatch.setattr(s, "LEAF_ROWS", 16)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, (150, search.n64)).astype(np.uint64)
    rows = [centres]
    for _ in range(6):
        flips = centres.copy()
        for _ in range(rng.integers(1, 5)):
            flips[np.arange(len(flips)), rng.integers(0, search.n64, len(flips))] ^= np.uint64(1) << rng.integers(0, 64, len(flips)).astype(np.uint64)
        rows.append(flips)
    fps = np.unique(np.concatenate(rows), axis=0)
    order = rng.permutation(len(fps))
    fps = fps[order]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(s._pack(fps))], "rep long, fp binary")
    found = [(r.a, r.b) for r in s.candidate_links(df, search).collect()]
    d = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(search.n64))
    a, b = np.nonzero(np.triu(d <= search.max_bits, 1))
    assert all(d[x, y] <= 10 * search.max_bits for x, y in found)
    assert closure(range(len(fps)), found) == closure(range(len(fps)), zip(a.tolist(), b.tolist(), strict=True))
    assert task_rows == 60 or len(found) <= len(fps) * search.blocks


def test_similar_documents_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(3000)]
    docs, n = [], 0
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(30, 200)))
        for edits in (0, 0, 1, 2, 4, 8, 16):
            text = list(base)
            for at in rng.integers(0, len(text), edits):
                text[at] = str(rng.choice(words))
            docs.append((n, " ".join(text)))
            n += 1
    docs += [(n, ""), (n + 1, None), (None, docs[0][1])]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, a string")
    sets = {i: set(s.shingle_hashes(t, 5, True).tolist()) for i, t in docs if i is not None}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    ids = sorted(sets)
    expected = closure(ids, [(a, b) for a in ids for b in ids if b < a and sim(a, b) >= 0.8])
    got = {r.doc_id: r.component_id for r in s.similar_documents(df).collect()}
    # fingerprints are a sketch: a pair just above 0.8 may be missed, but nothing below it is ever linked
    found = {i: got.get(i, i) for i in ids}
    assert sum(found[i] != expected[i] for i in ids) <= 1
    assert all(expected[i] == expected[found[i]] for i in ids)
    clear = closure(ids, [(a, b) for a in ids for b in ids if b < a and sim(a, b) >= 0.85])
    assert all(found[i] == found[clear[i]] for i in ids)
    kept = s.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1] + sorted(i for i in ids if found[i] == i)


def test_chunked_counts_are_exact(monkeypatch):
    h = s.shingle_hashes("a b c d e f g h " * 50, 3)
    whole = s.fingerprint(h, 4)
    monkeypatch.setattr(s, "COUNT_ROWS", 7)
    assert (s.fingerprint(h, 4) == whole).all()


def test_components_of_a_long_chain(spark):
    from scriptloom.llm._graph import components

    links = [(i, i + 1) for i in range(0, 120)] + [(500, 501), (7, 7), (None, 3), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(121)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").select(F.count("*")).first()[0] == 0


def near_pairs(fps, search):
    """All pairs that the search should find, higher row first, and all distances, by brute force."""
    d = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(search.n64))
    blocks = [s._block(fps, k, search.block_bits) for k in range(search.blocks)]
    met = np.any([np.bitwise_count(b[:, None] ^ b[None, :]) <= search.radius for b in blocks], axis=0)
    return np.argwhere(np.tril(met & (d <= search.max_bits), -1)).tolist(), d


@pytest.mark.parametrize("task_rows", [s.TASK_ROWS, 100])
def test_nearest_and_separate_pairs_over_shards(spark, monkeypatch, task_rows):
    """Every row finds its nearest smaller partner, or a close one, in whichever shard they meet; all pairs come once."""
    search = replace(s.SIMILAR_320, shard_rows=64, task_rows=task_rows)
    monkeypatch.setattr(s, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (80, 5)).astype(np.uint64)
    rows = [centres]
    for _ in range(8):
        flips = centres.copy()
        for _ in range(rng.integers(4, 45)):
            flips[np.arange(80), rng.integers(0, 5, 80)] ^= np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64)
        rows.append(flips)
    fps = rng.permutation(np.unique(np.concatenate(rows), axis=0))
    df = spark.createDataFrame([(i, bytearray(p), i % 3) for i, p in enumerate(s._pack(fps))], "rep long, fp binary, label long")
    pairs, d = near_pairs(fps, search)
    nearest = {}
    for a, b in pairs:
        nearest[a] = min(nearest.get(a, 999), d[a, b])
    found = {}
    for r in s.candidate_links(df, search, nearest=True).collect():
        found[r.a] = min(found.get(r.a, 999), d[r.a, r.b])
    assert found.keys() == nearest.keys()
    assert all(found[a] == x or found[a] <= search.close_bits for a, x in nearest.items())
    got = [[r.a, r.b] for r in s.separate_pairs(df, search).collect()]
    assert sorted(got) == [p for p in pairs if p[0] % 3 != p[1] % 3]


def test_a_visitor_near_enough_to_a_partner_is_still_found(monkeypatch):
    """Visitors meet the home rows above them as questions only: each home row gets its nearest, or a close one."""
    monkeypatch.setattr(s, "LEAF_ROWS", 16)
    rng = np.random.default_rng(4)
    fps = np.repeat(rng.integers(0, 2**63, (20, 5)).astype(np.uint64), 40, axis=0)
    for row in fps:
        for _ in range(rng.integers(0, 25)):
            row[rng.integers(1, 5)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        for _ in range(rng.integers(0, 3)):
            row[0] ^= np.uint64(1) << np.uint64(rng.integers(0, 16))
    fps = rng.permutation(fps)
    home, values = rng.random(len(fps)) < 0.5, s._block(fps, 0, 16)
    d = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(5))
    met = (np.bitwise_count(values[:, None] ^ values[None, :]) <= 1) & (d <= 84) & (home[:, None] | home[None, :])
    nearest = np.where(np.tril(met, -1), d, 999).min(1)
    found = np.full(len(fps), 999)
    a, b = s.link_shard(fps, values, home, s.SIMILAR_320, True)
    found[a] = d[a, b]
    assert met[a, b].all() and (b < a).all()
    assert ((found == nearest) | (found <= s.SIMILAR_320.close_bits)).all()


def test_bridges_and_a_family_of_near_misses(spark):
    """No candidate is dropped for a nearer one that fails or is another link: components are those of all candidates."""
    rng = np.random.default_rng(5)
    docs = []
    for size, edits in [(3, 3)] * 60 + [(120, 3)]:
        base = [f"w{x}" for x in rng.integers(0, 10**6, 140)]
        for _ in range(size):
            text = list(base)
            for at in rng.integers(0, len(text), edits):
                text[at] = f"v{rng.integers(0, 10**6)}"
            docs.append(" ".join(text))
    docs = [docs[i] for i in rng.permutation(len(docs))]
    sets = [s.shingle_hashes(t, 5, True) for t in docs]
    pairs, _ = near_pairs(np.array([s.fingerprint(x, 5) for x in sets]), s.SIMILAR_320)
    expected = closure(range(len(docs)), [(a, b) for a, b in pairs if s.jaccard(sets[a], sets[b]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.similar_documents(df).collect()}
    assert {i: got.get(i, i) for i in expected} == expected


def test_fingerprints_that_share_a_block_are_dealt_to_tiles(spark):
    """No tree can split one block value; tiles can, and nothing is lost."""
    rng = np.random.default_rng(6)
    low = np.uint64(rng.integers(0, 2**32))
    high = rng.integers(0, 2**32, 60).astype(np.uint64)
    high = np.unique(np.concatenate([high, high ^ np.uint64(1), high ^ np.uint64(6)]))
    fps = rng.permutation((high << np.uint64(32)) | low)[:, None]
    search = replace(s.EXACT_64, shard_rows=16, task_rows=40)
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(s._pack(fps))], "rep long, fp binary")
    sizes = s._routed(df, search).groupBy("block", "shard", "i", "j").count().collect()
    assert len({(r["i"], r["j"]) for r in sizes if r["block"] == 0}) > 5 and max(r["count"] for r in sizes) <= 80
    found = [(r.a, r.b) for r in s.candidate_links(df, search).collect()]
    d = np.bitwise_count(fps ^ fps.T)
    assert closure(range(len(fps)), found) == closure(range(len(fps)), np.argwhere(np.triu(d <= 3, 1)).tolist())


def test_a_text_under_a_repeated_id_is_judged_by_itself(spark):
    near = " ".join(f"w{i}" for i in range(100))
    rows = [(1, near, 5), (2, near + " x", 6), (2, "some words that nobody else has used so far", 7), (2, near + " x", 8), (3, near + " y", 9), (None, near, 1), (None, near, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = s.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text_hash) for r in got.collect()) == [(0, 1), (0, 2), (1, 5), (2, 7)]


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 9973}" for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of a few words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in s.drop_near_duplicates(df).collect()) == [1, 3]


def test_parity_bounds_lose_no_pair():
    """Pairs of sets around the threshold: what is ruled out is below it, and most of what is far below is ruled out."""
    rng = np.random.default_rng(7)
    sets, pairs = [], []
    for size in (1, 4, 5, 9, 60, 500, 4000):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.111, 0.12, 0.2, 0.5):
            for keep in (1.0, 0.8, 0.9):
                x = np.unique(np.concatenate([base[: int(size * keep)], rng.integers(0, 2**63, int(size * share)).astype(np.uint64)]))
                sets.append(x)
    sets.append(np.zeros(0, np.uint64))
    n, bitmaps = np.array([len(x) for x in sets]), np.array([s.parity(x, 512) for x in sets])
    i, j = np.triu_indices(len(sets), 1)
    ok = s.can_be_similar(n, bitmaps, i, j, 0.8)
    real = np.array([s.jaccard(sets[a], sets[b]) for a, b in zip(i, j)])
    assert ok[real >= 0.8].all() and (real >= 0.8).sum() > 50
    assert ok[(real < 0.6) & (n[i] > 50) & (n[i] < 600)].mean() < 0.05


def test_recall_at_the_threshold(spark):
    """Documents at a similarity just above 0.8 to their original alone: found, but for the chance that the search states."""
    rng = np.random.default_rng(8)
    docs, expected = [], 0
    for k in range(150):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 150)]
        other = list(base)
        for at in (20, 55, 90):  # three edits of five shingles each: (146 - 15) / (146 + 15) = 0.81
            other[at] = f"v{rng.integers(0, 10**6)}"
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        a, b = (s.shingle_hashes(t, 5, True) for _, t in docs[-2:])
        assert 0.8 <= s.jaccard(a, b) < 0.82
        expected += 1
    kept = {r.doc_id for r in s.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(2 * k in kept for k in range(150)) and sum(2 * k + 1 not in kept for k in range(150)) >= expected - 2
