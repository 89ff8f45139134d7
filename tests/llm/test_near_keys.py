from dataclasses import replace

import numpy as np
import pytest
from test_near_dedup import closure

from scriptloom.llm import simhash as s


def edited(rng, base, edits):
    text = list(base)
    for at in rng.integers(0, len(text), edits):
        text[at] = f"v{rng.integers(0, 10**6)}"
    return " ".join(text)


def families(seed, sizes, edits=2, length=140):
    rng, docs = np.random.default_rng(seed), []
    for size in sizes:
        base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        docs += [edited(rng, base, edits) for _ in range(size)]
    return [docs[i] for i in rng.permutation(len(docs))]


def brute(docs):
    sets = [s.shingle_hashes(t, 5, True) for t in docs]
    n = range(len(docs))
    return closure(n, [(a, b) for a in n for b in range(a) if s.jaccard(sets[a], sets[b]) >= 0.8])


def test_unrelated_rows_meet_nowhere(spark, monkeypatch):
    """The work of a row doesn't grow with the other rows: what shares no key is in no tree and compared with nothing."""
    routed, met = [], []
    routed_, keys_ = s._routed, s.shared_keys
    monkeypatch.setattr(s, "_routed", lambda reps, search: routed.append(reps.count()) or routed_(reps, search))
    monkeypatch.setattr(s, "shared_keys", lambda reps: met.append(keys_(reps).select("rep").distinct().count()) or keys_(reps), raising=False)
    docs = families(1, [1] * 400 + [3] * 5)
    got = {r.doc_id: r.component_id for r in s.similar_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert {i: got.get(i, i) for i in range(len(docs))} == brute(docs)
    assert sum(routed) == 0 and met == [15]


@pytest.mark.parametrize(("most", "bands"), [(6, 20), (s.GROUP_ROWS, 20), (s.GROUP_ROWS, 0)])
def test_components_whether_rows_meet_by_key_or_in_trees(spark, monkeypatch, most, bands):
    """Families, bridges between members, a family of near misses, short texts: as by brute force, however many share a key."""
    monkeypatch.setattr(s, "GROUP_ROWS", most)
    docs = families(2, [1] * 50 + [4] * 20 + [60]) + families(3, [3] * 20, edits=3) + families(4, [4] * 5, edits=1, length=6)
    docs += ["one", "two words", "", " \n"]
    sets = [s.shingle_hashes(t, 5, True) for t in docs]
    expected = brute(docs)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.similar_documents(df, search=replace(s.SIMILAR_320, bands=bands)).collect()}
    fps = np.array([s.fingerprint(x, 5) for x in sets])
    near = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(5)) <= s.SIMILAR_320.max_bits
    n = range(len(docs))
    found = closure(n, [(a, b) for a in n for b in range(a) if near[a, b] and s.jaccard(sets[a], sets[b]) >= 0.8])
    assert {i: got.get(i, i) for i in n} == found
    assert sum(found[i] != expected[i] for i in n) <= 2  # texts of six words have two shingles, and fingerprints of little use


def test_pairs_of_groups_by_brute_force(spark):
    """Each row's nearest in each of its groups; all possible pairs of different labels, once."""
    search, rng = s.SIMILAR_320, np.random.default_rng(5)
    centres = rng.integers(0, 2**63, (12, 5)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    fps = np.repeat(centres, 8, axis=0)
    for row in fps:
        for _ in range(rng.integers(0, 60)):
            row[rng.integers(0, 5)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    n, size = len(fps), rng.integers(80, 120, len(fps))
    odd = np.repeat(rng.integers(0, 2**63, (12, 8)).astype(np.uint64) * np.uint64(2), 8, axis=0)
    for row in odd:
        for _ in range(rng.integers(0, 30)):
            row[rng.integers(0, 8)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    label = rng.integers(0, 3, n)
    groups = [(int(k), i) for i in range(n) for k in {i // 8, 100 + rng.integers(0, 10)}]
    rows = [(i + 7, bytearray(f), int(size[i]), bytearray(o), int(label[i])) for i, (f, o) in enumerate(zip(s._pack(fps), s._pack(odd)))]
    reps = spark.createDataFrame(rows, "rep long, fp binary, n long, parity binary, label long")
    keys = spark.createDataFrame([(k, i + 7) for k, i in groups], "key long, rep long")
    d = sum(np.bitwise_count(fps[:, None, k] ^ fps[None, :, k]).astype(int) for k in range(5))
    met = {(k, a, b) for k, a in groups for j, b in groups if k == j and a > b and d[a, b] <= search.max_bits}
    nearest = {}
    for k, a, b in met:
        nearest[k, a] = min(nearest.get((k, a), (999, 0)), (d[a, b], b))
    got = {(r.a - 7, r.b - 7) for r in s.nearest_with_key(keys, reps, search).collect()}
    assert got == {(a, b) for (k, a), (_, b) in nearest.items()} and len(got) > 40
    pairs = sorted({(a, b) for _, a, b in met})
    i, j = np.array(pairs).T
    ok = s.can_be_similar(size, odd, i, j, 0.8) & (label[i] != label[j])
    got = sorted((r.a - 7, r.b - 7) for r in s.separate_with_key(keys, reps, search, 0.8).collect())
    assert got == [p for p, x in zip(pairs, ok) if x] and 20 < len(got) < len(pairs)


def test_min_hash_keys(monkeypatch):
    """Keys agree as often as similarities say; they don't depend on how many shingles are hashed at once."""
    rng, hits = np.random.default_rng(6), 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 180).astype(np.uint64)
        y = np.concatenate([x[:160], rng.integers(0, 2**63, 20).astype(np.uint64)])  # 160 of 200
        a, b = s.min_hash_keys(x, 20, 4), s.min_hash_keys(y, 20, 4)
        assert (a == b).any()
        hits += (a == b).sum()
    assert abs(hits / 6000 - 0.8**4) < 0.03
    whole = s.min_hash_keys(x, 20, 4)
    assert len(np.unique(whole)) == 20 and not np.isin(whole, s.min_hash_keys(x[::-1] + np.uint64(1), 20, 4)).any()
    monkeypatch.setattr(s, "MIN_ROWS", 7)
    assert (s.min_hash_keys(x, 20, 4) == whole).all() and (s.min_hash_keys(x[::-1], 20, 4) == whole).all()
    assert len(s.min_hash_keys(x[:0], 20, 4)) == 0


def test_work_in_a_family_grows_with_its_rows(spark, monkeypatch):
    """A family of four times the rows, near misses among them, makes about four times the pairs; its components are those of brute force."""
    made, met_ = [], s._met

    def counted(*args):
        pairs = met_(*args)
        made[-1] += pairs.count()
        return pairs

    monkeypatch.setattr(s, "_met", counted)
    monkeypatch.setattr(s, "TILES", 4)
    for size in (75, 300):
        rng = np.random.default_rng(7)
        base = [f"w{x}" for x in rng.integers(0, 10**6, 140)]
        docs = [edited(rng, base, 7 if i % 4 == 0 else 1) for i in range(size)]
        made.append(0)
        got = {r.doc_id: r.component_id for r in s.similar_documents(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    expected = brute(docs)
    assert {i: got.get(i, i) for i in range(size)} == expected and 20 < len(set(expected.values())) < 150
    assert made[1] < 8 * max(made[0], 1000)


def test_neighbours_by_brute_force(spark, monkeypatch):
    """Rows at most so many places apart in their key's order, no others; pairs that can't be similar are left out."""
    monkeypatch.setattr(s, "NEIGHBOURS", 2)
    search, docs = s.SIMILAR_320, families(8, [40]) + families(9, [30], edits=3) + ["one", ""]
    sets = [s.shingle_hashes(t, 5, True) for t in docs]
    fps, odd = np.array([s.fingerprint(x, 5) for x in sets]), np.array([s.parity(x, 512) for x in sets])
    keys = [s.min_hash_keys(x, 20, 4).view(np.int64).tolist() for x in sets]
    rows = [(i, bytearray(f), len(x), bytearray(o), k) for i, (f, x, o, k) in enumerate(zip(s._pack(fps), sets, s._pack(odd), keys))]
    reps = spark.createDataFrame(rows, "rep long, fp binary, n long, parity binary, keys array<long>")
    got = {(r.a, r.b) for r in s.neighbours_with_key(s.shared_keys(reps).select("key", "rep", "next"), reps, search, 0.8).collect()}
    groups = {}
    for i, k in enumerate(keys):
        for at, key in enumerate(k):
            groups.setdefault(key, []).append((k[(at + 1) % 20], i))
    pairs = {(max(a, b), min(a, b)) for g in map(sorted, groups.values()) for at, (_, a) in enumerate(g) for _, b in g[max(0, at - 2) : at]}
    a, b = np.array(sorted(pairs)).T
    near = sum(np.bitwise_count(fps[a, k] ^ fps[b, k]).astype(int) for k in range(5)) <= search.max_bits
    ok = near & s.can_be_similar(np.array([len(x) for x in sets]), odd, a, b, 0.8)
    assert got == set(zip(a[ok].tolist(), b[ok].tolist())) and 20 < len(got) < len(pairs)


def test_no_similar_pair_is_lost(spark):
    """Two texts at exactly 0.8 whose fingerprints are 85 bits apart, and one that shares nothing."""
    words = [f"a12416x{k}" for k in range(9)]
    x, y = (s.shingle_hashes(" ".join(w), 5, True) for w in (words, words[:8]))
    assert s.jaccard(x, y) == 0.8 and np.bitwise_count(s.fingerprint(x, 5) ^ s.fingerprint(y, 5)).sum() > s.SIMILAR_320.max_bits
    docs = [(5, " ".join(words)), (7, " ".join(words[:8])), (9, "quite another text")]
    got = s.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5), (7, 5)]


@pytest.mark.parametrize(("bands", "tile", "shingles"), [(0, 7, 1 << 16), (20, 1 << 13, 3)])
def test_prefixes_find_all_that_brute_force_does(spark, monkeypatch, bands, tile, shingles):
    """Whatever order the sample gives, however the rows of a shingle are dealt, with and without keys: no wrong component."""
    monkeypatch.setattr(s, "PREFIX_ROWS", tile)
    monkeypatch.setattr(s, "ORDER_SHINGLES", shingles)
    rng, common = np.random.default_rng(11), " ".join(f"c{k}" for k in range(40))
    docs = families(10, [1] * 30 + [4] * 15) + families(12, [30], edits=6) + families(13, [5] * 8, edits=1, length=14)
    docs += [f"{common} {t}" for t in families(14, [1] * 20 + [3] * 10, edits=2, length=60)]
    docs += [" ".join(f"k{n}w{k}" for k in range(m)) for n in range(20) for m in (8, 9)]
    docs = [docs[i] for i in rng.permutation(len(docs))]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in s.similar_documents(df, search=replace(s.SIMILAR_320, bands=bands)).collect()}
    expected = brute(docs)
    assert {i: got.get(i, i) for i in range(len(docs))} == expected and len(set(expected.values())) < len(docs) - 20
