import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from scriptloom.llm import manifest as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    i, source, lang, n, text = row
    n = n + add if n is not None else None
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def tree(leaves):
    """The root, and for each leaf its siblings: (digest or None, whether it is on the right)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            s = i ^ 1
            path.append((level[s] if s < len(level) else None, s > i))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in ordered[x]]) for x in langs}
    root, last = tree([trees[x][0] for x in langs]) if langs else ("", [])
    out = Counter()
    for x, up in zip(langs, last):
        for r, path in zip(ordered[x], trees[x][1]):
            add = int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            node = leaf(r, add)
            for s, right in path + up:
                node = h(node) if s is None else h(node, s) if right else h(s, node)
            out[r[0], leaf(r), trees[x][0], root, h(*(s for s, _ in path + up if s)), node, node == root] += 1
    return out


HARD = [(1, "a", None, 3, "x"), (2, None, None, None, None), (None, "s", "", 0, ""), (7, "s", "é", 5, "ü" * 70_000), (7, "s", "é", 5, "other"), (7, "s", "é", 5, "other"), (-4, "s", "é", 1, "neg"), (9, "1:a", "z", 2, "-")]


@pytest.mark.parametrize("rows", [
    HARD, [], [(5, "s", "en", 1, "one")],
    [(k, "s", f"l{k % 3}" if k % 5 else None, k, f"text {k}") for k in range(300)],
    [(k % 40, "s", "hot" if k % 3 else f"l{k}", k if k % 4 else None, f"t{k % 9}") for k in range(260)],
])
@pytest.mark.parametrize("bits", [2, 8])
def test_like_plain_trees(spark, monkeypatch, rows, bits):
    monkeypatch.setattr(m, "BLOCK_BITS", bits)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, tree string").repartition(5)
    got = Counter(map(tuple, m.manifest(df).collect()))
    assert got == brute(rows)


def test_tampering_is_found(spark):
    df = spark.createDataFrame([(k, "s", "en", 1, "t") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    got = {r.doc_id: r.verified for r in m.manifest(df).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 7 != 0 for k in range(100)} and not all(got.values())
    assert all(r.verified for r in m.manifest(df, tampered=None).collect())
