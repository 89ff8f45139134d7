from random import Random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptloom.llm import suffix_dedup as s


def brute(rows):
    """Spans to remove of each row, by plain sets of windows."""
    last = (1 << 63) - 1
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), last if i is None else i
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(i, first.get(w, last))
    out = []
    for i, t in rows:
        b, n = (t or "").encode(), last if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < n:
                gone[p : p + 50] = b"\1" * 50
        spans = []
        for p, x in enumerate(gone):
            if x and spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            elif x:
                spans.append([p, p + 1])
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g), tuple(map(tuple, spans))))
    return sorted(out, key=repr)


def texts(seed, n=120):
    rnd = Random(seed)
    word = lambda: rnd.choice(["alpha", "é", "of", "日本語", "z\x00\x00", "longer-word", "\n", "q"])
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rnd.randint(12, 60)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else prose(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 6))]
        text = " ".join(parts)
        if rnd.random() < 0.2 and rows:
            text = rnd.choice(rows)[1]
        if text and rnd.random() < 0.3:
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice("xyé\x00") + text[k + 1 :]
        rows.append((rnd.choice([i, i, i, i // 2, None]), text))
    return rows


HARD = [(1, None), (2, ""), (3, "z" * 49), (4, "z" * 50), (5, "z" * 200), (5, "z" * 120), (6, "ab" * 90), (7, "ba" * 60), (None, "ab" * 40), (None, "\x00" * 90), (9, "\x00" * 60), (8, "é" * 40 + "z" * 60), (8, "é" * 40 + "z" * 60)]


@pytest.mark.parametrize("rows", [HARD, [], texts(1), texts(2)])
def test_like_plain_windows(spark, monkeypatch, rows):
    monkeypatch.setattr(s, "RANGE_ENTRIES", 50)
    monkeypatch.setattr(s, "RUN_ENTRIES", 200)
    df = spark.createDataFrame([(i, t, 1, b"k") for i, t in rows], "doc_id long, text string, hash int, kept binary").repartition(5)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), tuple((x.begin, x.end) for x in r.spans)) for r in s.drop_repeats(df, slot_bits=16).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_full_sketch_changes_nothing(spark):
    rows = texts(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, bytes(r.kept), tuple((x.begin, x.end) for x in r.spans)) for r in s.drop_repeats(df, slot_bits=9).collect()]
    assert sorted(got, key=repr) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab\x00", max_size=8).map(str.encode), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    given = [(r, [0, *(shared(a, b) for a, b in zip(r, r[1:]))][: len(r)]) for r in runs]
    run, number, common = s.merge(given)
    merged = [runs[r][n] for r, n in zip(run, number)]
    assert merged == sorted(x for r in runs for x in r)
    assert common == [0, *(shared(a, b) for a, b in zip(merged, merged[1:]))][: len(merged)]


def test_equal_windows_have_equal_anchors():
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 100, 3000).astype(np.uint8)
    whole = {}
    place, _, first, last = s.anchors(data, np.array([len(data)]))
    assert (first <= place).all() and (place + s.ANCHOR <= last + s.WINDOW).all() and (last - first < s.LEFT + 1).all()
    for p, f, l in zip(place, first, last):
        for w in range(f, l + 1):
            whole[w] = p - w
    assert sorted(whole) == list(range(len(data) - s.WINDOW + 1))
    for w in range(0, len(data) - s.WINDOW, 37):
        alone = s.anchors(data[w : w + s.WINDOW], np.array([s.WINDOW]))
        assert alone[0].tolist() == [whole[w]]
