import re
from collections import Counter, defaultdict
from random import Random

import pytest

from scriptloom.llm import collocations as c

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, most, top):
    f, total = defaultdict(Counter), Counter()
    name = lambda lang: "und" if lang is None else lang
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[name(lang)] += len(w)
            for n in range(1, most + 1):
                f[name(lang)].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return out


def made(seed, n=400):
    rnd = Random(seed)
    words = ["ab", "É\xa0x", "b", "c", "\x1fd", "B", "e\x00f", "日本", "na"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(rnd.randint(0, 60)))
    return [(rnd.choice(["en", "en", "en", None, "", "fr"]), text()) for _ in range(n)]


HARD = [("en", None), ("en", ""), (None, " \t\n"), ("en", "na na na na na"), ("en", "na " * 30_000), ("fr", "q" * 200_000 + " r"), ("fr", "q" * 200_000 + " r"), ("en", "A,b;A b a b")] * 3


@pytest.mark.parametrize("rows,min_count,most,top", [(made(1), 10, 3, 25), (made(2, 200), 3, 4, 2000), (made(3, 60), 1, 2, 2000), (HARD, 3, 3, 20), ([], 10, 3, 10)])
def test_like_plain_counts(spark, monkeypatch, rows, min_count, most, top):
    monkeypatch.setattr(c, "AUTOMATON_BYTES", 2000)
    monkeypatch.setattr(c, "BUCKET_PHRASES", 20)
    df = spark.createDataFrame([(k, lang, t, 1, "x") for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(3)
    got = c.collocations(df, min_count, most, top, slot_bits=20).collect()
    assert {tuple(r) for r in got} == brute(rows, min_count, most, top) and len(got) == len(set(got))


def test_shared_slots_change_nothing(spark, monkeypatch):
    """A sketch so small that every phrase passes, and runs of few words."""
    monkeypatch.setattr(c, "RUN_BYTES", 2000)
    rows = made(4)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    _, counts = c.phrase_counts(df, 10, 3, slot_bits=9)
    _, same = c.phrase_counts(df, 10, 3, slot_bits=22)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, same.collect())) != []
