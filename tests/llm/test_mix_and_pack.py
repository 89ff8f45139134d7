import hashlib
import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import mixing as m
from scriptloom.llm import packing as p

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows():
    out = []
    for i in range(300):
        source = ["src0", "src0", "src1", "src5", None][i % 5]
        out.append((i, "w " * (1 + i * 7 % 23), ["en", "de"][i % 3 == 0], source))
    return out + [(300, None, "en", "src0"), (301, "", "en", "src0"), (302, "y " * 4000, "fr", "src9"), (None, "n n", "en", "src1"), (7, "w w w", "en", "src1"), (7, "w w w", "en", "src1")]


def share(budget, nodes):
    """Water-filling by repetition: (weight, capacity) of siblings to budgets."""
    full: set = set()
    while True:
        rest = budget - sum(nodes[k][1] for k in full)
        weight = sum(nodes[k][0] for k in nodes if k not in full)
        over = [k for k in nodes if k not in full and nodes[k][0] and nodes[k][1] <= Fraction(rest * nodes[k][0], weight)]
        if not over:
            out = {k: nodes[k][1] if k in full else int(Fraction(rest * nodes[k][0], weight)) if weight else 0 for k in nodes}
            open_ = sorted(k for k in nodes if k not in full and nodes[k][0])
            for k in open_[: budget - sum(out.values()) if open_ else 0]:
                out[k] += 1
            return out
        full |= set(over)


def brute(data, mix, domain):
    docs = [(i, domain(s), lang or "", s or "", len(WORD.findall(t or ""))) for i, t, lang, s in data]
    total = sum(d[4] for d in docs) * mix.budget_share // 1000 if mix.budget_tokens is None else mix.budget_tokens
    budgets = {(): total}
    for level in (1, 2, 3):
        for parent in [k for k in budgets if len(k) == level - 1]:
            tokens: dict = {}
            for d in docs:
                if d[1:level] == parent:
                    tokens[d[1 : level + 1]] = tokens.get(d[1 : level + 1], 0) + d[4]
            budgets |= share(budgets[parent], {k: (mix.weights.get("/".join(k), mix.default_weight), t * mix.max_epochs) for k, t in tokens.items()})
    out = []
    for leaf in {d[1:4] for d in docs}:
        mine = [d for d in docs if d[1:4] == leaf]
        tokens, budget = sum(d[4] for d in mine), budgets[leaf]
        epochs, rest = divmod(budget, tokens) if tokens else (0, budget)
        key = lambda d, e=epochs: hashlib.md5(f"{mix.seed}:{e}:{'' if d[0] is None else d[0]}".encode()).hexdigest()
        run = 0
        for _, group in itertools.groupby(sorted(mine, key=key), key):
            group = list(group)
            run += sum(d[4] for d in group)
            out += [(*d, budget, min(epochs + (run <= rest), mix.max_epochs)) for d in group]
    return out


MIXES = [m.Mix(), m.Mix(budget_share=900, max_epochs=1), m.Mix(budget_tokens=5000, weights={"d1": 5, "d0/de": 3, "d0/en/src0": 0}), m.Mix(budget_tokens=0), m.Mix(budget_share=9000, max_epochs=2)]


@pytest.mark.parametrize("mix", MIXES)
def test_mix(spark, mix):
    data = rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, lang string, source string, tokens int, budget int")
    domain = F.when(F.col("source").isNull(), "dx").otherwise(F.concat(F.lit("d"), (F.substring("source", 4, 1).cast("int") % 2).cast("string")))
    got = [tuple(r) for r in m.select_mix(df, mix, domain).collect()]
    expected = brute(data, mix, lambda s: "dx" if s is None else f"d{int(s[3]) % 2}")
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_budgets_are_spent(spark):
    """Within the tree's capacity nothing is left over."""
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    chosen = m.select_mix(df, m.Mix(budget_share=900, max_epochs=1), F.lit("d"))
    total = chosen.agg(F.sum("tokens")).first()[0]
    leaves = chosen.groupBy("domain", "lang", "source").agg(F.max("budget").alias("b")).agg(F.sum("b")).first()[0]
    assert leaves == total * 900 // 1000


def test_apply_mix(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string")
    out = m.apply_mix(df, m.Mix(budget_share=2000, max_epochs=3), F.lit("d"))
    assert out.columns == df.columns
    assert out.count() > df.count()
    # every row as often as it was chosen, rows without or with a repeated id as well
    chosen = m.select_mix(df, m.Mix(budget_share=2000, max_epochs=3), F.lit("d"))
    assert out.count() == chosen.agg(F.sum("copies")).first()[0]
    assert out.where("doc_id is null").count() == chosen.where("doc_id is null").agg(F.sum("copies")).first()[0]
    renamed = df.withColumnsRenamed({"text": "domain", "lang": "copies"})
    same = m.apply_mix(renamed, m.Mix(budget_share=2000, max_epochs=3), F.lit("d"), text_col="domain", lang_col="copies")
    assert same.columns == renamed.columns and same.count() == out.count()
    empty = df.where("false")
    assert m.apply_mix(empty, m.Mix(), F.lit("d")).count() == 0 and m.select_mix(empty, m.Mix(), F.lit("d")).count() == 0


def waste(lengths, counts, cuts):
    return sum(c * (min(x for x in cuts if x >= n) - n) for n, c in zip(lengths, counts, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    counts = rng.integers(1, 50, 9)
    for k in (1, 2, 3, 5, 9, 12):
        best = min(waste(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], r))
        found = p.best_boundaries(lengths, counts, k)
        assert len(found) <= k and found == sorted(found) and waste(lengths, counts, found) == best
    assert p.best_boundaries(np.array([], int), np.array([], int), 3) == []


def test_packing(spark):
    df = spark.createDataFrame([(*r, 0) for r in rows()], "doc_id long, text string, lang string, source string, bucket int")
    how = p.Packing(buckets=4, token_budget=100)
    got = p.pack(df, how).collect()
    assert len(got) == len(rows())
    assert sorted(((r.doc_id is None, r.doc_id), r.tokens) for r in got) == sorted(((i is None, i), len(WORD.findall(t or ""))) for i, t, *_ in rows())
    batches: dict = {}
    for r in got:
        assert r.padding == r.boundary - r.tokens >= 0
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    lengths, counts = np.unique([r.tokens for r in got], return_counts=True)
    assert sum(r.padding for r in got) == waste(lengths, counts, p.best_boundaries(lengths, counts, 4))
    for (bucket, batch), rs in batches.items():
        size = max(1, 100 // max(1, rs[0].boundary))
        last = max(b for k, b in batches if k == bucket)
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and (len(rs) == size or batch == last and len(rs) < size)
    assert p.pack(df.where("false"), how).count() == 0


def test_long_lengths_are_exact(spark):
    """Boundaries are lengths that occur, however long, and no others waste less."""
    lengths = [3, 2047, 2049, 2050, 2063, 4099, 4100, 20011, 20012, 20500]
    df = spark.createDataFrame([(i, "x " * n) for i, n in enumerate(lengths * 2)], "doc_id long, text string")
    got = p.pack(df, p.Packing(buckets=4)).collect()
    cuts = {r.boundary for r in got}
    assert cuts <= set(lengths)
    best = min(waste(lengths, [2] * 10, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 3))
    assert sum(r.padding for r in got) == best


def test_many_lengths(spark):
    """Divide and conquer against the plain recurrence."""
    rng = np.random.default_rng(9)
    lengths, counts = np.sort(rng.choice(10**6, 120, replace=False)) + 1, rng.integers(1, 10**9, 120)
    cost = [[sum(int(c) * int(lengths[j] - x) for x, c in zip(lengths[i : j + 1], counts[i : j + 1], strict=True)) for j in range(120)] for i in range(120)]
    best = [cost[0][j] for j in range(120)]
    for _ in range(4):
        best = [min(best[j], min((best[i - 1] + cost[i][j] for i in range(1, j + 1)), default=best[j])) for j in range(120)]
    assert waste(lengths.tolist(), counts.tolist(), p.best_boundaries(lengths, counts, 5)) == best[-1]
