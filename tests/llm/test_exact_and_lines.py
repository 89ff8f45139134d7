import hashlib
from collections import Counter, defaultdict

import pytest

from scriptloom.llm import exact_dedup as e
from scriptloom.llm import line_dedup as ld

ROWS = [(5, "a"), (3, "a"), (9, ""), (1, None), (2, "A"), (None, "a"), (None, "n"), (None, "n"), (7, "x" * 300_000), (8, "x" * 300_000), (4, "dup"), (4, "dup"), (4, "other")]


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(spark, keep):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in ROWS], "doc_id long, text string, run int, keep string").repartition(7)
    got = e.exact_duplicates(df, keep).collect()
    assert len(got) == len(ROWS)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    best = max if keep == "max" else min
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        named = [i for i in groups[text] if i is not None]
        assert r.keep_id == (best(named) if named else None) and r.group_size == len(groups[text])
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    left = e.drop_exact_duplicates(df, keep)
    assert left.columns == df.columns and Counter((r.text or "") for r in left.collect()) == Counter(dict.fromkeys(groups, 1))


def test_runs_meet_in_rounds(spark):
    """Many runs, wide fans: a group in every run, one in two far runs, and single rows; the plan exchanges places."""
    from pyspark.sql import functions as F

    assert [e.fan_bits(n) for n in (0, 1, 2, 8, 9, 64, 65, 512, 10**7)] == [1, 1, 1, 1, 2, 2, 3, 3, 6]
    df = spark.range(0, 600, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id").isin(1, 599), "pair").otherwise(F.col("id").cast("string")).alias("text"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in e.exact_duplicates(df).collect()}
    assert got[0] == (597, 200, False) and got[597] == (597, 200, True) and got[1] == (599, 2, False)
    assert all(got[i] == (i, 1, True) for i in range(2, 599) if i % 3)
    rows = df.select("doc_id", *e._key(F.col("text"))).withColumn("row", F.col("doc_id")).withColumn("run", F.spark_partition_id())
    plan = e._merge(rows, F.max, e.fan_bits(40))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(place") == e.ROUNDS and plan.count("Exchange") == e.ROUNDS + 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert e.exact_duplicates(df).count() == 0 and e.drop_exact_duplicates(df).count() == 0
    assert ld.drop_repeated_lines(df).count() == 0


def brute_lines(rows):
    """Windows read in order, first ones remembered."""
    ordered = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    seen, gone = {}, defaultdict(set)
    for i, t in ordered:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            key = tuple(lines[p : p + 3])
            if key in seen:
                gone[i, t] |= {p, p + 1, p + 2}
            seen.setdefault(key, (i, p))
    return {(i, t): "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]) for i, t in ordered}


PASSAGE = "p1\np2\np3\np4\np5"
LINES = [
    (1, f"a\n{PASSAGE}\nb"), (2, f"{PASSAGE}"), (3, f"c\n{PASSAGE}\n{PASSAGE}"), (4, "p1\np2"), (5, None), (6, ""), (7, "z\nz\nz\nz\nz"), (8, "\n\n\n"),
    (9, "\n\n\n\n"), (9, "\n\n\n\n"), (None, PASSAGE), (10, "é\nü\nß\n" * 2000), (11, "solo\nlines\nhere"),
]


def test_repeated_lines(spark):
    df = spark.createDataFrame([(i, t, 0, "m") for i, t in LINES], "doc_id long, text string, n_lines int, removed string").repartition(5)
    got = ld.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "removed", "n_lines_", "n_removed"]
    expected = brute_lines(LINES)
    for r in got.collect():
        source = next(t for i, t in LINES if i == r.doc_id)
        if r.doc_id is None or source is None:
            assert r.text == source and r.n_removed == 0
        else:
            assert r.text == expected[r.doc_id, source], r.doc_id
            kept = len(r.text.split("\n")) if r.n_removed < r.n_lines_ else 0
            assert r.n_lines_ == len(source.split("\n")) and r.n_lines_ - r.n_removed == kept
    assert got.count() == len(LINES)
