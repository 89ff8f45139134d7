import os
from random import Random

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import folds, layout
from scriptloom.operators import dictionary
from scriptloom.sources import formats
from scriptloom.streaming import append, numbers


def some(alphabet, seed, n=60, size=40):
    rnd = Random(seed)
    return ["", None] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_folds_like_plain_loops(spark):
    texts = some('a"b「」。、日{x/y}$', 1) + ["日" * 5000 + "。", "「" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", folds.paired_quotes(F.col("t")).alias("q"), folds.without_ruby(F.col("t")).alias("r"), folds.parts_for_slots(F.col("t"), [7, 0, 12, 5]).alias("p"), folds.parts_for_slots(F.col("t"), [3]).alias("one"))
    for r in got.collect():
        if r.t is None:
            assert (r.q, r.r, r.p, r.one) == (None,) * 4
            continue
        assert r.q == layout.pair_quotes(r.t) and r.r == layout.strip_ruby(r.t)
        assert r.p == layout.break_at_punctuation(r.t, [7, 0, 12, 5]), r.t
        assert r.one == [r.t]


def test_fixed_point(spark):
    pairs = [("ab", "b"), ("bb+", "b"), (r"(c)\1", r"\1")]
    texts = some("abc", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r.n: (r.t, r.rounds) for r in folds.fixed_point(df, "t", pairs).collect()}
    for n, t in enumerate(texts):
        rounds = 0
        while t is not None and (after := layout.to_fix_point(t, pairs, most=1)) != t:
            t, rounds = after, rounds + 1
        assert got[n] == (t, rounds)
    with pytest.raises(ValueError, match="still change"):
        folds.fixed_point(df.where("t like '%a%'"), "t", [("a", "aa")], most=3)
    assert folds.fixed_point(df.where("n < 0"), "t", pairs).count() == 0


def test_layers(spark):
    rows = [(0, 1, "a", "old"), (1, 0, "a", "new"), (1, 5, "a", None), (2, 9, "b", "x"), (0, 3, "c", "first"), (0, 4, "c", "second"), (None, 0, "c", "none"), (2, 0, None, "null key")]
    df = spark.createDataFrame(rows, "layer int, n int, text string, v string")
    got = {r.text: (r.v, r.layer, r["first"].layer, r["first"].n) for r in dictionary.overlay(df, "v", "layer", ["n"]).collect()}
    assert got == {"a": (None, 1, 0, 1), "b": ("x", 2, 2, 9), "c": ("second", 0, None, 0), None: ("null key", 2, 2, 0)}
    left = dictionary.unlayered(spark.createDataFrame([("a",), ("z",), (None,)], "text string"), df)
    assert {r.text for r in left.collect()} == {"z", None}


def test_occurrences_of_a_hot_line(spark):
    """Against plain counting from the end: many values, few, none, empty ones, and unknown keys."""
    rnd = Random(3)
    rows = [(k // 50, k % 50, rnd.choice(["hot", "hot", "hot", "b", "c", "d", None])) for k in range(400)]
    table = {"hot": ["1", "2", "3", ""], "b": ["only"], "c": [], "d": ["", "x"]}
    df = spark.createDataFrame([(*r, 0) for r in rows], "f int, n int, text string, _trans int").repartition(5)
    known = spark.createDataFrame(list(table.items()), "text string, trans array<string>")
    left, expected = {}, {}
    for f, n, t in sorted(rows, reverse=True, key=lambda r: r[:2]):
        left[t] = left.get(t, 0) + 1
        values = table.get(t, [])
        value = values[max(len(values) - left[t] + 1, 1) - 1] if values else ""
        expected[f, n] = value or t
    for most in (None, 4):
        got = dictionary.occurrence_join(df, known, ["f", "n"], most=most)
        assert got.columns == [*df.columns, "translated"]
        assert {(r.f, r.n): r.translated for r in got.collect()} == expected


def test_outputs_in_one_pass(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", None), ("c", "")], "file string, t string").repartition(2)
    made = {0: F.col("t"), 5: F.concat("file", F.lit("!"))}
    seen = formats.write_outputs(docs, made, f"{tmp_path}/out")
    assert seen == {"rows": 3, "texts00": 2, "lines00": 3, "texts05": 3, "lines05": 3}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/format=05").collect()) == ["a!", "b!", "c!"]


def write(path, text, at):
    path.write_text(text, encoding="utf-8")
    os.utime(path, (at, at))


def test_numbers_of_a_stream(spark, tmp_path):
    """Three batches give the numbers of one; a batch that runs again changes nothing; late files are left out."""
    (tmp_path / "in").mkdir()
    files = {"a.txt": "one\ntwo\none", "b.txt": "three\n\ntwo", "c.txt": "four\nthree\nfive"}
    for k, (name, text) in enumerate(files.items()):
        write(tmp_path / "in" / name, text, 1_700_000_000 + 1000 * k)
        numbers.numbered_dictionary(append.line_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    expected = {"one": 0, "two": 1, "three": 2, "four": 3, "five": 4}
    assert {r.text: r.number for r in got.collect()} == expected and got.select("batch").distinct().count() == 3
    numbers.numbered_dictionary(append.line_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/whole", f"{tmp_path}/check2").awaitTermination()
    assert {r.text: r.number for r in spark.read.parquet(f"{tmp_path}/whole").collect()} == expected
    lines = spark.createDataFrame([("c.txt", 0, "four"), ("c.txt", 2, "five")], "file string, line_no int, line string").withColumn("modified", F.timestamp_seconds(F.lit(1_700_002_000)))
    numbers.number_lines(lines, 2, f"{tmp_path}/out")
    assert {r.text: r.number for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected
    late = spark.createDataFrame([("0.txt", 0, "old"), ("d.txt", 0, "young")], "file string, line_no int, line string").withColumn("modified", F.timestamp_seconds(F.when(F.col("line") == "old", 1_600_000_000).otherwise(1_700_003_000)))
    numbers.number_lines(late, 3, f"{tmp_path}/out", late="1 day")
    assert {r.text: r.number for r in spark.read.parquet(f"{tmp_path}/out").where("batch = 3").collect()} == {"young": 5}
