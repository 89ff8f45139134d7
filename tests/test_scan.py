from random import Random

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import codepage
from scriptloom.operators import dictionary, scan, tunnel


def made(seed, n=300, hot=0.4):
    rnd = Random(seed)
    keys = ["hot" if rnd.random() < hot else rnd.choice(["a", "b", None, f"k{k}"]) for k in range(n)]
    return [(k // 9 - 3, k % 9, key, rnd.choice([None, None, f"v{k}"])) for k, key in enumerate(keys)]


@pytest.mark.parametrize("rows", [made(1), made(2, 40, 1.0), [], [(0, 0, None, None)], [(0, 0, "x", "v")] * 3])
def test_carried_values(spark, rows):
    """Against a dictionary that is read in order; many partitions, a hot key, null keys, and clashing names."""
    df = spark.createDataFrame([(*r, 1) for r in rows], "file long, line int, key string, v string, _place int").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        by_key = scan.carried(df, F.col("v"), ["file", "line"], "got", ["key"], inclusive=False)
        overall = scan.carried(df, F.col("v"), ["file", "line"], "got")
        assert by_key.columns == [*df.columns, "got"]
        got, whole = by_key.collect(), overall.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    if len(set(rows)) < len(rows):  # ties stand in any order
        assert len(got) == len(rows)
        return
    last, seen, expected = {}, None, {}
    for f, n, k, v in sorted(rows, key=lambda r: r[:2]):
        seen = v if v is not None else seen
        expected[f, n] = (last.get(k), seen)
        if v is not None:
            last[k] = v
    assert {(r.file, r.line): r.got for r in got} == {k: v[0] for k, v in expected.items()}
    assert {(r.file, r.line): r.got for r in whole} == {k: v[1] for k, v in expected.items()}


def test_neighbours_and_positions(spark):
    rows = [(k, f"t{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "n int, t string").repartition(6)
    assert sorted(scan.following(df, F.col("t"), ["n"], "next").collect()) == [(k, t, f"t{k + 1}" if k < 99 else None) for k, t in rows]
    assert sorted(scan.positions(df.where("n % 3 = 0"), ["n"]).collect()) == [(k, f"t{k}", k // 3) for k in range(0, 100, 3)]
    assert scan.positions(df.where("n < 0"), ["n"]).count() == 0
    text = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sorted(map(tuple, dictionary.with_position(text, ["k"]).select("v", "pos").collect())) == [(1, 2), (2, 1), (3, 0)]


def test_learned_names(spark):
    """A second definition replaces the first from the row after it on; one at the very end defines nothing."""
    lines = ["v1", "Ann", "v1", "v2", "v1", "Bob", "v1", "v1"]
    defines = [True, False, False, False, True, False, False, True]
    df = spark.createDataFrame([(k, t, d) for k, (t, d) in enumerate(zip(lines, defines))], "n int, t string, d boolean")
    got = scan.learned_names(df, "t", F.col("d"), F.col("t"), ["n"]).orderBy("n").collect()
    assert [r.learned for r in got] == [None, None, "Ann", None, "Ann", None, "Bob", "Bob"]


@pytest.mark.parametrize("encoding", ["cp932", "gbk"])
def test_codepages_like_codecs(spark, encoding):
    chars = "".join(c for c, _ in codepage.table(encoding))
    rnd = Random(3)
    texts = [None, "", "plain ~\\", "é" * 3, "漢字かなｶﾅ", "日a" * 40_000, chars, chars[::-1]] + ["".join(rnd.choice(chars + "ab é丂") for _ in range(rnd.randint(1, 30))) for _ in range(60)]

    def code(t):
        try:
            return t.encode(encoding)
        except UnicodeEncodeError:
            return None

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("t", codepage.encoded(F.col("t"), encoding).alias("b"), codepage.decoded(codepage.encoded(F.col("t"), encoding), encoding).alias("back")).collect()
    for r in got:
        expected = None if r.t is None else code(r.t)
        assert (None if r.b is None else bytes(r.b)) == expected
        assert r.back == (None if expected is None else expected.decode(encoding))
    bad = spark.createDataFrame([(bytearray(b"\x81"),), (bytearray(b"a\x85"),)], "b binary")
    assert [r[0] for r in bad.select(codepage.decoded(F.col("b"), encoding)).collect()] == [None, None]


def test_fitted_like_python(spark):
    from scriptloom.functions import charset

    rnd = Random(4)
    texts = ["", "あ", "aあ", "あ" * 9, "x" * 9] + ["".join(rnd.choice("ab日本") for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    df = spark.createDataFrame([(t, n) for t in texts for n in (0, 1, 6, 7)], "t string, n int")
    for padding in (b"", b"-=", "　".encode("cp932")):
        for r in df.select("t", "n", codepage.fitted(F.col("t"), F.col("n"), "cp932", padding).alias("f")).collect():
            assert (bytes(r.f.data), r.f.diff) == charset.fit_bytes(r.t, r.n, "cp932", padding), (r.t, r.n, padding)


def test_tunnel(spark):
    """The same codes at any partitioning, by first place; decoding gives every text back; too many characters are an error."""
    assert len(tunnel.codes()) == 61 * 58 and tunnel.codes()[0] == b"\x81\x01" and tunnel.codes()[31 * 58] == b"\xe0\x01"
    rows = [(2, "éa日é"), (1, "zß"), (3, None), (4, ""), (5, "ñßé" * 1000), (6, "plain, text\t")]
    df = spark.createDataFrame(rows, "n int, t string")
    for parts in (1, 5):
        numbered = tunnel.tunnel_codes(df.repartition(parts), "t", ["n"])
        assert {r.char: r.code for r in numbered.collect()} == {"ß": 0, "é": 1, "ñ": 2}
    table = tunnel.code_map(numbered)
    sent = df.select("n", "t", tunnel.tunnel_encoded(F.col("t"), table).alias("b"))
    got = sent.select("n", "t", "b", tunnel.tunnel_decoded(F.col("b"), table).alias("back")).collect()
    assert all(r.back == r.t for r in got) and bytes(next(r.b for r in got if r.n == 2)) == b"\x81\x02a\x93\xfa\x81\x02"
    assert tunnel.tunnel_file(numbered) == "ßéñ".encode("utf-16-le")
    many = spark.createDataFrame([(0, "".join(chr(c) for c in range(0x10000, 0x10000 + 4000)))], "n int, t string")
    with pytest.raises(ValueError):
        tunnel.code_map(tunnel.tunnel_codes(many, "t", ["n"]))
