import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.config import ExtractConfig
from scriptloom.functions import charset, layout, text
from scriptloom.operators import lookups, sequences, splice, tools, tree
from scriptloom.sources import formats, marshal, tables
from scriptloom.sources import text as sources


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(column).collect()]


def test_string_functions(spark):
    t = F.col("t")
    assert values(spark, text.to_half_width(text.to_full_width(t)), "aZ ~!", None) == ["aZ ~!", None]
    assert values(spark, text.hard_wrap(t, 2, "\n"), "abcde", "\n", "a\nbc") == ["ab\ncd\ne", "\n", "ab\nc"]
    assert values(spark, text.cut_utf8(t, 4), "aéüb", "日本", "") == ["aé", "日", ""]
    assert values(spark, text.newline_vote(t), "a\r\nb", "a\nb", "a\r\nb\nc") == ["\r\n", "\n", "\r\n"]
    assert values(spark, text.bracket_balance(t), "「a", "「」") == [1, 0]
    assert values(spark, text.looks_like_path(t), "a/b.png", "hello there", "x.txt") == [True, False, True]
    assert values(spark, text.byte_offset(t, F.lit(2)), "éab") == [3]


def test_split_zip(spark):
    def run(o, t, **k):
        df = spark.createDataFrame([(o, t)], "o string, t string")
        return df.select(text.split_zip(F.col("o"), F.col("t"), "\n", **k)).first()[0]

    assert run("a\nb", "x\ny\nz") == ["x", "yz"]
    assert run("a\nb", "x") == ["x", "　"]
    assert run("a\nb", "") == ["", ""]
    assert run("", "x") == []
    assert run("a\nb", "x\ny", add_bytes="*", max_line_count=4) == ["x", "y**"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab。、\n", min_size=1, max_size=30), st.text("xy。、\n", max_size=40))
def test_redistribution_keeps_text_and_lines(orig, trans):
    config = ExtractConfig(para_sep="\n")
    parts = layout.redistribute_text(orig, trans, config)
    assert len(parts) == len(orig.split("\n"))
    assert "".join(parts).replace("　", "") == trans.replace("\n", "")


@given(st.text("aé日。", max_size=40), st.integers(2, 9))
def test_wrapped_lines_fit(t, limit):
    lines = layout.wrap_bytes_text(t, limit, "utf-16-le")
    assert "".join(lines) == t and all(len(x.encode("utf-16-le")) <= limit for x in lines)


@given(st.text("aé日", max_size=20), st.integers(0, 30))
def test_fitted_bytes(t, size):
    data, diff = charset.fit_bytes(t, size, "utf-8", b"\x81\x40")
    assert len(data) == size and diff == size - len(t.encode())
    whole = t.encode()
    assert data.startswith(whole) if diff >= 0 else whole.startswith(data.rstrip(b" ").replace(b"\x81\x40", b""))


@given(st.binary(max_size=3000))
def test_lzss_round_trip(data):
    assert charset.lzss_decompress(charset.lzss_compress(data)) == data


def test_lzss_compresses():
    assert len(charset.lzss_compress(b"abcabcabc" * 100)) < 200


@given(st.binary(max_size=200), st.binary(min_size=1, max_size=5))
def test_xor_twice(data, key):
    assert charset.xor_bytes(charset.xor_bytes(data, key), key) == data


def test_charset_helpers():
    assert charset.is_shift_jis("日本".encode("cp932")) and not charset.is_shift_jis(b"a")
    assert charset.keep_bytes(b"a\x01b", b"\x01") == b"a<01>b"
    assert b"".join(charset.encode_text("a<01>b", "ascii", marks=True)) == b"a\x01b"
    codes = charset.huffman_codes(charset.byte_histogram(b"aaaabbc"))
    assert len(codes[97]) < len(codes[99])
    assert charset.read_prefixed(charset.write_prefixed(b"abc", 2), 0, 2) == b"abc"
    assert charset.utf8_start("é".encode(), 1) == (2, 0)
    assert layout.break_at_punctuation("あい。うえ、お", [8, 7, 8]) == ["あい。", "うえ、", "お"]
    assert layout.pair_quotes('"a" "b"') == "“a” “b”"
    assert layout.strip_ruby("{漢/かん}字") == "漢字"
    assert layout.to_fix_point("aaaa", [("aa", "a")]) == "a"


def test_safe_expressions():
    data = (5).to_bytes(4, "little") + (7).to_bytes(4, "little")
    assert sources.evaluate("readInt(data, 4)*4+0x10", data) == 44
    with pytest.raises(ValueError):
        sources.evaluate("__import__('os')", data)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny\n".encode())
    (tmp_path / "b.bak").write_bytes(b"no")
    (tmp_path / "j.dat").write_bytes("日本".encode("cp932"))
    assert [tuple(r) for r in sources.lines(sources.files(spark, str(tmp_path), ".txt")).orderBy("line_no").collect()] == [("a.txt", 0, "x"), ("a.txt", 1, "y"), ("a.txt", 2, "")]
    assert sources.decoded_files(spark, str(tmp_path), "cp932", ".dat").first().text == "日本"
    df = spark.createDataFrame([("f", "a1b2c")], "file string, text string")
    assert [r.line for r in sources.units(df, r"(\d)").orderBy("line_no").collect()] == ["a", "1", "b", "2", "c"]
    blob = spark.createDataFrame([("f", bytearray(b"..ab\x00cd\x00"))], "file string, data binary")
    assert [(r.offset, bytes(r.unit)) for r in sources.binary_units(blob, b"\x00", section=("2", "8")).orderBy("unit_no").collect()] == [(2, b"ab"), (5, b"cd"), (8, b"")]
    (tmp_path / "t.csv").write_text('a,b\n"x,1",\n')
    assert [tuple(r) for r in tables.csv(spark, str(tmp_path / "t.csv")).collect()] == [("x,1", None)]


def test_xml(spark):
    doc = '<r><TextRes NO="1">Ann</TextRes><TextRes NO="2">hi</TextRes><Log NAME="1" MESS="2"/><Log NAME="9" MESS="2"/></r>'
    rows = tables.xml_dialogue(spark.createDataFrame([("f", doc)], "file string, xml string")).collect()
    assert [(r.seq, r.name, r.message) for r in rows] == [(0, "Ann", "hi")]


def test_typed_table(spark):
    columns = [("id", "int"), ("name", "str"), ("tags", "lst"), ("names", "dic"), ("raw", "byte2")]
    row = (300, "né", ["a", ""], {5: "x"}, b"\x00\xff")
    body = b"".join(tables.write_value(k, v) for (_, k), v in zip(columns, row, strict=True))
    data = (1).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
    got = tables.typed_rows(spark.createDataFrame([("f", bytearray(data))], "file string, data binary"), columns).first()
    assert (got.id, got.name, got.tags, got.names, bytes(got.raw)) == row


def test_marshal():
    assert json.loads(marshal.to_json(b"\x04\x08[\x09i\x02\x2c\x010T\"\x06a")) == [300, None, True, {"@kind": "bytes", "data": "YQ=="}]
    assert json.loads(marshal.to_json(b'\x04\x08I"\x07hi\x06:\x06ET')) == "hi"
    assert json.loads(marshal.to_json(b"\x04\x08{\x06:\x06ai\xfa")) == {"@kind": "hash", "pairs": [[{"@kind": "symbol", "name": "a"}, -1]]}


def test_formats_round_trip(spark):
    rows = spark.createDataFrame([(0, "Ann", 'a"b\r\nc'), (1, None, "ü"), (2, "x", "x")], "n int, name string, message string")
    expected = [(0, "Ann", 'a"b\r\nc'), (1, None, "ü"), (2, "x", "x")]
    args = (F.col("name"), F.col("message"), F.col("n") + 1)
    doc2 = formats.document(rows, formats.item_lines(2, *args), ["n"], [], 2)
    assert json.loads(doc2.first().document)[1] == {"message": "ü"}
    assert [tuple(r) for r in formats.read_items(doc2).orderBy("pos").collect()] == expected
    doc9 = formats.document(rows, formats.item_lines(9, *args), ["n"], [], 9)
    assert doc9.first().document.startswith('☆000001☆Ann☆a"b\\r\\nc\n★000001★')
    assert [(r.number - 1, r.name, r.orig) for r in formats.read_two_line(doc9).orderBy("number").collect()] == expected
    flat = formats.document(rows, formats.item_lines(7, *args), ["n"], [], 7)
    assert [r.text for r in formats.read_list(flat).orderBy("pos").collect()] == ["Ann", 'a"b\r\nc', "ü", "x", "x"]
    maps = formats.document(rows, formats.item_lines(10, *args), ["n"], [], 10)
    assert [(r.pos, r.text) for r in formats.read_map_list(maps).orderBy("pos", "text").collect()] == [(0, "Ann"), (0, 'a"b\r\nc'), (1, "ü"), (2, "x")]
    lines = formats.document(rows, F.array("message"), ["n"], [], 5)
    assert formats.read_lines(lines).count() == 4  # a message with a newline is two lines
    members = rows.select("n", formats.dictionary_member(1, F.col("message"), F.lit("")).alias("m"))
    known = formats.document(members, F.array("m"), ["n"], [], 1)
    assert {tuple(r) for r in formats.read_dictionary(known).collect()} == {(m, m) for _, _, m in expected}
    assert json.loads(formats.rebuilt_json({"a": [1], "b": "ü"}, 10)) == {"a": [1], "b": "ü"}


def test_splice_several_spans(spark):
    lines = spark.createDataFrame([(0, "hello world"), (1, "same")], "n int, line string")
    spans = spark.createDataFrame([(0, 6, 11, "you"), (0, 0, 5, "bye")], "n int, start int, end int, translated string")
    assert [r.line for r in splice.splice(lines, spans, ["n"]).orderBy("n").collect()] == ["bye you", "same"]


def test_sequences(spark):
    rows = spark.createDataFrame([("f", i, s, t) for i, (s, t) in enumerate([("A", "「open"), ("A", "close」"), ("A", "「x」"), ("B", "p"), ("B", "q"), ("B", "r"), ("B", "s"), ("A", "t")])], "file string, n int, who string, text string")
    merged = [(r.n_parts, r.message) for r in sequences.merge_speaker_lines(rows, "file", "n", "who", "text").orderBy("first").collect()]
    assert merged == [(2, "「open\r\nclose」"), (1, "「x」"), (3, "p\r\nq\r\nr"), (1, "s"), (1, "t")]
    closed = [(r.n_parts, r.message) for r in sequences.merge_unclosed(rows, "file", "n", "who", "text").orderBy("first").collect()]
    assert closed[0] == (2, "「openclose」") and len(closed) == 7
    new = spark.createDataFrame([("f", 0, "N", "a"), ("f", 1, None, "new"), ("f", 2, None, "b")], "file string, n int, name string, message string")
    old = spark.createDataFrame([("f", 0, None, "a", None, "ta"), ("f", 1, None, "b", None, "tb")], "file string, n int, name string, message string, trans_name string, trans string")
    got = [(r.name, r.message, r.fix) for r in sequences.align_inserts(new, old, "file", "n").orderBy("seq").collect()]
    assert got == [("N", "ta", "new_name"), (None, "new", "new_item"), (None, "tb", None)]


def test_tools_and_lookups(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    assert [r.part for r in tools.split_equal(rows, 3, 10).orderBy("pos").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    sizes = spark.createDataFrame([("a", 4), ("b", 0), ("c", 6)], "file string, entries long")
    assert [r.file for r in tools.split_by_manifest(rows, sizes, "file", "file").orderBy("pos").collect()] == ["a"] * 4 + ["c"] * 6
    assert tree.include_key("!a,b")("c") and not tree.include_key("!a")("a") and tree.include_key("a")("a") and not tree.include_key("none")("a")
    assert tree.header_columns(["x", "name", "y"], "0,name1") == [("x", False), ("name", True)]
    learned = spark.createDataFrame([("f", 0, "v1"), ("f", 1, "Ann"), ("f", 2, "v1"), ("f", 3, "other")], "file string, n int, text string")
    got = lookups.learned_names(learned, F.when(F.col("text").startswith("v"), F.col("text")), F.col("text").startswith("v"), ["file"], ["n"]).orderBy("n").collect()
    assert [got[0].learned, got[2].learned] == ["Ann", "Ann"]
    nested = spark.createDataFrame([(1, json.dumps({"a": json.dumps(["x", {"b": "y"}]), "code": 3, "parameters": ["p", None, 4]})), (2, "{bad"), (3, None)], "id int, j string")
    assert [(r.id, "/".join(r.path), r.code, r.text) for r in tree.leaves(nested, "j").orderBy("leaf_no").collect()] == [(1, "a/0", 3, "x"), (1, "a/1/b", 3, "y"), (1, "parameters/0", 3, "p")]


def test_append_stream(spark, tmp_path):
    from scriptloom.streaming import append

    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    (source / "1.txt").write_text("a\nb\na")
    for extra in (None, "b\nc"):
        if extra:
            (source / "2.txt").write_text(extra)
        append.append_dictionary(append.line_stream(spark, str(source)), str(out), str(state)).awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(str(out)).collect()) == ["a", "b", "c"]


def test_names_and_reports(spark):
    from scriptloom.functions import paths, reports

    assert paths.interpolate("%A%/%B%", {"A": "x"}) == "x/%B%"
    assert paths.reencode_name("日本".encode("cp932").decode("cp437")) == "日本" and paths.reencode_name("日") == "日"
    names = spark.createDataFrame([("a10",), ("A9",), ("b1",)], "n string")
    assert [r.n for r in names.orderBy(paths.natural_key(F.col("n"))).collect()] == ["A9", "a10", "b1"]
    assert reports.charset_pairs({"gbk": {"a": "b"}, "cp932,utf-8": {"c": "d"}}, "CP932") == {"c": "d"}
    conf = spark.createDataFrame([('{"trans_replace": {"gbk": {"x": ""}}, "comment": 1}',)], "text string")
    assert reports.text_config(conf).first().trans_replace == {"gbk": {"x": ""}}
    rows = spark.createDataFrame([(0, "ab", -1), (1, "ab", -3), (2, "b", 0)], "n int, t string, d int")
    assert [tuple(r) for r in reports.cut_report(rows, F.col("d"), "t").collect()] == [("ab", "ab", -3)]
    chars = reports.used_characters(rows, "t", ["n"])
    assert {r.ch: (r.first.n, r.first["at"], r.n) for r in chars.collect()} == {"a": (0, 0, 2), "b": (0, 1, 3)}
    table = spark.createDataFrame([("a", "X"), ("b", "X")], "ch string, substitute string")
    assert {r.state for r in reports.substitution_report(chars, table).collect()} == {"repeat"}
    assert reports.reason_counts(rows, {"long": F.length("t") > 1}).first().long == 2


def plain_redistribution(orig, trans, sep, symbols, blank):
    """Cut by cut, from the contract: nearest punctuation, strictly ascending, one left for each cut to come."""
    lines, flat = orig.split(sep), trans.replace(sep, "")
    n = len(lines)
    if n == 1:
        return [flat]
    ends = [i + 1 for i, c in enumerate(flat) if c in symbols]
    if len(ends) <= n:
        cuts = ends + [len(flat)] * (n - len(ends))
    else:
        cuts, seen, low = [], 0, 0
        for k in range(n - 1):
            seen += len(lines[k])
            mark = int(seen * (len(trans) / len(orig)))
            best = min(range(len(ends)), key=lambda i: (abs(ends[i] - mark), i))
            best = min(max(best, low), len(ends) - n + k)
            cuts.append(ends[best])
            low = best + 1
        cuts.append(ends[-1])
    parts = [flat[a:b] or blank for a, b in zip([0, *cuts], cuts, strict=False)]
    if cuts[-1] < len(flat):
        parts[-1] = ("" if cuts[-1] == ([0, *cuts])[-2] else parts[-1]) + flat[cuts[-1] :]
    return parts


def test_redistribution_by_plain_loops():
    import random

    from scriptloom.config import ExtractConfig
    from scriptloom.functions.layout import redistribute_text

    rng = random.Random(1)
    config = ExtractConfig(para_sep="|", symbols="[.,]", add_space="_")
    for _ in range(3000):
        orig, trans = ("|".join("".join(rng.choice("abc.,") for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 6))) for _ in "xy")
        if orig:
            assert redistribute_text(orig, trans, config) == plain_redistribution(orig, trans, "|", ".,", "_")


def test_packed_orders(spark):
    from scriptloom.operators import dictionary

    rows = spark.createDataFrame([("a", -5, 3, 1), ("a", -5, 2, 9), ("a", 4, 0, 0), ("b", 2**60, 2**31 - 1, 0), ("b", 2**60, 2**31 - 1, 7)], "text string, i long, j int, k int")
    got = {r.text: tuple(r["first"]) for r in dictionary.first_seen(rows, "text", ["i", "j", "k"]).collect()}
    assert got == {"a": (-5, 2, 9), "b": (2**60, 2**31 - 1, 0)}
    plan = dictionary.first_seen(rows, "text", ["i", "j", "k"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert dictionary.packed_order(rows, ["text"]) is None
    with pytest.raises(Exception, match="negative"):
        dictionary.first_seen(rows.withColumn("k", -rows.k - 1), "text", ["i", "k"]).collect()
