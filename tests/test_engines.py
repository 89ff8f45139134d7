import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptloom.plans import blobs
from scriptloom.sources import engines as e
from scriptloom.sources import scripts, xlsx
from scriptloom.sources.assemble import TEXTS, assemble

ROWS = [(b"user", b"Some text, of words."), (b"A", b"long " * 30), ("Éà".encode(), "日本語 テキスト".encode())]


def texts_of(name, pieces):
    code = "utf-16-le" if e.LAYOUTS[name].encoding == "utf-16-le" else "utf-8"
    return [(k, p.decode(code)) for k, p in pieces if k in TEXTS and p]


@pytest.mark.parametrize("name", sorted(blobs.CONTENTS))
def test_read_write_and_change(name):
    """Files made field by field: read as they were made, written as they were, and readable with longer texts."""
    how = e.LAYOUTS[name]
    code = "utf-16-le" if how.encoding == "utf-16-le" else "utf-8"
    for n, t in ROWS:
        data = blobs.MAKERS[name](n, t)
        pieces = how.read(data)
        expected = [(kind, (n if part == "n" else t).decode()) for part, kind in blobs.CONTENTS[name]]
        assert texts_of(name, pieces) == expected
        assert how.write(pieces) == data and how.pieces(data) == pieces
        if not how.fixed:
            longer = how.write([(k, p + "!?".encode(code) if k in TEXTS and p else p) for k, p in pieces])
            assert texts_of(name, how.read(longer)) == [(k, t + "!?") for k, t in expected]


def test_every_layout_is_made_somewhere():
    families = {re.sub(r"_[0-9]$", "", k) for k in e.LAYOUTS}
    assert families == {re.sub(r"_[0-9]$", "", k) for k in blobs.CONTENTS}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_survive(data):
    for layout in e.LAYOUTS.values():
        pieces = layout.pieces(data)
        assert pieces == [("raw", data)] or layout.write(pieces) == data


def test_spark_side(spark):
    data = blobs.counted_aligned(b"who", b"what")
    files = spark.createDataFrame([("a.dat", bytearray(data)), ("b.bin", bytearray(data))], "file string, data binary")
    pieces = e.units(files, "counted_aligned", only=r"\.dat$")
    assert pieces.where("file = 'b.bin'").count() == 1
    found = e.texts(pieces, "counted_aligned")
    assert [r.text for r in found.orderBy("piece_no").collect()] == ["who", "what"]
    done = e.rebuild(e.with_translations(pieces, found.select("file", "piece_no", F.concat("text", F.lit("?")).alias("translated")), "counted_aligned"), "counted_aligned")
    got = {r.file: bytes(r.data) for r in done.collect()}
    assert got == {"a.dat": blobs.counted_aligned(b"who?", b"what?"), "b.bin": data}


def test_codes_round_a_line():
    data = b"\x00%L%VFtext %VR%K%Lplain%K\x01\x0f\x02\0\0one\0\1\2\3\4x\0\0\0two\0\1\2\3\4y\0%L"
    pieces = scripts.typed_separators(data)
    assert [p for p in pieces if p[0] in TEXTS] == [("text", b"text "), ("text", b"plain"), ("select", b"one"), ("select", b"two")]
    assert assemble(pieces) == data


def test_jumps_follow_their_command():
    data = blobs.signed_commands_0(b"n", b"text")
    pieces = e.LAYOUTS["signed_commands_0"].read(data)
    longer = assemble([(k, p + b"more" if k == "text" else p) for k, p in pieces])
    jump = longer.index(b"\x04\0")
    target = int.from_bytes(longer[jump + 2 : jump + 6], "little")
    assert longer[16 + target + 2] == 0x1D


def test_cipher_is_its_own_inverse():
    data = bytes(range(256)) * 3
    assert scripts.stream_cipher(scripts.stream_cipher(data, encrypt=True)) == data


def test_a_registered_layout(spark):
    e.register("test_whole", e.Layout(lambda d: [("text", d)], lambda p: p[0][1]))
    assert e.LAYOUTS["test_whole"].pieces(b"x") == [("text", b"x")]
    del e.LAYOUTS["test_whole"]


def test_workbooks():
    sheets = {"A & b": [["k", "v"], ["é<>", "x\r\n_x000D_"], [], ["", None, "c"]], "2": []}
    got = xlsx.read_workbook(xlsx.write_workbook(sheets))
    assert got == {"A & b": [["k", "v"], ["é<>", "x\r\n_x000D_"], [], ["", "", "c"]], "2": []}
    assert [xlsx.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(xlsx.column_number(xlsx.column_name(n)) == n for n in range(2000))


def test_workbook_files(spark, tmp_path):
    from scriptloom.sources import formats

    table = spark.createDataFrame([("a", "1"), ("b", "")], "Key string, Value string")
    formats.write_xlsx(table, f"{tmp_path}/x.xlsx")
    assert sorted(map(tuple, formats.read_xlsx(spark, f"{tmp_path}/x.xlsx").collect())) == [("a", "1"), ("b", "")]
    with pytest.raises(ValueError, match="too many"):
        formats.write_xlsx(table, f"{tmp_path}/y.xlsx", most=1)
    assert formats.symbol_table("あ") == b"\x42\x30" and '"mapping": "あ"' in formats.tunnel_config("あ", {"tunnel_decoder": {"x": 1}})


def test_packed_bodies():
    body = b"\0\7" + (5).to_bytes(4, "big") + b"hello" + b"\0"
    stored = zlib.compress(body)
    data = bytes(20) + len(body).to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored
    assert [p for k, p in e.LAYOUTS["counted_packed"].read(data) if k == "text"] == [b"hello"]


def test_foreign_tables_and_null_data(spark):
    """A count beyond the file, a table beyond it, and no data at all."""
    huge = (40).to_bytes(4, "little") + (1 << 31).to_bytes(4, "little") + bytes(200)
    assert e.LAYOUTS["pointer_sections"].pieces(huge) == [("raw", huge)]
    df = spark.createDataFrame([("a", None), ("b", bytearray(huge))], "file string, data binary")
    assert [(r.file, r.piece_no, r.kind) for r in e.units(df, "pointer_sections").collect()] == [("b", 0, "raw")]
