"""Queries over small tables made here: results that the given tables don't show, and steps that must stay bounded."""

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptloom.plans.queries import QUERIES, SQL

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder, texts):
    made(spark, folder, "documents", [(n, t, "en", "web", len(t)) for n, t in enumerate(texts)], DOCUMENTS)


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for table in tables:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, expected = QUERIES[name](spark, str(folder)), con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    rows = sorted(str(tuple(r)) for r in got.select(*columns).collect())
    assert rows == sorted(map(str, expected.fetchall()))
    return len(rows)


def test_utf8_is_not_read_as_cp932(spark, tmp_path):
    """The bytes of ä and a kana read as two-byte characters by chance; a Greek line has such characters, but not the kana."""
    documents(spark, tmp_path, ["Und gäuf.", "Iäuer äou.\nplain", "αβγ", "", "a\r\nno digits 1"])
    assert same_as_sql(spark, tmp_path, "two_byte_check", "documents") == 2


def test_event_codes_have_labels(spark, tmp_path):
    made(spark, tmp_path, "events", [(n, "click") for n in range(10)], "event_id long, event_type string")
    assert same_as_sql(spark, tmp_path, "event_code_table", "events") == 6
    assert {r.label for r in QUERIES["event_code_table"](spark, str(tmp_path)).collect()} == {"Show Text Attributes", "Show Text", "Change Actor Name"}


@pytest.mark.parametrize("pattern", ["([.,])", "[.,]", "(a)|(b)", r"(\d)\s*([,;])?", r"(\d*)"])
def test_units_cut_as_python_does(spark, pattern):
    """Separators become units without Python workers, unless the pattern may match nothing."""
    import re

    from scriptloom.sources.text import units

    texts = ["", ".", "a.b,c", "..", "1, 2;3x", "ab\n,b", None] + ["word. " * 500] * 200
    found = units(spark.createDataFrame(list(enumerate(texts)), "n int, text string"), pattern)
    assert ("MapInArrow" in found._jdf.queryExecution().toString()) == (pattern == r"(\d*)")
    got = sorted((r.n, r.line_no, r.line) for r in found.collect())
    assert got == [(n, k, x or "") for n, t in enumerate(texts) if t is not None for k, x in enumerate(re.split(pattern, t))]


def test_slots_measure_characters_once(spark):
    """The same parts as a plain loop over characters gives, with letters that the widths are written in, brackets, and more slots."""
    import random

    from scriptloom.functions import folds

    def plain(text, rooms):
        parts = []
        for room in rooms[:-1]:
            used = depth = fits = cut = 0
            over = False
            for c in text[: room + 1]:
                used += 2 if c in folds._wide("cp932") else 1
                if over := over or used > room:
                    break
                depth += (c == "「") - (c == "」")
                fits += 1
                cut = fits if depth <= 0 and c in folds.PUNCTUATION else cut
            at = cut if over and cut else fits
            parts, text = [*parts, text[:at]], text[at:]
        return [*parts, text]

    draw = random.Random(1)
    texts = ["", "W" * 9, "wW" * 5, None] + ["".join(draw.choices("Wwa 「」。、あéÄ\n", k=draw.randrange(30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r.n: r.p for r in df.select("n", folds.parts_for_slots(F.col("t"), [7, 5, 9]).alias("p")).collect()}
    assert got == {n: None if t is None else plain(t, [7, 5, 9]) for n, t in enumerate(texts)}
    # the table of wide characters is searched once a slot, not for each character
    translations = str(df.select(folds.parts_for_slots(F.col("t"), [7, 5]).alias("p"))._jdf.queryExecution().analyzed().toString()).count("translate(")
    assert translations == 1


def test_tunnel_looks_characters_up(spark):
    """The same bytes and texts as the native form, what has no code or is no character null."""
    from scriptloom.functions import codepage
    from scriptloom.operators import tunnel

    codes = {"é": b"\x81\x01", "ä": b"\x81\x02"}
    rows = [(1, "aéあ漢ｱ\x7f"), (2, "ö"), (3, ""), (4, None), (5, "Ω～－x" * 200)]
    df = spark.createDataFrame(rows, "n int, t string").withColumn("b", codepage.encoded(F.col("t"), "cp932", codes))
    extra = spark.createDataFrame([(6, None, b"\x81"), (7, None, b"\xfd\xff"), (8, None, b"\x81\x02a\x80")], "n int, t string, b binary")
    df = df.unionByName(extra)
    sent, back = tunnel.tunnel_encoded(F.col("t"), codes), tunnel.tunnel_decoded(F.col("b"), codes)
    found = df.select("b", codepage.decoded(F.col("b"), "cp932", codes).alias("t"), sent.alias("sent"), back.alias("back"), "n")
    assert "ArrowEvalPython" in found._jdf.queryExecution().toString()
    got = found.collect()
    assert all(r.t == r.back and (r.n > 5 or r.b == r.sent) for r in got) and sum(r.back is None for r in got) == 4


def test_workbooks_are_bounded(spark, tmp_path):
    """A table of any size takes as many workbooks as it needs."""
    made(spark, tmp_path, "conversations", [(n, 0, "user", f"text {n}") for n in range(3000)], "conv_id long, turn long, role string, text string")
    assert same_as_sql(spark, tmp_path, "format12_file", "conversations") == 3000
    from scriptloom.sources import tables

    volumes = tables.volumes(spark.range(3000).coalesce(1).select(F.col("id").cast("string")), "a")
    sizes = volumes.groupBy("file").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) <= tables.VOLUME_ROWS


def test_workers_take_slices(spark):
    """Whatever the batch, pieces and spans stand in a worker for a few rows at a time."""
    from scriptloom.operators import splice
    from scriptloom.plans import blobs
    from scriptloom.sources import engines

    files = spark.range(1, 1001, 1, 1).select(F.col("id").cast("string").alias("file"), blobs.blob("length_macros", F.lit("n"), F.lit("t")).alias("data"))
    rows = files.select(F.col("file"), F.lit("ab\ncd").alias("text"))
    spans = rows.select("file", F.lit(1).alias("line_no"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("X").alias("translated"))
    assert engines.units(files, "length_macros").count() == 4000
    assert splice.splice_texts(rows, spans, "file").where("text = 'ab\nXd'").count() == 1000
    assert engines.SLICE_ROWS < 1000 and splice.SLICE_ROWS < 1000


def test_files_side_by_side(spark):
    """Files without a group each, null ones and one across batches included."""
    from scriptloom.operators import sequences

    rows = [(f, n, "a" if n // 4 % 2 else "", f"「{n}" if n % 5 == 0 else None if n % 7 == 0 else f"{n}」") for f in (None, "x", "y") for n in range(3000 if f == "x" else 5)]
    df = spark.createDataFrame(rows, "f string, n int, s string, t string")
    made = sequences.merge_speaker_lines(df, "f", "n", "s", "t")
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    got = made.orderBy("file", "first").collect()
    assert [(r.first, r.n_parts, r.name, r.message) for r in got if r.file is None] == [(0, 2, None, "「0\r\n1」"), (2, 2, None, "2」\r\n3」"), (4, 1, "a", "4」")]
    assert all(sum(r.n_parts for r in got if r.file == f) == n for f, n in ((None, 5), ("x", 3000), ("y", 5)))


def test_learned_names_moves_each_text_once(spark, tmp_path):
    """Texts go to the row before them; in the second order stand only those that define something."""
    from scriptloom.operators import scan

    df = spark.createDataFrame([(n, "v" if n % 2 else None, "D" if n == 1 else "line") for n in range(6)], "n int, v string, line string")
    seen, before = [], scan.written
    scan.written = lambda df, tag: seen.append(df.columns) or before(df, tag)
    try:
        got = scan.learned_names(df, "v", F.col("line") == "D", F.col("line"), ["n"], keep=["n", "v"]).orderBy("n").collect()
    finally:
        scan.written = before
    assert [r.learned for r in got] == [None, None, None, "line", None, "line"]
    assert not any("line" in columns for columns in seen) and len(seen) == 2


def test_separator_import_moves_changed_spans_alone(spark, tmp_path):
    """Ids that repeat or are missing, null and empty texts as in SQL; units are neither sorted by file nor gathered to texts."""
    texts = ["", ".", "a.b,c.", "no stops", None, "..\r\n,.\n", "a. b." * 300]
    rows = [(n, t, "en", "web", 0) for n, t in enumerate(texts)] + [(1, "x.y", "en", "web", 0), (1, "x.y", "en", "web", 0), (None, ".z", "en", "web", 0)]
    made(spark, tmp_path, "documents", rows, DOCUMENTS)
    assert same_as_sql(spark, tmp_path, "separator_import", "documents") == len(rows)
    plan = QUERIES["separator_import"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Aggregate") == 1


@pytest.mark.parametrize(("rule", "names"), [("([.,])", False), (r"(\d)\s*([,;])?", True), ("[|]", False)])
def test_import_of_units_by_a_plain_loop(spark, rule, names):
    """Values by occurrence, names and ignored captures left out, units before the start line as they were."""
    import re

    from scriptloom.plans.extract import import_translations

    texts = ["ab.cd,ab", "ab1 ,cd2;ab", "ab|cd|ab|xx", "", "zz.ab"]
    program = f"separate={rule}\nstartline=1\nimportNames={str(names).lower()}\n05_skip=^zz\n10_search=^(?P<name>cd)$\n20_search=^(?P<ignore>xx)$\n30_search=^(\\D+)$"
    trans = spark.createDataFrame([("ab", ["one", "two"]), ("cd", ["name"]), ("xx", ["no"])], "text string, trans array<string>")
    cut = [[p or "" for p in re.split(rule, t)] for t in texts]
    left = sum(p == "ab" for parts in cut for p in parts[1:])
    expected = []
    for parts in cut:
        done = parts[:1]
        for p in parts[1:]:
            if p == "ab":
                done.append("two" if left == 1 else "one")
                left -= 1
            else:
                done.append("name" if p == "cd" and names else p)
        expected.append(("" if rule[0] == "(" else rule).join(done))
    got = import_translations(spark.createDataFrame(list(enumerate(texts)), "file int, text string"), program, trans)
    assert [r.text for r in got.orderBy("file").collect()] == expected
