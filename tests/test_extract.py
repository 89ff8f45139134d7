import random
import re

import pytest
from pyspark.sql import functions as F

from scriptloom.config import ExtractConfig, Role, RuleProgram
from scriptloom.operators import dictionary, items, rules, tree
from scriptloom.plans.extract import extract, import_translations, item_translations
from scriptloom.regexes import java_pattern, java_replacement

RULES = """00_skip=^error
10_search=^(?P<name>Name.*)$
20_search=^(?P<pre_name>「.+」)$
21_search=^(?P<pre_nameANDunfinish>「.*)$
25_search=^(.+?)(?<=」|。)$
26_search=^(?P<unfinish>.+?)$
postSkip=^[0-9]
structure=paragraph
"""
LINES = ["Text0", "Name1", "Text1。", "MaybeName2", "「Text2」", "MaybeName3", "「", "Text3", "33text", "Text333", "error", "」"]
GOLDEN = [(None, "Text0"), ("Name1", "Text1。"), ("MaybeName2", "「Text2」"), ("MaybeName3", "「\r\nText3\r\nText333"), (None, "」")]


def texts(spark, rows):
    return spark.createDataFrame(rows, "file string, text string")


@pytest.mark.parametrize("keep", [True, False])
def test_documented_example(spark, keep):
    made = extract(texts(spark, [("a.txt", "\n".join(LINES))]), RULES, ExtractConfig(name_keep_ctrl=keep))
    assert [(r.name, r.message) for r in made.items.orderBy("item").collect()] == GOLDEN


def simulate(lines, program):
    """Line by line, with one live capture, as the rules are documented."""
    config, compiled = program.config, rules._compile(program)
    import re

    post = re.compile(config.post_skip) if config.post_skip else None
    rows, live, interval = [], None, None
    for n, line in enumerate(lines):
        event = rules.search_line(line, compiled, post, frozenset(config.name_list), config.serial_search)
        if event is None:
            continue
        if event[0] == "skip":
            if not config.skip_ignore_unfinish:
                interval = None
                if live:
                    live["keys"].discard("unfinish")
            if not config.skip_ignore_ctrl:
                live = None
            continue
        mine = []
        for _, _, text, role in event[1]:
            if role.interval is not None:
                interval = role.interval or None
            keys = set(role.keys) | ({interval} if interval else set())
            if text:
                mine.append({"line": n, "text": text, "keys": keys, "blocks": role.blocks, "flags": list(role.flags) + (["-unfinish"] if "name" in role.keys else [])})
        for c in mine:
            for op in c["flags"] if live else ():
                if op[0] == "-":
                    live["keys"].discard(op[1:])
                elif not (live["blocks"] and op[1:] in live["blocks"]):
                    live["keys"].add(op[1:])
        rows += mine
        if mine:
            live = mine[-1] if config.name_keep_ctrl or "-unfinish" not in mine[-1]["flags"][-1:] else None
    return [(r["line"], r["text"], tuple(sorted(r["keys"]))) for r in rows]


PROGRAMS = [
    RULES,
    "00_skip=^x\n10_search=^(?P<name>N.*)$\n20_search=^(?P<pre_name>b.*)$\n30_search=^(?P<predel_unfinish>c.*)$\n40_search=^(?P<unfinish>d.*)$\n50_search=^(.+)$\nstructure=para",
    "00_skip=^x\n10_search=^(?P<start_unfinish>s.*)$\n15_search=^(?P<start_name>)t\n16_search=^(?P<end_name>)1\n20_search=^(?P<end_unfinish>e.*)$\n30_search=^(?P<not_nameANDunfinish>n.*)$\n40_search=^(?P<pre_name>b.*)$\n50_search=^(.+)$\nstructure=para",
]


@pytest.mark.parametrize("program", PROGRAMS)
@pytest.mark.parametrize("options", [{}, {"skip_ignore_ctrl": True}, {"skip_ignore_unfinish": True, "name_keep_ctrl": False}])
def test_flags_agree_with_simulation(spark, program, options):
    rng = random.Random(5)
    files = [(f"f{i}", [rng.choice(["x", "N1", "b1", "c1", "d1", "s", "e", "n1", "1", "「", "」", "「a」", "Name", "error", "t。", ""]) for _ in range(25)]) for i in range(12)]
    config = ExtractConfig(**options)
    made = extract(texts(spark, [(f, "\n".join(ls)) for f, ls in files]), program, config).captures.orderBy("file", "line_no", "cap_no").collect()
    parsed = RuleProgram.parse(program, config)
    expected = [(f, *r) for f, ls in sorted(files) for r in simulate(ls, parsed)]
    assert [(r.file, r.line_no, r.text, tuple(sorted(r["keys"]))) for r in made] == expected


def test_roles():
    assert Role.parse("pre_nameANDunfinish2") == Role(keys=("unfinish",), flags=("+name",))
    assert Role.parse("un") == Role(keys=("unfinish",))
    assert Role.parse("skip1").skip
    assert Role.parse("type_a").type == "a" and Role.parse("end_x").interval == "" and Role.parse("prefix") == Role()


def test_rule_text():
    p = RuleProgram.parse("<note\n10_search=a\n20_skip=b\n10_search=c\nflag=serialSearch\nstruct=paragraph\nstartline=3\npreLenOffset=-2\nOldEncodeName=utf-8\n\n30_search=d")
    assert [(r.key, r.pattern) for r in p.rules] == [("10_search", "c"), ("20_skip", "b")]
    assert p.config.serial_search and p.config.structure == "paragraph" and p.config.startline == 3 and p.config.pre_len_offset == -2 and p.config.encoding == "utf-8"
    with pytest.raises(ValueError, match="foo"):
        RuleProgram.parse("foo=1")


def test_native_and_general_matchers_agree(spark):
    program = RuleProgram.parse("00_skip=^#\n10_search=(?P<name>[A-Z]\\w+)\n20_search=^(\\w+)$\npostSkip=^Z")
    rows = [(i, t) for i, t in enumerate(["# no", "Ab cd Ef", "Zed", "word", "", "Zed Ab", "ü é", "１２"])] + [(99, None)]
    df = spark.createDataFrame(rows, "line_no int, line string")
    native = {r.line_no: (r.kind, r.texts) for r in rules.first_match(df, program).where("kind is not null").collect()}
    general = {r.line_no: (r.kind, [c.text for c in r.captures]) for r in rules.events(df, program).collect()}
    assert native == general


def test_only_safe_programs_are_native(spark):
    assert rules.native_form(RuleProgram.parse("10_search=(a)(b)")) is None
    assert java_pattern("(?P<a>x)(?P=a)") is None
    assert java_replacement(r"\1-$") == "$1-\\$"


def test_round_trip_is_the_identity(spark):
    rng = random.Random(3)
    rows = [(f"f{i}", "\r\n".join(rng.choice(LINES + [""]) for _ in range(20))) for i in range(8)]
    df = texts(spark, rows)
    same = extract(df, RULES).captures.select("text").distinct().withColumn("trans", F.array("text"))
    assert {tuple(r) for r in import_translations(df, RULES, same).collect()} == set(rows)


def test_translations_by_occurrence(spark):
    for n in range(1, 5):
        for m in range(0, 5):
            given = [f"t{i}" for i in range(m)]
            left, out = list(given), []
            for _ in range(n):
                out.append("a" if not left else left[0] if len(left) == 1 else left.pop())
            rows = spark.createDataFrame([(i, "a") for i in range(n)], "seq int, text string")
            table = spark.createDataFrame([("a", given)], "text string, trans array<string>")
            got = [r.translated for r in dictionary.occurrence_join(rows, table, ["seq"]).orderBy("seq").collect()]
            assert got == out[::-1], (n, m)


def test_item_translations(spark):
    made = spark.createDataFrame([(0, "N", "a\r\nb"), (1, None, "a")], "item int, name string, message string")
    done = spark.createDataFrame([(0, "M", "x"), (1, None, "y\r\nz")], "item int, trans_name string, trans string")
    got = {r.text: r.trans for r in item_translations(made, done, ["item"]).collect()}
    assert got == {"N": ["M"], "a": ["x", "yz"], "b": ["　"]}


def test_sessions_without_rows(spark):
    df = spark.createDataFrame([], "f string, n int, text string, k boolean")
    assert items.items(df, F.col("k"), F.col("k"), ["f"], ["n"]).count() == 0


def test_zip_needs_equal_lengths(spark):
    a, b = spark.range(3).withColumn("t", F.lit("x")), spark.range(4).withColumn("t", F.lit("y"))
    with pytest.raises(Exception, match="differ in length"):
        dictionary.positional_zip(a, b, ["id"], ["id"], "t", "t").collect()


def test_brackets_of_any_depth():
    from scriptloom.operators.dialogue import nested_parts

    part = lambda t, **k: [t[a:b] for a, b in nested_parts(t, **k)]
    assert part("ab[c[d]e]fgh[i]") == ["ab", "c[d]e", "fgh", "i"]
    assert part("ab[c]x") == ["ab", "c", "x"] and part("ab[c]xy") == ["ab", "c", "xy"]
    assert part("ab[c]]de[f") == ["ab", "c", "]de", "[f"]
    assert part("ab[ruby x]cd[np]", keep=re.compile("^ruby")) == ["ab[ruby x]cd", "np"]
    assert part("a[b]", with_brackets=True) == ["a", "[b]"] and part("") == []


def test_byte_rules():
    """Lengths in front, checks and decoding, unit by unit."""
    def run(data, text):
        program = RuleProgram.parse(text)
        compiled = [(r.kind, re.compile(r.pattern.encode(program.config.encoding), re.DOTALL), r.roles()) for r in program.rules if r.kind]
        event = rules.search_unit(data, compiled, program)
        return event and (event[0], [(c[0], c[1], c[2], c[4], c[5]) for c in event[1]])

    rule = "OldEncodeName=utf-8\npreLen=2\npreLenStrict=true\npreLenScale=2\npreLenAdd=-1\n10_search=#..(.)"
    assert run(b"-#\x03\0hello#\x01\0x", rule) == ("match", [(4, 9, "hello", 2, 3), (12, 13, "x", 10, 1)])
    assert run(b"#\xff\0h", rule) is None
    assert run(b"\x02\0ab", "OldEncodeName=utf-8\npreLen=1\npreLenOffset=start\n10_search=[\\x02].(a)") == ("match", [(2, 3, "a", 0, 2)])
    assert run(b"abc", "00_skip=b\n10_search=(c)") == ("skip", [])
    assert run("あa".encode("cp932"), "checkJIS=a\n10_search=^(.+)$") == ("match", [(0, 3, "あa", -1, -1)])
    assert run("あb".encode("cp932"), "checkJIS=a\n10_search=^(.+)$") is None
    with pytest.raises(UnicodeDecodeError):
        run(b"\xff", "OldEncodeName=utf-8\n10_search=(.)")


def test_blocks():
    from scriptloom.operators.dialogue import block_captures

    text = 'x = {\n"not yet"\n[1] = {\n{\nname={"en"},\nname="Ann",\n"line one",\n{"rt2"},\n"line two",\n},\n},\n"after"\n[2]\nname={en="A", ja="B"},'
    got = [(n, c[0][2], c[0][3].keys) for n, _, c in block_captures(text)]
    assert got == [(5, "Ann", ("name",)), (6, "line one", ("unfinish",)), (8, "line two", ()), (13, "B", ("name",))]


def test_block_braces():
    """Braces in quotes don't count, text behind a closed block is outside, two blocks follow each other."""
    from scriptloom.operators.dialogue import block_captures

    text = 'x\n[1] = {\n{\n"a } } b",\n},\n},\n"outside"\n[2] = {\n"c",\n{"/x"},\n{"rt2"},\n},\nname="no"'
    assert [(n, c[0][2], c[0][3].keys) for n, _, c in block_captures(text)] == [(3, "a } } b", ()), (8, "c", ("unfinish",))]
    assert list(block_captures("")) == [] and list(block_captures('[1]\n"x"')) == []


def test_trees_of_any_text(spark):
    """Lone surrogates become question marks, deep trees lose no leaf, JSON inside strings is opened at any depth."""
    import json

    deep = "[" * 300 + '"low"' + "]" * 300
    inside = json.dumps({"a": json.dumps({"b": json.dumps(["x", ""])})})
    df = spark.createDataFrame([(1, '{"t":"a\\ud800b"}'), (2, deep), (3, inside), (4, None), (5, "{"), (6, '"top"')], "n int, j string")
    got = {(r.n, r.text, len(r.path)) for r in tree.leaves(df, "j").collect()}
    assert got == {(1, "a?b", 1), (2, "low", 300), (3, "x", 3), (6, "top", 0)}
    changed = df.withColumn("c", F.array(F.struct(F.lit(0).alias("leaf_no"), F.lit("new").alias("text"))))
    back = {r.n: r.j for r in tree.replace_leaves(changed, "j", "c").collect()}
    assert back[2] == deep.replace("low", "new") and back[4] is None and back[5] == "{" and json.loads(json.loads(back[3])["a"])["b"] == '["new",""]'
    codes = {r.code: (r.extract, r.breaks) for r in tree.event_codes(spark).collect()}
    assert codes[101] == (True, True) and codes[401] == (True, False) and codes[0] == (False, True) and len(codes) == 116


@pytest.mark.parametrize("line", ["twoLineFlag=ab", "flag=keepFormat", "engineName=X", "dynamicReplace=x"])
def test_options_of_single_steps_are_told(line):
    with pytest.raises(ValueError, match="argument of"):
        RuleProgram.parse(line)
