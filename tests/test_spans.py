import re
from random import Random

import pytest
from pyspark.sql import functions as F

from scriptloom.config import RuleProgram
from scriptloom.operators import rules
from scriptloom.regexes import required_literal, segments


def test_segments():
    assert segments("^(a+)b(?:c|d)(?P<name>[)(|]x)$") == [("^", False), ("(a+)", True), ("b(?:c|d)", False), ("(?P<name>[)(|]x)", True), ("$", False)]
    assert segments(r"(\(a\))\|(b)") == [(r"(\(a\))", True), (r"\|", False), ("(b)", True)]
    for pattern in ("(a)|(b)", "((a)b)", "(a)?b", "(a)+", "(a)\\1", "(?i)(a)", "(a*)", "(?:x(a))", "(a){2}"):
        assert segments(pattern) is None, pattern
    assert required_literal("^(Ann: )(.+)$") == "Ann: " and required_literal("(?i)abc") == "" and required_literal("a|b") == ""
    assert required_literal("x+(?:foo)bar[0-9]z") == "foobar" and required_literal("(?i:foo)b") == "b"


PROGRAMS = [
    "10_search=^(?P<name>[A-Z]+): (.+)$",
    "00_skip=^#\n10_search=(?P<pre_name>[a-c]+)=(?P<unfinish>[0-9]*);\n20_search=([A-Z])([a-z])",
    "10_search=([a-z])[0-9](?P<skip1>[a-z])([0-9]?)\npostSkip=^b",
    "10_search=\\b([A-Z][a-z]+)\\b",
    "10_search=(?<=[a-z])([0-9]+)(日|b)\n20_search=(é+)",
    "10_search=(x)(y*)(z)",
]


@pytest.mark.parametrize("text", PROGRAMS)
def test_native_places_like_python(spark, text):
    """Captures and their places, against Python's own matcher line by line; lines of any length and characters."""
    rnd = Random(5)
    alphabet = ["a", "b", "x", "y", "z", "A", "Ann", "=", "1", "22", ";", ": ", "#", "é", "日", "𝄞", "\n", " "]
    lines = [None, "", "#a=1;", "Ann: 日本 = b", "𝄞Ab", "ab" * 700 + "Zz"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(150)]
    program = RuleProgram.parse(text)
    df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(lines)], "line_no int, line string, _hit int")
    found = rules.events(df, program, native=True)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString() and found.columns == ["line_no", "_hit", "kind", "captures"]
    got = {r.line_no: (r.kind, [(c.start, c.end, c.text, tuple(c["keys"]), tuple(c.flags), c.type, c.blocks) for c in r.captures]) for r in found.collect()}
    compiled, post = rules._compile(program), re.compile(program.config.post_skip) if program.config.post_skip else None
    for k, line in enumerate(lines):
        event = None if line is None else rules.search_line(line, compiled, post, frozenset(), False)
        expected = event and (event[0], [(s, e, t, r.keys, r.flags, r.type, r.blocks) for s, e, t, r in event[1]])
        assert got.get(k) == expected, line


def test_parts_of_lines_and_names(spark):
    program = RuleProgram.parse("10_search=([a-z])")
    program = RuleProgram(program.rules, program.config.__class__(name_list=("b",)))
    df = spark.createDataFrame([("xabcx", 1, 4), ("abc", 0, None), ("a", 5, 9)], "line string, search_start int, search_end int")
    for native in (True, False):
        found = rules.events(df, program, native=native).collect()
        assert [[(c.start, c.text, c["keys"]) for c in r.captures] for r in found] == [[(1, "a", []), (2, "b", ["name"]), (3, "c", [])], [(0, "a", []), (1, "b", ["name"]), (2, "c", [])]]


def test_only_lines_with_a_needed_literal_reach_python(spark):
    """Rules that need Python's matcher: an optional group, and an interval."""
    program = RuleProgram.parse("10_search=key(?P<name>a)?(b)\n20_search=begin(?P<start_x>.*)")
    df = spark.createDataFrame([("keyb",), ("key",), ("none",), ("begin",), (None,)], "line string")
    found = rules.events(df, program)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Contains" in plan
    assert sorted((r.kind, len(r.captures)) for r in found.collect()) == [("match", 1), ("match", 1)]
    assert rules.events(df, RuleProgram.parse("10_search=(a)?b")).count() == 0
    assert str(rules.needs(F.col("x"), RuleProgram.parse("10_search=(.)"))) == str(F.lit(True))
