import json
import random

import pytest

from scriptloom.llm import chat as c

SCHEMAS = {"t": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x", "y"]}}}}}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, extra int"
RESULTS = "conv_id long, call_id string, turn long, content string"


def run(spark, calls, results):
    return {(r.conv_id, r.call_id): r for r in c.link_calls(spark.createDataFrame([(*x, 0) for x in calls], CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}


def test_link_validate_serialise(spark):
    calls = [
        (1, "a", 0, "t", '{"b":["x"], "a":1}', None), (1, "b", 1, "t", '{"a":0,"c":2}', ["a", "gone"]), (1, "c", 2, "t", "{bad", ["b"]),
        (1, "d", 3, "zz", None, []), (1, "a", 9, "t", '{"a":5}', None), (None, "x", 0, "t", "{}", None), (2, "n", None, "t", '{"a":null}', None),
    ]
    results = [(1, "a", 1, "é\n"), (1, "a", 5, "later"), (1, "o", 4, "orphan"), (2, "n", 1, None), (3, None, 1, "x")]
    got = run(spark, calls, results)
    assert sorted(got) == [(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "o"), (2, "n")]
    a = got[1, "a"]
    assert (a.status, a.valid, a.repeats, a.position) == ("linked", True, 2, 0)
    assert a.json == '{"arguments":{"a":1,"b":["x"]},"call_id":"a","name":"t","result":"é\\n"}'
    assert got[1, "b"].errors == ["$.a: less than 1", "$.c: not allowed"] and got[1, "b"].status == "pending"
    assert got[1, "c"].errors == ["$: not JSON"] and json.loads(got[1, "c"].json)["arguments"] == "{bad"
    assert got[1, "d"].errors == ["unknown tool"] and got[1, "o"].status == "orphan" and not got[1, "o"].valid
    assert got[2, "n"].valid and got[2, "n"].status == "linked"
    assert [k[1] for k, r in sorted(got.items(), key=lambda x: x[1].position) if k[0] == 1] == ["a", "b", "c", "d", "o"]


@pytest.fixture(params=[c.GROUP_EDGES, 0], ids=["groups", "rounds"])
def both_ways(request, monkeypatch):
    """Conversations ordered in a task each, and by rounds of joins."""
    monkeypatch.setattr(c, "GROUP_EDGES", request.param)


@pytest.mark.parametrize("seed", range(2))
def test_order_is_topological(spark, both_ways, seed):
    rng = random.Random(seed)
    n = 14
    order = list(range(n))
    rng.shuffle(order)
    calls = [(7, f"k{i}", rng.randrange(10), "t", '{"a":1}', [f"k{j}" for j in order[: order.index(i)] if rng.random() < 0.3]) for i in range(n)]
    got = run(spark, calls, [])
    place = {r.call_id: r.position for r in got.values()}
    assert sorted(place.values()) == list(range(n))
    assert all(place[d] < place[k] for _, k, _, _, _, deps in calls for d in deps)
    assert all(r.status == "pending" for r in got.values())


def test_cycles_are_marked(spark, both_ways):
    calls = [(1, "a", 0, "t", '{"a":1}', ["b"]), (1, "b", 1, "t", '{"a":1}', ["a"]), (1, "c", 2, "t", '{"a":1}', ["c"]), (1, "d", 3, "t", '{"a":1}', []), (2, "e", 0, "t", '{"a":1}', [])]
    got = run(spark, calls, [(1, "d", 4, "r")])
    assert {k[1]: r.status for k, r in got.items()} == {"a": "cyclic", "b": "cyclic", "c": "cyclic", "d": "linked", "e": "pending"}


def test_empty_and_deep(spark):
    assert run(spark, [], []) == {}
    assert c.canonical({"b": float("nan"), "a": [1.5]}) == '{"a":[1.5],"b":null}'
    assert c.check("t", "[" * 100_000, SCHEMAS)[1] == ["$: not JSON"]


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", ""), (1, 2, "assistant", "x"), (2, 0, "assistant", "y"), (3, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in c.link_calls(*c.from_turns(turns), c.TURN_SCHEMAS).collect()}
    assert {k: r.status for k, r in got.items()} == {(1, "c1.0"): "pending", (1, "c1.1"): "linked", (2, "c2.-1"): "orphan", (3, "c3.0"): "pending"}
    assert got[1, "c1.0"].valid and got[1, "c1.1"].errors == ["$.text: shorter than 1", "$.words: not integer"]
    assert got[3, "c3.0"].errors == ["$.text: not string", "$.words: not integer", "unknown tool"][-1:]


def test_turns_move_and_form_cycles(spark):
    """Three letters need the call two turns later, which needs the one two turns before unless its length mod 3 is 1."""
    texts = {0: "abc", 2: "abcd", 4: "abcdef", 6: "ab"}
    turns = spark.createDataFrame([(1, t, "user", x) for t, x in texts.items()] + [(1, None, "user", "zz")], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in c.link_calls(*c.from_turns(turns), c.TURN_SCHEMAS).collect()}
    assert {k: (r.status, r.position, r.repeats) for k, r in got.items()} == {"c1.0": ("pending", 1, 1), "c1.2": ("pending", 0, 0), "c1.4": ("cyclic", 2, 0), "c1.6": ("cyclic", 3, 0)}
    assert got["c1.6"].errors == [] and json.loads(got["c1.6"].json)["arguments"]["tone"] == "plain"
    assert got["c1.2"].errors == []


def test_a_long_cycle_and_a_long_chain_take_one_pass():
    n = 100_000
    ring = [(f"k{i}", i, [f"k{(i + 1) % n}"]) for i in range(n)]
    assert all(x == (i, 0, True) for i, x in enumerate(c.topological(ring)))
    chain = [(f"k{i}", i, [f"k{i + 1}"]) for i in range(n)]
    assert c.topological(chain) == [(n - 1, n - 1 - i, False) for i in range(n)]


def test_arguments_of_any_text():
    """Lone surrogates stay escapes, nesting beyond what Python can walk is reported and the text is kept."""
    import json

    from scriptloom.llm import chat

    value, found = chat.check("t", '{"a\\ud800":"x\\udfffé"}', {"t": {"additionalProperties": False}})
    assert chat.canonical(value) == '{"a\\ud800":"x\\udfffé"}' and found == ["$.a\\ud800: not allowed"]
    assert all(x.encode() for x in [chat.canonical(value), *found]) and json.loads(chat.canonical(value)) == value
    schema: dict = {"type": "array"}
    schema["items"] = schema
    deep = "[" * 1200 + "]" * 1200
    for name in ("t", "other"):
        value, found = chat.check(name, deep, {"t": schema})
        assert chat.canonical(value) and (value == deep and found == ["$: nested too deep"] or name == "other" and found == ["unknown tool"])
    assert chat.check("t", "[" * 200_000, {"t": schema})[1] == ["$: not JSON"]
