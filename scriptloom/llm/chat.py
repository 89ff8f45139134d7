"""Tool calls of conversations: linked to their results, put in topological order, validated, written as canonical JSON.

Calls and results are hash-joined by (conversation, call id). Dependencies are edges between calls; a call's place is its
own turn unless a dependency stands later, in which case it moves behind that. Calls of a conversation, without their texts,
come to one task sorted by conversation, and are ordered there in one pass over their edges, cycles included. A conversation
of more than ``GROUP_EDGES`` calls and dependencies isn't gathered: its places are settled by rounds of one join each.
Positions come from ranks over ranges of turns. Arguments are validated and serialised row by row in Arrow batches; JSON is
one line for each call, never a whole conversation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import ranks
from ._spark import bounded_batches, discard, materialise
from .mixing import count_tokens

#: Turns ranked together.
TURNS = 1024
#: Calls and dependencies of a conversation that one task orders, at most.
GROUP_EDGES = 1 << 18

_KINDS = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a JSON schema: type, enum, minLength, minimum, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: shorter than {schema['minLength']}")
    if _KINDS["number"](value) and value < schema.get("minimum", -math.inf):
        out.append(f"{at}: less than {schema['minimum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, characters beyond ASCII as they are, but lone surrogates, which UTF-8 lacks, as escapes; NaN
    and infinities become null."""
    try:
        return escaped(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))
    except ValueError:
        return canonical(_finite(value))


def escaped(text: str) -> str:
    """Lone surrogates as JSON escapes them."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(v):
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_finite(x) for x in v]
    return None if isinstance(v, float) and not math.isfinite(v) else v


def check(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[object, list[str]]:
    """Parsed arguments (the text itself where it is no JSON or nested too deep; null for none) and what is wrong with the call."""
    try:
        value = None if arguments is None else json.loads(arguments)
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]
    try:
        canonical(value)
        found = violations(value, schemas[name]) if name in schemas else ["unknown tool"]
    except RecursionError:
        return arguments, ["$: nested too deep"]
    return value, [escaped(x) for x in found]


def topological(calls: list[tuple[str, int, list[str]]]) -> list[tuple[int, int, bool]]:
    """``place, level, cyclic`` of each ``(call id, turn, needed ids)`` of one conversation; ids don't repeat.

    A call's (place, level) is its own (turn, 0), or just behind the last of its dependencies, (place, level + 1) of that,
    where this comes later. Calls in a cycle, or behind one, keep their turn and are marked. Unknown ids are ignored.
    """
    at = {c: k for k, (c, _, _) in enumerate(calls)}
    needs = [{at[n] for n in ids or () if n in at} for _, _, ids in calls]
    found = [(turn, 0, False) for _, turn, _ in calls]
    if all(calls[n][1] < turn for (_, turn, _), some in zip(calls, needs, strict=True) for n in some):
        return found
    behind: list[list[int]] = [[] for _ in calls]
    for k, some in enumerate(needs):
        for n in some:
            behind[n].append(k)
    open_, ready = [len(some) for some in needs], [k for k, some in enumerate(needs) if not some]
    while ready:
        n = ready.pop()
        for k in behind[n]:
            found[k] = max(found[k], (found[n][0], found[n][1] + 1, False))
            open_[k] -= 1
            if not open_[k]:
                ready.append(k)
    return [(turn, 0, True) if left else f for f, left, (_, turn, _) in zip(found, open_, calls, strict=True)]


_SETTLED = "conv_id long, call_id string, place long, level int, cyclic boolean"


def _settle_groups(calls: DataFrame) -> DataFrame:
    """Places of conversations that a task can hold, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(conv: int, rows: list) -> list[tuple]:
            return [(conv, row[0], *place) for row, place in zip(rows, topological(rows), strict=True)]

        def packed(out: list) -> pa.RecordBatch:
            columns, kinds = list(zip(*out, strict=True)), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "call_id", "place", "level", "cyclic"])

        now, rows, out = None, [], []
        for batch in batches:
            for conv, *row in zip(*(batch[c].to_pylist() for c in ("conv_id", "call_id", "turn", "depends_on")), strict=True):
                if conv != now:
                    out += settled(now, rows)
                    now, rows = conv, []
                rows.append(tuple(row))
            if len(out) >= 4096:
                yield packed(out)
                out = []
        if out := out + settled(now, rows):
            yield packed(out)

    grouped = calls.select("conv_id", "call_id", "turn", "depends_on").repartition("conv_id").sortWithinPartitions("conv_id")
    return grouped.mapInArrow(run, _SETTLED)


def _settle(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, place, level, cyclic`` of all calls."""
    sizes = calls.groupBy("conv_id").agg(F.sum(F.greatest(F.size("depends_on"), F.lit(0)) + 1).alias("size"))
    large = materialise(sizes.where(F.col("size") > GROUP_EDGES).select("conv_id"), "large")
    if not large.limit(1).count():
        return _settle_groups(calls)
    return _settle_groups(calls.join(large, "conv_id", "left_anti")).unionByName(_settle_rounds(calls.join(large, "conv_id", "left_semi")))


def _settle_rounds(calls: DataFrame) -> DataFrame:
    """Places of conversations of any size; as many rounds as the longest chain of calls that move.

    A level above the number of calls of the conversation proves that a call is in a cycle or behind one. Levels rise to
    twice that number, so that every call of a cycle gets there.
    """
    edges = calls.select("conv_id", "call_id", F.explode("depends_on").alias("needs")).where("needs is not null").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = materialise(edges.join(known, ["conv_id", "needs"]), "edges")
    sizes = calls.groupBy("conv_id").agg(F.count("*").alias("size"))
    # only conversations in which a dependency doesn't stand before its call can move at all
    turn = calls.select("conv_id", "call_id", "turn")
    late = edges.join(turn, ["conv_id", "call_id"]).join(turn.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn")), ["conv_id", "needs"])
    moving = materialise(late.where("needs_turn >= turn").select("conv_id").distinct(), "moving")
    own = calls.join(moving, "conv_id", "left_semi").join(sizes, "conv_id")
    now = materialise(own.select("conv_id", "call_id", "turn", "size", F.struct(F.col("turn").alias("place"), F.lit(0).alias("level")).alias("at")), "places")
    while now.where("at.level <= 2 * size").limit(1).count():
        last = edges.join(now.select("conv_id", F.col("call_id").alias("needs"), "at", "size"), ["conv_id", "needs"]).where("at.level <= 2 * size")
        last = last.groupBy("conv_id", "call_id").agg(F.max(F.struct(F.col("at.place").alias("place"), (F.col("at.level") + 1).alias("level"))).alias("behind"))
        joined = now.join(last, ["conv_id", "call_id"], "left")
        after = joined.select("conv_id", "call_id", "turn", "size", F.greatest("at", F.coalesce("behind", "at")).alias("at"), (F.coalesce("behind", "at") > F.col("at")).alias("moved"))
        after = materialise(after, "places")
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after.drop("moved")
        if not moved:
            break
    cyclic = F.col("at.level") > F.col("size")
    found = now.select("conv_id", "call_id", F.when(cyclic, F.col("turn")).otherwise(F.col("at.place")).alias("place"), F.when(cyclic, 0).otherwise(F.col("at.level")).alias("level"), cyclic.alias("cyclic"))
    still = calls.join(moving, "conv_id", "left_anti").select("conv_id", "call_id", F.col("turn").alias("place"), F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    return found.unionByName(still)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and each result without a call.

    ``calls``: ``conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>``;
    ``results``: ``conv_id long, call_id string, turn long, content string``. Out come ``conv_id, call_id, turn, position
    long, status string, valid boolean, errors array<string>, repeats long, json string``.

    ``status`` is ``linked``, ``pending`` (no result), ``orphan`` (no call) or ``cyclic`` (in a cycle of dependencies or behind one). ``position`` counts from 0 in
    the conversation; ties of place and level go by turn, then id. Of calls, or results, that repeat an id the first by
    (turn, content) counts and ``repeats`` says how many more there were. Dependencies on unknown calls are ignored. Rows whose
    conversation or id is null can't be linked and are left out; a null turn counts as 0, a null result is written as null. Only valid calls
    have no errors; an orphan is not valid. Empty tables give an empty result. Other columns are ignored.
    """
    bounded_batches(calls.sparkSession)
    calls = calls.where("conv_id is not null and call_id is not null").withColumn("turn", F.coalesce("turn", F.lit(0)).cast("long"))
    results = results.where("conv_id is not null and call_id is not null").withColumn("turn", F.coalesce("turn", F.lit(0)).cast("long"))
    calls = calls.groupBy(F.col("conv_id").cast("long").alias("conv_id"), "call_id").agg(F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("c"), (F.count("*") - 1).alias("more"))
    calls = materialise(calls.select("conv_id", "call_id", "c.*", "more"), "calls")
    results = results.groupBy(F.col("conv_id").cast("long").alias("conv_id"), "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), (F.count("*") - 1).alias("more_results"))
    both = calls.join(_settle(calls), ["conv_id", "call_id"]).join(results, ["conv_id", "call_id"], "full_outer")
    both = both.select(
        "conv_id", "call_id", F.coalesce("turn", "r.turn").alias("turn"), F.coalesce("place", "r.turn").alias("place"), F.coalesce("level", F.lit(0)).alias("level"),
        F.when(F.col("place").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.col("r").isNull(), "pending").otherwise("linked").alias("status"),
        (F.coalesce("more", F.lit(0)) + F.coalesce("more_results", F.lit(0))).alias("repeats"), "name", "arguments", F.col("r.content").alias("content"),
    )
    both = both.withColumn("part", F.floor(F.col("place") / TURNS))
    placed = ranks(both, ["conv_id"], "part", ["place", "level", "turn", "call_id"], "position")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, lines = [], [], []
            for call_id, status, name, arguments, content in zip(*(batch[c].to_pylist() for c in ("call_id", "status", "name", "arguments", "content")), strict=True):
                line = {"call_id": call_id, "result": content}
                wrong = ["no call"]
                if status != "orphan":
                    line["arguments"], wrong = check(name, arguments, schemas)
                    line["name"] = name
                valid.append(not wrong)
                errors.append(wrong)
                lines.append(canonical(line))
            columns = {n: batch[n] for n in ("conv_id", "call_id", "turn", "position", "status")}
            columns |= {"valid": pa.array(valid, pa.bool_()), "errors": pa.array(errors, pa.list_(pa.string())), "repeats": batch["repeats"], "json": pa.array(lines, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return placed.select("conv_id", "call_id", "turn", "position", "status", "repeats", "name", "arguments", "content").mapInArrow(
        write, "conv_id long, call_id string, turn long, position long, status string, valid boolean, errors array<string>, repeats long, json string"
    )


_ARGUMENTS = {
    "type": "object", "required": ["text", "turn", "words"], "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer"}, "tone": {"type": "string", "enum": ["plain"]}},
}
#: Tools of the turns of plain conversations: see :func:`from_turns`.
TURN_SCHEMAS = {"ask": _ARGUMENTS, "configure": _ARGUMENTS}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results made of ``conv_id, turn, role, text`` rows, so that tables of plain turns exercise every rule.

    A user or system turn calls a tool (``ask``, ``configure``); other roles but the assistant call one of their own name,
    which no schema knows. An assistant turn is the result of the call one turn before. With n the characters of the text:
    a call needs the one a turn before; unless n mod 3 is 1 the one two turns before; and if n mod 3 is 0 the one two turns
    later, behind which it moves, or with which it is a cycle if that one needs it. ``words`` is text instead of a number if
    n mod 5 is 0. The optional ``tone`` is there in every fourth turn, and ``loud``, which isn't allowed, if n is odd.
    A null turn counts as 0.
    """
    turn, n = F.coalesce(F.col("turn"), F.lit(0)).cast("long"), F.coalesce(F.length("text"), F.lit(0))
    call_id = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("long"), F.lit("."), turn - back)
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    words = count_tokens(F.col("text"))
    tone = F.when(n % 2 == 0, "plain").otherwise("loud").alias("tone")

    def arguments(text_words: bool, with_tone: bool):
        fields = ["text", *([tone] if with_tone else []), turn.alias("turn"), (words.cast("string") if text_words else words).alias("words")]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    by_tone = lambda text_words: F.when(turn % 4 == 2, arguments(text_words, True)).otherwise(arguments(text_words, False))
    needs = F.array(call_id(1), F.when(n % 3 != 1, call_id(2)), F.when(n % 3 == 0, call_id(-2)))
    calls = turns.where(~assistant).select(
        F.col("conv_id").cast("long").alias("conv_id"), call_id(0).alias("call_id"), turn.alias("turn"),
        F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "configure").otherwise(F.col("role")).alias("name"),
        F.when(n % 5 == 0, by_tone(True)).otherwise(by_tone(False)).alias("arguments"), F.array_compact(needs).alias("depends_on"),
    )
    results = turns.where(assistant).select(F.col("conv_id").cast("long").alias("conv_id"), call_id(1).alias("call_id"), turn.alias("turn"), F.col("text").alias("content"))
    return calls, results
