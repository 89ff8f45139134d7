"""The ordered rule program over lines: skip rules, search rules, first match wins (survey P3 to P14).

Physical forms of the same program. Where every search rule has one group, patterns are safe in Java, and nobody asks for positions,
it is one native expression: a chain of conditions that stops at the first rule with an accepted capture (:func:`first_match`).
With positions it runs in Arrow batches with Python's own matcher, but only on lines that have a literal which some rule
needs. On demand positions are native too, where patterns are sequences of parts (:func:`..regexes.segments`): every part is
made a group, and so is the gap before a match, so that places are sums of lengths. Lines are independent in all forms: no
shuffle, no order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Role, RuleProgram
from ..functions.charset import is_shift_jis
from ..regexes import java_pattern, required_literal, segments
from ..shared import fresh, slices

CAPTURE = "struct<start:int,end:int,text:string,keys:array<string>,flags:array<string>,type:string,blocks:string,interval:string>"
#: kind is 'skip' or 'match'; lines without a match have no row.
EVENT = f"kind string, captures array<{CAPTURE}>"


def search_line(line: str, compiled: list, post_skip, names: frozenset[str], serial: bool) -> tuple[str, list] | None:
    """The event of one line: ``("skip", [])``, ``("match", captures)`` or None.

    Captures come with their places and roles; empty ones only if they start or end an interval."""
    for kind, pattern, roles in compiled:
        if kind == "skip":
            if pattern.search(line):
                return "skip", []
            continue
        found: dict[int, tuple] = {}
        accepted = False
        for match in _matches(pattern, line, serial):
            for i, role in enumerate(roles, 1):
                text = match.group(i)
                if text is None or role.skip or (post_skip and post_skip.search(text)):
                    continue
                if text in names:
                    role = Role(keys=("name",))
                accepted = True
                found[match.start(i)] = (match.start(i), match.end(i), text, role)
        if accepted:
            # an empty capture isn't one, but an interval that it starts or ends holds
            return "match", [c for c in found.values() if c[2] != "" or c[3].interval is not None]
    return None


def _matches(pattern: re.Pattern, line: str, serial: bool) -> Iterator[re.Match]:
    if not serial:
        yield from pattern.finditer(line)
        return
    at = 0
    while at <= len(line) and (match := pattern.search(line, at)):
        yield match
        at = match.end() if match.end() > match.start() else match.end() + 1


_SPAN = ("search_start", "search_end")


def _compile(program: RuleProgram) -> list:
    return [(r.kind, re.compile(r.pattern), r.roles()) for r in program.rules if r.kind]


def events(lines: DataFrame, program: RuleProgram, line_col: str = "line", native: bool = False) -> DataFrame:
    """``lines`` without those that match nothing, plus ``kind`` and ``captures`` with positions. Null lines match nothing.

    ``native`` asks for the form without Python workers, where the program has one: the same events, at two to three times the
    CPU time (its fold over matches is interpreted), so it is for sessions that mustn't start them.

    Where ``lines`` has ``search_start`` and ``search_end``, rules see only that part of a line; positions are the line's.
    """
    config, others = program.config, [c for c in lines.columns if c != line_col]
    names, part_only = frozenset(config.name_list), set(_SPAN) <= set(lines.columns)
    event = _native_events(F.col(line_col), program, part_only) if native else None
    if event is not None:
        hit, = fresh(lines, "_hit")
        found = _from_start(lines, config).withColumn(hit, event).where(F.col(hit).isNotNull())
        return found.select(*others, F.col(hit)["kind"].alias("kind"), F.col(hit)["captures"].alias("captures"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compile(program)
        post_skip = re.compile(config.post_skip) if config.post_skip else None
        for batch in batches:
            kinds, captures, keep = [], [], []
            spans = zip(*(batch[c].to_pylist() for c in _SPAN), strict=True) if part_only else repeat((0, None))
            for at, (line, (low, high)) in enumerate(zip(batch[line_col].to_pylist(), spans, strict=False)):
                event = None if line is None else search_line(line[low:high], compiled, post_skip, names, config.serial_search)
                if event:
                    keep.append(at)
                    kinds.append(event[0])
                    captures.append([(low + s, low + e, t, r) for s, e, t, r in event[1]] if low else event[1])
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part[c] for c in others] + [pa.array(kinds, pa.string()), _capture_lists(captures)], [*others, "kind", "captures"])

    selected = _from_start(lines, config).select(*others, line_col).where(needs(F.col(line_col), program))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in selected.schema if f.name != line_col)
    return selected.mapInArrow(run, f"{schema}, {EVENT}" if schema else EVENT)


_ROLE_KIND = [("keys", pa.list_(pa.string())), ("flags", pa.list_(pa.string())), ("type", pa.string()), ("blocks", pa.string()), ("interval", pa.string())]


def _capture_lists(captures: list[list[tuple]]) -> pa.Array:
    """Lists of ``(start, end, text, role)`` as arrays of :data:`CAPTURE`; a role is made once and taken for its captures."""
    flat = [c for found in captures for c in found]
    roles = {id(c[3]): c[3] for c in flat}
    place = {r: k for k, r in enumerate(roles)}
    which = pa.array([place[id(c[3])] for c in flat], pa.int32())
    made = [pa.array([c[0] for c in flat], pa.int32()), pa.array([c[1] for c in flat], pa.int32()), pa.array([c[2] for c in flat], pa.string())]
    for name, kind in _ROLE_KIND:
        values = [getattr(r, name) for r in roles.values()]
        made.append(pa.array(values, kind).take(which))
    offsets = pa.array([0, *accumulate(map(len, captures))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(made, ["start", "end", "text", *(name for name, _ in _ROLE_KIND)]))


#: Texts whose units and captures a worker holds as objects at once.
SLICE_ROWS = 64


def unit_captures(texts: DataFrame, program: RuleProgram, file_col: str, text_col: str, without: frozenset[str] = frozenset()) -> DataFrame:
    """``file, line_no, cap_no, start, end, text`` of the captures of units, cut and searched in one pass over each text.

    For programs whose captures :func:`.flags.stand_alone`: the same rows as of :func:`events` over :func:`..sources.text.units`,
    but for captures with a key that is in ``without``. So no unit leaves its worker but as a capture.
    """
    config = program.config
    names, first = frozenset(config.name_list), config.startline or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, cut = _compile(program), re.compile(config.separate)
        post_skip = re.compile(config.post_skip) if config.post_skip else None
        for batch in slices(batches, SLICE_ROWS):
            at, numbers, places, starts, ends, found = [], [], [], [], [], []
            for row, text in enumerate(batch[text_col].to_pylist()):
                for n, unit in enumerate(cut.split(text) if text is not None else ()):
                    event = search_line(unit or "", compiled, post_skip, names, config.serial_search) if n >= first else None
                    k = 0
                    for start, end, part, role in event[1] if event else ():
                        if part == "":
                            continue
                        if without.isdisjoint(role.keys):
                            at.append(row)
                            numbers.append(n)
                            places.append(k)
                            starts.append(start)
                            ends.append(end)
                            found.append(part)
                        k += 1
            made = [pa.array(x, pa.int32()) for x in (numbers, places, starts, ends)]
            yield pa.RecordBatch.from_arrays([batch[file_col].take(pa.array(at, pa.int64())), *made, pa.array(found, pa.string())], [file_col, *_UNIT])

    kind = texts.schema[file_col].dataType.simpleString()
    return texts.select(file_col, text_col).mapInArrow(run, f"`{file_col}` {kind}, line_no int, cap_no int, start int, end int, text string")


_UNIT = ["line_no", "cap_no", "start", "end", "text"]


def _from_start(lines: DataFrame, config) -> DataFrame:
    return lines.where(F.col("line_no") >= config.startline) if config.startline and "line_no" in lines.columns else lines


def needs(line: Column, program: RuleProgram) -> Column:
    """Whether a line has the literal that some rule can't match without; true where a rule needs none."""
    literals = [required_literal(r.pattern) for r in program.rules if r.kind]
    return reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in dict.fromkeys(literals)]) if literals and all(literals) else F.lit(True)


_ROLE = "struct<start:int,end:int,text:string,keys:array<string>,flags:array<string>,type:string,blocks:string,interval:string>"


def _capture(start: Column, text: Column, role: Role) -> Column:
    """A capture as :data:`CAPTURE`, with the role of its rule's group."""
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.struct(
        start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"), strings(role.keys).alias("keys"), strings(role.flags).alias("flags"),
        F.lit(role.type).cast("string").alias("type"), F.lit(role.blocks).cast("string").alias("blocks"), F.lit(role.interval).cast("string").alias("interval"),
    ).cast(_ROLE)


def _match_step(groups: list[tuple[int, Role]], n_parts: int, names: tuple[str, ...], unwanted: str | None):
    """What a match (a struct of its parts ``p1``, the gap, to ``pn``) adds to a state of place and captures."""

    def step(s: Column, m: Column) -> Column:
        before = lambda k: reduce(Column.__add__, [F.length(m[f"p{j}"]) for j in range(1, k)], s["at"])
        made = []
        for k, role in groups:
            if not role.skip:
                text = m[f"p{k}"]
                one = _capture(before(k), text, role)
                made.append(F.when(text.isin(*names), _capture(before(k), text, Role(keys=("name",)))).otherwise(one) if names else one)
        kept = F.array(*made)
        if unwanted:
            kept = F.filter(kept, lambda c: ~F.regexp_like(c["text"], F.lit(unwanted)))
        return F.struct(before(n_parts + 1).cast("int").alias("at"), F.concat(s["out"], kept).alias("out"))

    return step


#: Matches of a line that are folded together. Appending to an array copies it, so one fold over all would cost their square.
FOLD = 512


def _folded(matches: Column, at: Column, none: Column, step) -> Column:
    """All captures of a line's matches, chunk by chunk; the matches are found once and handed on in the state."""
    chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.size(matches) - 1, F.lit(0)) / FOLD).cast("int"))

    def chunk(s: Column, k: Column) -> Column:
        part = F.slice(s["all"], k * FOLD + 1, F.lit(FOLD))
        done = lambda d: F.struct(s["all"].alias("all"), d["at"].alias("at"), F.concat(s["out"], d["out"]).alias("out"))
        return F.aggregate(part, F.struct(s["at"].alias("at"), none.alias("out")), step, done)

    return F.aggregate(chunks, F.struct(matches.alias("all"), at.alias("at"), none.alias("out")), chunk, lambda s: s["out"])


def _native_events(line: Column, program: RuleProgram, part_only: bool) -> Column | None:
    """``struct<kind, captures>`` of a line, null where it matches nothing; None where the program can't run natively."""
    config = program.config
    unwanted = java_pattern(config.post_skip) if config.post_skip else None
    if config.serial_search or (config.post_skip and unwanted is None):
        return None
    base = F.col(_SPAN[0]) if part_only else F.lit(0)
    seen = F.substring(line, base + 1, F.coalesce(F.col(_SPAN[1]), F.length(line)) - base) if part_only else line
    steps: list[Column] = []
    none = F.array().cast(f"array<{_ROLE}>")
    for rule in program.rules:
        if not rule.kind:
            continue
        pattern = java_pattern(rule.pattern)
        if pattern is None:
            return None
        if rule.kind == "skip":
            steps.append(F.when(F.regexp_like(seen, F.lit(pattern)), F.struct(F.lit("skip").alias("kind"), none.alias("captures"))))
            continue
        parts, roles = segments(rule.pattern), rule.roles()
        if parts is None or any(r.interval is not None for r in roles):
            return None
        if not roles or all(r.skip for r in roles):
            continue
        # \G: a match begins where the one before ended, so a rest without one is read once and not from each of its places
        whole = F.lit(java_pattern("\\G([\\s\\S]*?)" + "".join(x if group else f"({x})" for x, group in parts)))
        found = [F.regexp_extract_all(seen, whole, F.lit(k)).alias(f"p{k}") for k in range(1, len(parts) + 2)]
        groups = [k + 2 for k, (_, group) in enumerate(parts) if group]
        step = _match_step(list(zip(groups, roles, strict=True)), len(found), config.name_list, unwanted)
        taken = _folded(F.arrays_zip(*found), base.cast("int"), none, step)
        # the captures stand in an array of one, so that what follows names them twice but finds them once
        accepted = F.filter(F.array(taken), lambda t: F.size(t) > 0)
        event = F.transform(accepted, lambda t: F.struct(F.lit("match").alias("kind"), F.filter(t, lambda c: c["text"] != "").alias("captures")))
        # lines without a match are spared the fold
        steps.append(F.when(F.regexp_like(seen, F.lit(pattern)), F.get(event, F.lit(0))))
    kind = f"struct<kind:string,captures:array<{_ROLE}>>"
    return F.coalesce(*[step.cast(kind) for step in steps], F.lit(None).cast(kind))


def native_form(program: RuleProgram) -> list[tuple[str, str, Role | None]] | None:
    """(kind, Java pattern, role) of each rule where the whole program can run natively, else None."""
    out = []
    for rule in program.rules:
        if not rule.kind:
            continue
        pattern = java_pattern(rule.pattern)
        roles = rule.roles() if rule.kind == "search" else []
        if pattern is None or (rule.kind == "search" and len(roles) != 1):
            return None
        out.append((rule.kind, pattern, roles[0] if roles else None))
    if program.config.serial_search or (program.config.post_skip and java_pattern(program.config.post_skip) is None):
        return None
    return out


def first_match(lines: DataFrame, program: RuleProgram, line_col: str = "line") -> DataFrame:
    """``lines`` plus ``rule`` (number of the rule that decided, from 0; null: none), ``kind`` and ``texts array<string>``.

    The native form: no positions. Raises ValueError where the program needs :func:`events`.
    """
    form = native_form(program)
    if form is None:
        raise ValueError("this program needs Python's matcher")
    line, config = F.col(line_col), program.config
    accepts = lambda x: x.isNotNull()
    if config.post_skip:
        unwanted = F.lit(java_pattern(config.post_skip))
        accepts = lambda x: ~F.regexp_like(x, unwanted)
    steps: list[tuple[Column, Column]] = []
    none = F.array().cast("array<string>")
    for i, (kind, pattern, role) in enumerate(form):
        if kind == "skip":
            steps.append((F.regexp_like(line, F.lit(pattern)), F.struct(F.lit(i).alias("rule"), F.lit("skip").alias("kind"), none.alias("texts"))))
        elif not role.skip:
            found = F.filter(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), accepts)
            texts = F.filter(found, lambda x: x != "")
            steps.append((F.size(found) > 0, F.struct(F.lit(i).alias("rule"), F.lit("match").alias("kind"), texts.alias("texts"))))
    decided = reduce(lambda done, step: F.when(step[0], step[1]).otherwise(done), reversed(steps), F.lit(None))
    return _from_start(lines, config).withColumn("_hit", decided).select(*lines.columns, "_hit.rule", "_hit.kind", "_hit.texts")


# ---- bytes -----------------------------------------------------------------------------------------------------------

#: A capture of bytes: places in bytes, and the place and value of the length in front (-1: there is none).
BYTE_CAPTURE = CAPTURE[:-1] + ",prefix_at:int,prefix:long>"


def search_unit(data: bytes, compiled: list, program: RuleProgram) -> tuple[str, list] | None:
    """As :func:`search_line`, over bytes: captures are ``(start, end, text, role, prefix_at, prefix)``."""
    config = program.config
    post_skip = re.compile(config.post_skip) if config.post_skip else None
    single = re.compile(config.check_jis.encode("latin-1")) if config.check_jis else None
    for kind, pattern, roles in compiled:
        if kind == "skip":
            if pattern.search(data):
                return "skip", []
            continue
        found: dict[int, tuple] = {}
        at, accepted = 0, False
        while at <= len(data) and (match := pattern.search(data, at)):
            moved = 0
            for i, role in enumerate(roles, 1):
                if match.group(i) is None:
                    continue
                start, end, prefix_at, prefix = *match.span(i), -1, -1
                if config.pre_len and not role.nolen:
                    offset = config.pre_len_offset
                    prefix_at = match.start() if offset == "start" else start + (-config.pre_len if offset is None else offset)
                    prefix = int.from_bytes(data[max(0, prefix_at) : prefix_at + config.pre_len], "little")
                    if config.pre_len_strict:
                        told = start + prefix * config.pre_len_scale + config.pre_len_add
                        if not start <= told <= len(data):
                            break
                        moved, end = moved + told - end, told
                raw = data[start:end]
                if role.skip or (config.check_jis is not None and not is_shift_jis(raw, single)):
                    continue
                try:
                    text = raw.decode(config.encoding)
                except UnicodeDecodeError:
                    if config.ignore_decode_error:
                        continue
                    raise
                if post_skip and post_skip.search(text):
                    continue
                accepted = True
                found[start] = (start, end, text, Role(keys=("name",)) if text in config.name_list else role, prefix_at, prefix)
            step = match.end() + moved
            at = step if step > max(at, match.start()) else max(at, match.end()) + 1
        if accepted:
            return "match", [c for c in found.values() if c[2] != "" or c[3].interval is not None]
    return None


def byte_events(units: DataFrame, program: RuleProgram, unit_col: str = "unit") -> DataFrame:
    """``units`` of bytes without those that match nothing, plus ``kind`` and ``captures`` (:data:`BYTE_CAPTURE`).

    Patterns are those of the rule text in the texts' encoding. A capture that can't be decoded fails the job, or is dropped
    with ``ignoreDecodeError``. Null units match nothing.
    """
    others = [c for c in units.columns if c != unit_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r.kind, re.compile(r.pattern.encode(program.config.encoding), re.DOTALL), r.roles()) for r in program.rules if r.kind]
        for batch in batches:
            rows = []
            for at, data in enumerate(batch[unit_col].to_pylist()):
                event = None if data is None else search_unit(data, compiled, program)
                if event:
                    rows.append((at, event[0], [
                        {"start": s, "end": e, "text": t, "keys": list(r.keys), "flags": list(r.flags), "type": r.type, "blocks": r.blocks, "interval": r.interval, "prefix_at": p, "prefix": n}
                        for s, e, t, r, p, n in event[1]
                    ]))
            part = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            strings = pa.list_(pa.string())
            kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("keys", strings), ("flags", strings), ("type", pa.string()), ("blocks", pa.string()), ("interval", pa.string()), ("prefix_at", pa.int32()), ("prefix", pa.int64())]))
            made = [pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], kind_of)]
            yield pa.RecordBatch.from_arrays([part[c] for c in others] + made, [*others, "kind", "captures"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in units.schema if f.name != unit_col)
    return units.select(*others, unit_col).mapInArrow(run, f"{schema}kind string, captures array<{BYTE_CAPTURE}>")
