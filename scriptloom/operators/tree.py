"""JSON trees, tables and event codes as rows of leaves (survey P17, P19 to P23, X24, D14)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys, col, text``: one row for each text cell; a null cell is an empty text."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def header_columns(columns: list[str], pattern: str) -> list[tuple[str, bool]]:
    """Columns chosen by a header pattern, or by numbers such as ``1,name2,3``; the flag says that a column has names."""
    if re.fullmatch(r"(name)?\d+(,(name)?\d+)*", pattern):
        picked = [(int(re.sub(r"\D", "", p)), p.startswith("name")) for p in pattern.split(",")]
        return [(columns[i], is_name) for i, is_name in picked if i < len(columns)]
    return [(c, c.lower().startswith("name")) for c in columns if re.search(pattern, c)]


def json_entries(value: Column) -> Column:
    """The entries of a JSON object as an array of ``key, value`` strings; scalars as they are, the rest as JSON."""
    return F.map_entries(F.from_json(value, "map<string,string>"))


def include_key(spec: str):
    """The test that a list of keys means: ``all``, ``none``, ``a,b`` (only those) or ``!a,b`` (all but those)."""
    if spec in ("all", "", "none"):
        return lambda _: spec != "none"
    names = set(spec.lstrip("!").split(","))
    return (lambda k: k not in names) if spec.startswith("!") else (lambda k: k in names)


def _loaded(text: str | None):
    """The tree of a JSON text; None for what is none, or is nested deeper than Python's reader goes (some ten thousand levels)."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _opened(node: str):
    """The tree in a string that holds JSON itself, or None."""
    return _loaded(node) if node[:1] in ("[", "{") else None


def _well_formed(text: str) -> str:
    """Lone surrogates, which JSON may escape but UTF-8 lacks, as question marks."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace").replace("\ufffd", "?") if any("\ud800" <= c <= "\udfff" for c in text) else text


def leaves(df: DataFrame, json_col: str, keys: str = "all") -> DataFrame:
    """String leaves of JSON texts: other columns, ``leaf_no int, path array<string>, code long, text string``.

    ``code`` is that of the nearest event (an object with a numeric ``code`` and ``parameters``) above the leaf. Strings that
    hold JSON themselves are opened. Nulls and empty strings are no leaves; texts that aren't JSON have none.
    """
    others, wanted = [c for c in df.columns if c != json_col], include_key(keys)

    def walk(tree) -> Iterator[tuple]:
        # a stack, not recursion: trees may be as deep as their texts are long
        stack = [(tree, [], None)]
        while stack:
            node, path, code = stack.pop()
            if isinstance(node, str):
                opened = _opened(node)
                if opened is not None:
                    stack.append((opened, path, code))
                elif node:
                    yield path, code, _well_formed(node)
            elif isinstance(node, list):
                stack += [(x, [*path, str(i)], code) for i, x in reversed(list(enumerate(node)))]
            elif isinstance(node, dict):
                if isinstance(node.get("code"), int) and isinstance(node.get("parameters"), list):
                    own = node["code"]
                else:
                    own = code
                inside = [(x, [*path, _well_formed(k)], own) for k, x in node.items() if isinstance(x, (dict, list)) or wanted(k)]
                stack += reversed(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, paths, codes, texts = [], [], [], [], []
            for at, text in enumerate(batch[json_col].to_pylist()):
                for n, (path, code, leaf) in enumerate(walk(_loaded(text))):
                    for column, x in zip((rows, numbers, paths, codes, texts), (at, n, path, code, leaf), strict=True):
                        column.append(x)
            part = batch.take(pa.array(rows, pa.int64()))
            made = [pa.array(numbers, pa.int32()), pa.array(paths, pa.list_(pa.string())), pa.array(codes, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([part[c] for c in others] + made, [*others, "leaf_no", "path", "code", "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name != json_col)
    return df.select(*others, json_col).mapInArrow(run, f"{schema}leaf_no int, path array<string>, code long, text string")


def replace_leaves(df: DataFrame, json_col: str, changes_col: str, keys: str = "all", style: int = 0) -> DataFrame:
    """``df`` with the leaves of its JSON texts replaced: ``changes_col`` is an ``array<struct<leaf_no:int, text:string>>``.

    Leaves are numbered as :func:`leaves` does. Strings that hold JSON are opened and closed again, compactly. Texts that aren't
    JSON, and rows without changes, come back as they are; ``style`` is that of :func:`scriptloom.sources.formats.rebuilt_json`.
    A text with changes that is nested deeper than Python's recursion goes (nearly a thousand levels) is an error.
    """
    from ..sources.formats import rebuilt_json

    wanted = include_key(keys)

    def rewrite(node, number: Iterator[int], new: dict[int, str]):
        if isinstance(node, str):
            opened = _opened(node)
            if opened is not None:
                return json.dumps(rewrite(opened, number, new), ensure_ascii=False, separators=(",", ":"))
            return new.get(next(number), node) if node else node
        if isinstance(node, list):
            return [rewrite(x, number, new) for x in node]
        if isinstance(node, dict):
            return {k: rewrite(x, number, new) if isinstance(x, (dict, list)) or wanted(k) else x for k, x in node.items()}
        return node

    @F.pandas_udf("string")
    def put(text: pd.Series, changes: pd.Series) -> pd.Series:
        def one(t, found):
            new = {x["leaf_no"]: x["text"] for x in found} if found is not None else {}
            tree = _loaded(t) if new else None
            return t if tree is None else _well_formed(rebuilt_json(rewrite(tree, count(), new), style))

        return pd.Series([one(t, c) for t, c in zip(text, changes, strict=True)], dtype=object)

    return df.withColumn(json_col, put(F.col(json_col), F.col(changes_col)))


def keep_format_roles(captures: Column, key: Column) -> Column:
    """Captures of the value of a key ``name`` or ``message``: the last of them is a name, or ends what is unfinished."""
    last = F.size(captures) - 1
    keys = lambda c: F.when(key == "name", F.array_union(c["keys"], F.array(F.lit("name")))).when(key == "message", F.array_remove(c["keys"], "unfinish")).otherwise(c["keys"])
    return F.transform(captures, lambda c, i: F.when(i == last, c.withField("keys", keys(c))).otherwise(c))


#: The codes of events, what they are called, x where the text is extracted, b where they break a paragraph.
EVENT_CODES = """
0 Empty - b; 101 Show Text Attributes x b; 102 Show Choices x b; 103 Input Number - b; 104 Select Key Item - b; 105 Show Scrolling Text Attributes - b;
108 Comment x -; 111 Conditional Branch - b; 112 Loop - b; 113 Break Loop - b; 115 Exit Event Processing - b; 117 Call Common Event - b; 118 Label - b;
119 Jump to Label - b; 121 Control Switches - b; 122 Control Variables - b; 123 Control Self Switch - b; 124 Control Timer - b; 125 Change Gold - b;
126 Change Items - b; 127 Change Weapons - b; 128 Change Armor - b; 129 Change Party Member - b; 132 Change Battle BGM - b; 133 Change Battle End ME - b;
134 Change Save Access - b; 135 Change Menu Access - b; 136 Change Encounter - b; 137 Change Formation Access - b; 138 Change Window Color - b;
201 Transfer Player - b; 202 Set Vehicle Location - b; 203 Set Event Location - b; 204 Scroll Map - b; 205 Set Move Route - b; 206 Get on/off Vehicle - b;
211 Change Transparency - b; 212 Show Animation - b; 213 Shot Balloon Icon - b; 214 Erase Event - b; 216 Change Player Followers - b; 217 Gather Followers - b;
221 Fadeout Screen - b; 222 Fadein Screen - b; 223 Tint Screen - b; 224 Flash Screen - b; 225 Shake Screen - b; 230 Wait - b; 231 Show Picture - b;
232 Move Picture - b; 233 Rotate Picture - b; 234 Tint Picture - b; 235 Erase Picture - b; 236 Set Weather Effects - b; 241 Play BGM - b; 242 Fadeout BGM - b;
243 Save BGM - b; 244 Replay BGM - b; 245 Play BGS - b; 246 Fadeout BGS - b; 249 Play ME - b; 250 Play SE - b; 251 Stop SE - b; 261 Play Movie - b;
281 Change Map Display - b; 282 Change Tileset - b; 283 Change Battle Back - b; 284 Change Parallax Back - b; 285 Get Location Info - b;
301 Battle Processing - b; 302 Shop Processing - b; 303 Name Input Processing - b; 311 Change HP - b; 312 Change MP - b; 313 Change State - b;
314 Recover All - b; 315 Change EXP - b; 316 Change Level - b; 317 Change Parameters - b; 318 Change Skills - b; 319 Change Equipment - b;
320 Change Actor Name x -; 321 Change Actor Class - b; 322 Change Actor Graphic - b; 323 Change Vehicle Graphic - b; 324 Change Actor Nickname x -;
331 Change Enemy HP - b; 332 Change Enemy MP - b; 333 Change Enemy State - b; 334 Enemy Recover All - b; 335 Enemy Appear - b; 336 Enemy Transform - b;
337 Show Battle Animation - b; 339 Force Action - b; 340 Abort Battle - b; 351 Open Menu Screen - b; 352 Open Save Screen - b; 353 Game Over - b;
354 Return to Title Screen - b; 355 Script x -; 401 Show Text x -; 402 When - b; 403 When Cancel - b; 404 Choices End - b; 405 Show Scrolling Text x -;
408 Comment More x -; 411 Else - b; 412 Branch End - b; 413 Repeat Above - b; 601 If Win - b; 602 If Escape - b; 603 If Lose - b;
604 Battle Processing End - b; 605 Shop Item - b; 655 Script More x -; 657 Other x -
"""


def event_codes(spark: SparkSession) -> DataFrame:
    """``code, label, extract, breaks`` of the fixed codes."""
    rows = []
    for entry in EVENT_CODES.replace("\n", " ").split(";"):
        code, *label, extract, breaks = entry.split()
        rows.append((int(code), " ".join(label), extract == "x", breaks == "b"))
    return spark.createDataFrame(rows, "code long, label string, extract boolean, breaks boolean")


def with_codes(rows: DataFrame, codes: DataFrame, code_col: str = "code") -> DataFrame:
    """Events that a code table (``code, extract, breaks``, and what else it says of a code) says to extract."""
    return rows.join(codes.where("extract").drop("extract").withColumnRenamed("code", code_col), code_col)


def tag(key: Column, value: Column, width: int = 7) -> Column:
    """A value with its key in front, cut or padded to a fixed width, so that rules can tell them apart."""
    return F.concat(F.lit("<"), F.rpad(key.cast("string"), width, " "), F.lit(">"), value)


def untag(value: Column, width: int = 7) -> Column:
    return F.substring(value, width + 3, 1 << 30)
