"""Line layout that depends on running state: Arrow-batched functions (survey X9, X26, X28, X29, X33)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ExtractConfig


def redistribute_text(orig: str, trans: str, config: ExtractConfig = ExtractConfig()) -> list[str]:
    """A translation cut into as many lines as the original has, preferably behind punctuation near the same proportion.

    The first of these that applies: one line; the translation's own lines, if their number (``ignore_same_line_count``) or
    their number and lengths (``ignore_not_max_count``) will do; pieces of a fixed width (``fixed_max_per_line``);
    punctuation. A line without text is ``add_space``.
    """
    wanted, own = orig.split(config.para_sep), trans.split(config.para_sep)
    flat = "".join(own)
    if len(wanted) == 1:
        return [flat]
    if config.ignore_same_line_count and len(own) == len(wanted):
        return own
    room = len(wanted) - len(own)
    if config.ignore_not_max_count and room >= 0 and max(map(len, own)) <= config.max_per_line:
        return _filled(own + [""] * room, config)
    if config.fixed_max_per_line:
        cuts = [min(k * config.max_per_line, len(flat)) for k in range(1, len(wanted))] + [len(flat)]
        return _filled(_cut(flat, cuts), config)
    ends = np.array([m.end() for m in re.finditer(config.symbols, flat)], np.int64)
    # where the original's lines end, in proportion; the separators count in the whole length but not in the lines
    marks = np.cumsum([len(x) for x in wanted[:-1]]) * (len(trans) / len(orig))
    cuts = break_points(ends, marks, len(flat))
    lines = _filled(_cut(flat, cuts), config)
    if config.keep_tail and cuts[-1] < len(flat):
        lines[-1] = (lines[-1] if len(cuts) < 2 or cuts[-1] > cuts[-2] else "") + flat[cuts[-1] :]
    return lines


def break_points(ends: np.ndarray, marks: np.ndarray, length: int) -> list[int]:
    """A cut for each mark and one for the end, among ascending ``ends``.

    With no more ends than cuts each end is one, and the length of the text stands for those that lack. Else the last cut is
    the last end, and every mark gets the end nearest to it (of two the left one) in the range that keeps the cuts strictly
    ascending: behind the cut before it, and with an end left for each one after it.
    """
    n = len(marks) + 1
    if len(ends) <= n:
        return [*ends.tolist(), *[length] * (n - len(ends))]
    place, target = np.arange(n - 1), np.floor(marks).astype(np.int64)
    right = np.clip(np.searchsorted(ends, target), 1, len(ends) - 1)
    nearest = np.where(target - ends[right - 1] <= ends[right] - target, right - 1, right)
    rising = np.maximum.accumulate(nearest - place) + place
    chosen = np.minimum(rising, len(ends) - n + place)
    return [*ends[chosen].tolist(), int(ends[-1])]


def _cut(text: str, cuts: list[int]) -> list[str]:
    return [text[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _filled(lines: list[str], config: ExtractConfig) -> list[str]:
    return [x or config.add_space for x in lines]


def redistributed(orig: Column, trans: Column, config: ExtractConfig = ExtractConfig()) -> Column:
    """The redistributed lines, or with ``join_after_split`` one text of them (as an array of one)."""
    lines = redistribute(orig, trans, config)
    return F.array(F.array_join(lines, config.para_sep)) if config.join_after_split else lines


def redistribute(orig: Column, trans: Column, config: ExtractConfig = ExtractConfig()) -> Column:
    @F.pandas_udf("array<string>")
    def run(o: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else redistribute_text(a, b, config) for a, b in zip(o, t, strict=True)])

    return run(orig, trans)


def wrap_bytes_text(text: str, limit: int, encoding: str = "cp932") -> list[str] | None:
    """Lines of at most ``limit`` bytes, filled greedily, whole characters only; None for what can't be encoded."""
    out, line, size = [], "", 0
    for ch in text:
        try:
            n = len(ch.encode(encoding))
        except UnicodeEncodeError:
            return None
        if line and size + n > limit:
            out.append(line)
            line, size = "", 0
        line, size = line + ch, size + n
    return [*out, line] if line else out


def wrap_bytes(text: Column, limit: int, encoding: str = "cp932") -> Column:
    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else wrap_bytes_text(x, limit, encoding) for x in t])

    return run(text)


def break_at_punctuation(text: str, capacities: list[int], encoding: str = "cp932") -> list[str]:
    """Parts for slots of given byte capacities: each ends at the farthest punctuation that fits, outside brackets.

    Where no punctuation fits, a part is cut at a character; what is left over goes to the last part.
    """
    size = lambda s: len(s.encode(encoding, "replace"))
    parts, rest = [], text
    for room in capacities[:-1]:
        depth, used, cut, fits = 0, 0, 0, 0
        for i, ch in enumerate(rest, 1):
            used += size(ch)
            if used > room:
                break
            fits = i
            depth += (ch == "「") - (ch == "」")
            if depth <= 0 and ch in "。、！？…」」，．":
                cut = i
        cut = cut if cut and size(rest) > room else fits
        parts.append(rest[:cut])
        rest = rest[cut:]
    return [*parts, rest]


def pair_quotes(text: str, opens: str = "“", closes: str = "”") -> str:
    """Straight double quotes become opening and closing ones in turn."""
    turn = iter(range(len(text)))
    return re.sub('"', lambda _: closes if next(turn) % 2 else opens, text)


def to_fix_point(text: str, pairs: list[tuple[str, str]], most: int = 1000) -> str:
    """Pattern replacements repeated until none changes anything."""
    for _ in range(most):
        before = text
        for pattern, new in pairs:
            text = re.sub(pattern, new, text)
        if text == before:
            break
    return text


def strip_ruby(text: str, pattern: str = r"\{([^/{}]*)/[^{}]*\}") -> str:
    """Ruby blocks reduced to their base text."""
    return re.sub(pattern, r"\1", text)
