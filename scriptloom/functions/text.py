"""Text functions as native expressions (survey section 2.8, P15, P25 to P28)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..regexes import java_pattern, java_replacement

KANA = "぀-ヿ"
CJK = "一-鿿"


def replace_chain(text: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements one after another."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)


def regex_chain(text: Column, pairs: dict[str, str]) -> Column:
    """Pattern replacements one after another, Python syntax."""

    def one(t: Column, pair: tuple[str, str]) -> Column:
        pattern = java_pattern(pair[0])
        if pattern is None:
            raise ValueError(f"no native form of {pair[0]!r}")
        return F.regexp_replace(t, pattern, java_replacement(pair[1]))

    return reduce(one, pairs.items(), text)


def replace_whole(text: Column, pairs: dict[str, str]) -> Column:
    """The value for a text that equals a key."""
    return reduce(lambda rest, p: F.when(text == p[0], F.lit(p[1])).otherwise(rest), reversed(list(pairs.items())), text)


def wide_pairs() -> tuple[str, str]:
    """ASCII from space to tilde, and the full-width forms: those are 0xFEE0 further on, and the space is U+3000."""
    half = "".join(map(chr, range(0x20, 0x7F)))
    return half, "　" + "".join(chr(ord(c) + 0xFEE0) for c in half[1:])


def to_full_width(text: Column) -> Column:
    return F.translate(text, *wide_pairs())


def to_half_width(text: Column) -> Column:
    return F.translate(text, *reversed(wide_pairs()))


def newline_vote(text: Column) -> Column:
    """The dominant newline: CRLF where it ends at least as many lines as a bare LF does."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return F.when(crlf >= F.regexp_count(text, F.lit("\n")) - crlf, "\r\n").otherwise("\n")


def hard_wrap(text: Column, n: int, sep: str = "\n") -> Column:
    """Separators out, then one after every n characters (X25). A text without others stays as it is."""
    flat = F.replace(text, F.lit(sep), F.lit(""))
    return F.when(flat == "", text).otherwise(F.regexp_replace(flat, f"(?s)(.{{{n}}})(?!$)", "$1" + java_replacement(sep)))


def split_zip(orig: Column, trans: Column, sep: str = "\r\n", add_space: str = "　", add_bytes: str = "", max_line_count: int = 3) -> Column:
    """Translated lines for the lines of an original, as an array of its size.

    Lines too many are joined to the last; missing ones are ``add_space``; an empty translation is empty lines. With
    ``add_bytes`` the last line gets one more for every line below ``max_line_count``. No original, no lines.
    """
    o, t = F.split(orig, _quoted(sep), -1), F.split(trans, _quoted(sep), -1)
    n = F.size(o)

    def line(i: Column) -> Column:
        whole = F.when(i == n - 1, F.array_join(F.slice(t, n, F.greatest(F.size(t) - n + 1, F.lit(0))), ""))
        return F.when(trans == "", "").when(i >= F.size(t), add_space).otherwise(F.coalesce(F.when(F.size(t) > n, whole), F.get(t, i)))

    lines = F.transform(F.sequence(F.lit(0), n - 1), line)
    if add_bytes:
        extra = F.when(n < max_line_count, F.repeat(F.lit(add_bytes), (F.lit(max_line_count) - n))).otherwise("")
        lines = F.transform(lines, lambda x, i: F.when(i == n - 1, F.concat(x, extra)).otherwise(x))
    return F.when(orig == "", F.array().cast("array<string>")).otherwise(lines)


def _quoted(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def over_length(lines: Column, most: int) -> Column:
    """The lines of an array that are longer than allowed (X11)."""
    return F.filter(lines, lambda x: F.length(x) > most)


def cut_utf8(text: Column, most: int) -> Column:
    """The longest prefix within a number of UTF-8 bytes, whole characters only."""
    chars = F.split(F.substring(text, 1, most), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, c: Column) -> Column:
        fits = s["open"] & (s["n"] + F.octet_length(c) <= most)
        return F.struct(F.when(fits, F.concat(s["out"], c)).otherwise(s["out"]).alias("out"), (s["n"] + F.octet_length(c)).alias("n"), fits.alias("open"))

    return F.aggregate(chars, start, step)["out"]


def byte_offset(text: Column, chars: Column) -> Column:
    """The UTF-8 byte position of a character position."""
    return F.octet_length(F.left(text, chars))


def has_japanese(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"[{KANA}{CJK}]"))


def jp_score(text: Column) -> Column:
    """Kana and kanji count double, full-width forms and CJK punctuation single."""
    return 2 * F.regexp_count(text, F.lit(f"[{KANA}{CJK}]")) + F.regexp_count(text, F.lit("[　-〿！-｠]"))


def looks_like_path(text: Column) -> Column:
    """File names and paths, which aren't for translation."""
    return F.regexp_like(text, F.lit(r"^[\x21-\x7e]*[\\/][\x21-\x7e]*$|^[\w\-]+\.[A-Za-z0-9]{2,4}$"))


def bracket_parts(text: Column, opens: str = "<", closes: str = ">") -> Column:
    """Bracketed parts and the text between them, in order; brackets don't nest (P15, depth 1)."""
    o, c = "\\" + opens, "\\" + closes
    return F.regexp_extract_all(text, F.lit(f"({o}[^{c}]*{c}|[^{o}]+)"), F.lit(1))


def bracket_balance(text: Column, opens: str = "「『", closes: str = "」』") -> Column:
    return F.regexp_count(text, F.lit(f"[{opens}]")) - F.regexp_count(text, F.lit(f"[{closes}]"))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def occurrences(text: Column, part: str) -> Column:
    return F.regexp_count(text, F.lit("\\Q" + part + "\\E"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\r"), F.lit("\r")), F.lit("\\n"), F.lit("\n"))


def tagged_line(line: Column) -> Column:
    """``kind, id, disp, idx, text`` of ``○idx|text``, ``◆disp|idx|text`` and ``●id|disp|idx|text`` lines; null for others."""
    body = F.substring(line, 2, 1 << 30)
    cut = lambda n: F.split(body, "[|]", n)
    null = F.lit(None).cast("string")
    row = lambda kind, a, b, c, t: F.struct(F.lit(kind).alias("kind"), a.alias("id"), b.alias("disp"), c.alias("idx"), unescape(t).alias("text"))
    first = F.left(line, F.lit(1))
    return (
        F.when((first == "○") & (F.size(cut(2)) == 2), row("plain", null, null, F.get(cut(2), F.lit(0)), F.get(cut(2), F.lit(1))))
        .when((first == "◆") & (F.size(cut(3)) == 3), row("shown", null, F.get(cut(3), F.lit(0)), F.get(cut(3), F.lit(1)), F.get(cut(3), F.lit(2))))
        .when((first == "●") & (F.size(cut(4)) == 4), row("named", *[F.get(cut(4), F.lit(i)) for i in range(4)]))
    )


def normalise_symbols(text: Column, pairs: dict[str, str]) -> Column:
    return replace_chain(text, pairs)


def signature_warning(line: Column) -> Column:
    """Whether a text begins with a byte-order mark or its mirror image."""
    return F.left(line, F.lit(1)).isin("﻿", "￾")


def first_level_json(value: Column) -> Column:
    return F.try_parse_json(value)


def with_symbols(text: Column, pattern: str, symbols: Column) -> Column:
    """Matches of a pattern replaced by their symbols (a map column); those without one stay."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s)({pattern}|.(?:(?!{pattern}).)*)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.element_at(symbols, x), x)), "")


def without_symbols(text: Column, symbols: dict[str, str]) -> Column:
    """The inverse on import: every symbol back to what it stands for. ``symbols`` is as short as the list of symbols."""
    return replace_chain(text, {new: old for old, new in symbols.items()})


#: What some engines' texts need before they are read, and translations before they are written.
ENGINE_FIXES = {
    "orig": {"RealLive": {" +": ""}, "Silky_map": {"<001A0014>": "\n"}},
    "trans": {"RealLive": {"<n>": "<230003C900000000>"}, "Silky_map": {"\n": "<001A0014>"}},
}


def engine_fix(text: Column, engine: str, side: str) -> Column:
    return regex_chain(text, ENGINE_FIXES[side].get(engine, {}))
