"""Legacy charsets of one- and two-byte characters as native expressions: no Python, no session setting.

A charset is a pair of constant strings for ``translate``. It turns each character into a unit: one byte b into the code point b, two bytes into
0x10000 + them. The units, written in four bytes each, carry the encoded bytes at known places, and one pass of a
pattern over their hex digits takes them out. The tables are made from Python's codecs by a rule, once a process.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = 0x10000
#: First bytes of two-byte characters, as a class of two hex digits.
LEADS = {"cp932": "(?:8[1-9A-F]|9[0-9A-F]|E[0-9A-F]|F[0-9A-D])", "gbk": "(?:8[1-9A-F]|[9A-E][0-9A-F]|F[0-9A-E])"}


@cache
def table(encoding: str) -> tuple[tuple[str, int], ...]:
    """Characters beyond ASCII and their units. Single bytes that begin two-byte characters are left out, so units can be read back."""
    out = []
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x10000)):
        try:
            data = chr(point).encode(encoding)
        except UnicodeEncodeError:
            continue
        if len(data) == 2 and data[0] >= 0x80:
            out.append((chr(point), _WIDE + int.from_bytes(data, "big")))
        elif len(data) == 1 and data.decode(encoding) == chr(point) and not (0x81 <= data[0] <= 0x9F or 0xE0 <= data[0]):
            out.append((chr(point), data[0]))
    return tuple(out)


@cache
def characters(encoding: str) -> dict[str, bytes]:
    """The characters beyond ASCII and their bytes."""
    return {c: u.to_bytes(1, "big") if u < _WIDE else (u - _WIDE).to_bytes(2, "big") for c, u in table(encoding)}


@cache
def character_bytes(encoding: str) -> re.Pattern:
    """Finds the bytes of one character after another."""
    leads = bytes(b for b in range(256) if re.fullmatch(LEADS[encoding], f"{b:02X}"))
    return re.compile(b"[" + re.escape(leads) + b"].|.", re.DOTALL)


@cache
def _pairs(encoding: str) -> tuple[str, str]:
    """Characters and units for both ways; of characters with the same bytes, the one that these are read as."""
    known = table(encoding)
    return "".join(c for c, _ in known), "".join(chr(u) for _, u in known)


def unencodable(text: Column, encoding: str) -> Column:
    """The characters of a text that the charset lacks, as they come."""
    ascii_free = F.regexp_replace(text, "[\\x00-\\x7F]+", "")
    return F.translate(ascii_free, _pairs(encoding)[0], "")


def units(text: Column, encoding: str, extra: dict[str, bytes] | None = None) -> Column:
    """A text in units, null where a character has none; ``extra``: two-byte codes of characters that the charset lacks."""
    chars, codes = _pairs(encoding)
    extra = extra or {}
    more = "".join(extra)
    lacking = F.translate(unencodable(text, encoding), more, "") if more else unencodable(text, encoding)
    there = "".join(chr(_WIDE + int.from_bytes(b, "big")) for b in extra.values())
    return F.when(lacking == "", F.translate(text, chars + more, codes + there))


def _hex(unit: Column) -> Column:
    return F.regexp_replace(F.hex(F.encode(unit, "UTF-32")), "00(?:0000(..)|01(....))", "$1$2")


def encoded(text: Column, encoding: str, extra: dict[str, bytes] | None = None) -> Column:
    """The bytes of a text, null where it can't be encoded."""
    return F.unhex(_hex(units(text, encoding, extra)))


def decoded(data: Column, encoding: str, extra: dict[str, bytes] | None = None) -> Column:
    """The text of bytes, null where some are no character; ``extra`` as in :func:`encoded`."""
    extra = extra or {}
    found = F.regexp_extract_all(F.hex(data), F.lit(f"{LEADS[encoding]}..|.."), F.lit(0))
    wide = F.transform(found, lambda x: F.concat(F.when(F.length(x) == 4, F.lit("0001")).otherwise(F.lit("000000")), x))
    unit = F.decode(F.unhex(F.array_join(wide, "")), "UTF-32")
    back: dict[str, str] = {}
    for c, u in table(encoding):
        if c.encode(encoding).decode(encoding) == c:
            back[chr(u)] = c
    back |= {chr(_WIDE + int.from_bytes(b, "big")): c for c, b in extra.items()}
    known = "".join(back)
    foreign = F.translate(F.regexp_replace(unit, "[\\x00-\\x7F]+", ""), known, "")
    return F.when(foreign == "", F.translate(unit, known, "".join(back.values())))


def fitted(text: Column, size: Column, encoding: str, padding: bytes = b"") -> Column:
    """``struct<data binary, diff int>``: exactly ``size`` bytes, and by how much the text is shorter (negative: longer).

    A text too long is cut at a character, a short one is filled with whole paddings, then spaces. Null for what can't be encoded.
    """
    unit = units(text, encoding)
    weight = lambda c: F.when(c >= F.lit(chr(_WIDE)), 2).otherwise(1)
    state = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(s: Column, c: Column) -> Column:
        stop = s["full"] | (s["used"] + weight(c) > size)
        return F.struct(
            F.when(stop, s["chars"]).otherwise(s["chars"] + 1).alias("chars"), F.when(stop, s["used"]).otherwise(s["used"] + weight(c)).alias("used"), stop.alias("full")
        )

    # no more characters than bytes can be needed
    head = F.substring(unit, F.lit(1), size)
    cut = F.aggregate(F.filter(F.split(head, ""), lambda c: c != ""), state, step)
    length = F.octet_length(_hex(unit)) / 2
    lost = size - cut["used"]
    whole = F.floor(lost / len(padding)).cast("int") if padding else F.lit(0)
    filled = F.concat(_hex(F.substring(unit, F.lit(1), cut["chars"])), F.repeat(F.lit(padding.hex().upper()), whole), F.repeat(F.lit("20"), lost - whole * len(padding)))
    return F.when(unit.isNotNull(), F.struct(F.unhex(filled).alias("data"), (size - length).cast("int").alias("diff")))
