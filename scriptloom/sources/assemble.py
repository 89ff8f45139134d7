"""Pieces of a binary file, put together again with sizes and addresses made anew (survey F15, X17, X18).

A reader cuts a file into an ordered list of pieces ``(kind, bytes)``. Besides ``raw`` bytes and texts (``text``, ``name``,
``select``) there are pieces that say something about others, so that a text of another length leaves a valid file:

* ``size W N A``: the bytes of the next N pieces, plus A, in W bytes, little-endian; ``half W N A``: half of those bytes;
* ``len W P A``: the bytes of piece number P, plus A;
* ``at W P B``: where piece P begins, counted from where piece B begins (-1: from the start of the file);
* ``xor KEY`` ... ``end``: everything between is XORed with a repeating key (hexadecimal), or with the low byte (``size1``)
  or the low two bytes of half (``half2``) of the number of bytes between.
"""

from __future__ import annotations

from ..functions.charset import xor_bytes

Pieces = list[tuple[str, bytes]]

#: Kinds that hold text to translate.
TEXTS = ("text", "name", "select")


def little(data: bytes, at: int, width: int = 4) -> int:
    return int.from_bytes(data[at : at + width], "little")


def key_of(spec: str, size: int) -> bytes:
    """The key of an ``xor`` piece over so many bytes."""
    if spec == "size1":
        return bytes([size & 0xFF])
    if spec == "half2":
        return (size // 2 & 0xFFFF).to_bytes(2, "little")
    return bytes.fromhex(spec)


def assemble(pieces: Pieces) -> bytes:
    """The file of its pieces."""
    parts = []
    for kind, data in pieces:
        what, *rest = kind.split(" ")
        width = int(rest[0]) if what in ("size", "half", "len", "at") else len(data) if what not in ("xor", "end") else 0
        parts.append((what, rest, width, data))
    begins, total = [], 0
    for _, _, width, _ in parts:
        begins.append(total)
        total += width
    begins.append(total)
    out, open_ = bytearray(), None
    for k, (what, rest, width, data) in enumerate(parts):
        if what == "xor":
            open_ = (begins[k], rest[0])
        elif what == "end":
            low, spec = open_
            out[low:] = xor_bytes(bytes(out[low:]), key_of(spec, len(out) - low))
        elif what in ("size", "half"):
            covered = begins[k + 1 + int(rest[1])] - begins[k + 1]
            out += ((covered // 2 if what == "half" else covered) + int(rest[2])).to_bytes(width, "little")
        elif what == "len":
            p = int(rest[1])
            out += (begins[p + 1] - begins[p] + int(rest[2])).to_bytes(width, "little")
        elif what == "at":
            base = int(rest[2])
            out += (begins[int(rest[1])] - (0 if base < 0 else begins[base])).to_bytes(width, "little")
        else:
            out += data
    return bytes(out)
