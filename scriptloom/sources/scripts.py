"""Readers of engine-specific script files (survey E1 to E22): each cuts a file into pieces for :mod:`.assemble`.

What must equal the formats - signatures, offsets, keys, opcode tables - stands as plain constants. A file that a reader
doesn't recognise is one raw piece, so it passes through untouched.
"""

from __future__ import annotations

import re

from ..functions.charset import xor_bytes
from .assemble import Pieces, little


def _texts(data: bytes, separator: re.Pattern, kind: str = "text") -> Pieces:
    """Texts between separators, which are raw pieces."""
    out: Pieces = []
    at = 0
    for m in separator.finditer(data):
        out += [(kind, data[at : m.start()]), ("raw", m[0])]
        at = m.end()
    return [*out, (kind, data[at:])] if at < len(data) else out


# ---- records with a length in front ----------------------------------------------------------------------------------

#: Commands of length-prefixed scripts: the code, and the bytes before its text.
_TEXT_CODE, _SELECT_CODE = 0x00150050, 0x00140010


def length_commands(data: bytes) -> Pieces:
    """A count, then commands of a 16-bit length; text commands have a 32-bit code in front, choices seven bytes."""
    out, at = [("raw", data[:4])], 4
    while at + 2 <= len(data):
        size, code = little(data, at, 2), little(data, at + 2)
        body = data[at + 2 : at + 2 + size]
        if code == _TEXT_CODE or not code & 0xFFFF:
            out += [("size 2 2 0", b""), ("raw", body[:4]), ("text", body[4:])]
        elif code == _SELECT_CODE:
            out += [("size 2 2 0", b""), ("raw", body[:7]), ("select", body[7:])]
        else:
            out.append(("raw", data[at : at + 2 + size]))
        at += 2 + size
    return out


def length_macros(data: bytes) -> Pieces:
    """Texts of a 16-bit length, one after another."""
    out, at = [], 0
    while at + 2 <= len(data):
        size = little(data, at, 2)
        out += [("size 2 1 0", b""), ("text", data[at + 2 : at + 2 + size])]
        at += 2 + size
    return out


#: ``[テキスト表示]`` and ``[ログ追加]`` in cp932; four bytes of length stand before them.
_MARK = re.compile(rb"\[\x83e\x83L\x83X\x83g\x95\\\x8e\xa6\]|\[\x83\x8d\x83O\x92\xc7\x89\xc1\]")


def marked_dialogue(data: bytes) -> Pieces:
    """``NEKOSDK_ADVSCRIPT2``: a block at each marker, with a name and a text, both with a length that counts a final zero."""
    if not data.startswith(b"NEKOSDK_ADVSCRIPT2"):
        return [("raw", data)]
    starts = [m.start() - 4 for m in _MARK.finditer(data)]
    out: Pieces = [("raw", data[: starts[0] if starts else len(data)])]
    for low, high in zip(starts, [*starts[1:], len(data)], strict=True):
        at = low + 4 + little(data, low)
        out.append(("raw", data[low:at]))
        for kind in ("name", "text"):
            size = little(data, at)
            if size > 1:
                out += [("size 4 2 0", b""), (kind, data[at + 4 : at + 3 + size]), ("raw", data[at + 3 + size : at + 4 + size])]
            else:
                out.append(("raw", data[at : at + 4 + size]))
            at += 4 + size
        out.append(("raw", data[at:high]))
    return out


_TYPED = re.compile(rb"%L|char\0|[\x00\x01]\x0f")
#: By mark: what of the part behind it is text; the first that matches counts.
_PARTS = {
    b"%L": [(re.compile(rb"%[A-Z0-9]+(.*?)%[A-Z0-9]+%K"), "text"), (re.compile(rb"(.*?)%K"), "text")],
    b"char\0": [(re.compile(rb"[^\0](.*?)\0"), "name")],
}


def typed_separators(data: bytes) -> Pieces:
    """``%L`` begins a line that ends with ``%K``, between optional codes; ``char`` a name; ``0F`` up to five choices."""
    marks = list(_TYPED.finditer(data))
    out: Pieces = [("raw", data[: marks[0].end() if marks else len(data)])]
    for k, m in enumerate(marks):
        after = marks[k + 1] if k + 1 < len(marks) else None
        low, high, end = m.end(), after.start() if after else len(data), after.end() if after else len(data)
        hits = ((pattern.match(data, low, high), kind) for pattern, kind in _PARTS.get(m[0], ()))
        spans = [(*hit.span(1), kind) for hit, kind in hits if hit][:1]
        if m[0] in _PARTS:
            pass
        elif low < high and 0 < data[low] < 6:
            at = low + 1
            for _ in range(data[low]):
                stop = data.find(b"\0", at + 2, high)
                second = data.find(b"\0", stop + 5, high)
                if stop < 0 or second < 0:
                    break
                spans.append((at + 2, stop, "select"))
                at = second + 1
        at = low
        for a, b, kind in spans:
            out += [("raw", data[at:a]), (kind, data[a:b])]
            at = b
        out.append(("raw", data[at:end]))
    return out


#: Bytes of a command by its number; 0E is a string with its length.
_STACK_SIZES = {
    **dict.fromkeys((0x02, 0x06, 0x07, 0x0A, 0x0D), 5),
    **dict.fromkeys((0x01, 0x03, 0x0B, 0x0F, 0x11, 0x15, 0x17), 3),
    **dict.fromkeys((0x0C, 0x10, 0x12, 0x16, 0x18), 2),
    **dict.fromkeys((0x04, 0x05, 0x08, 0x09, 0x13, 0x14, *range(0x19, 0x28)), 1),
}


def stack_strings(data: bytes) -> Pieces:
    """Commands up to the address in the first four bytes; strings are ``0E``, a length that counts a final zero, bytes.

    Addresses inside the code aren't known, so a changed text must keep its length (:func:`~.charset.fit_bytes`); the
    assembler writes the length that it finds.
    """
    out, at, last, stop = [], 4, 0, little(data, 0)
    while at < min(stop, len(data)):
        if data[at] == 0x0E:
            size = data[at + 1]
            if size > 1:
                out += [("raw", data[last : at + 1]), ("size 1 2 0", b""), ("text", data[at + 2 : at + 1 + size]), ("raw", data[at + 1 + size : at + 2 + size])]
                last = at + 2 + size
            at += 2 + size
        elif data[at] in _STACK_SIZES:
            at += _STACK_SIZES[data[at]]
        else:
            return [("raw", data)]
    return [*out, ("raw", data[last:])]


def typed_segments(data: bytes, key: bytes = b"\x2b\xc5\x2a\x3d") -> Pieces:
    """A header of 76 bytes that ends with the size of the rest; segments of a type, a size and, for types 08, 0E, 1D, 1E, text.

    Lines (08) have a role in front and are XORed.
    """
    if len(data) < 0x4C:
        return [("raw", data)]
    body, at = [], 0x4C
    while at + 8 <= len(data):
        kind, size = little(data, at), little(data, at + 4)
        low = at + 8
        if kind == 0x08:
            role, text = little(data, low + 12), little(data, low + 16)
            end = low + 20 + role + text
            name = data[low + 20 : low + 20 + role]
            inner = [("raw", data[low : low + 16]), (f"size 4 4 {-role}", b""), ("raw", name), (f"xor {key.hex()}", b""), ("text", xor_bytes(data[end - text : end], key)), ("end", b"")]
        elif kind in (0x0E, 0x1D, 0x1E):
            pre = 8 if kind == 0x0E else 0
            text = little(data, low + pre)
            end = low + pre + 4 + text
            inner = [("raw", data[low : low + pre]), ("size 4 1 0", b""), ("select" if kind == 0x0E else "text", data[end - text : end])]
        else:
            end = low + size
            inner = [("raw", data[low:end])]
        # what the size counts differs by type: it moves with the text
        body += [("raw", data[at : at + 4]), (f"size 4 {len(inner)} {size - (end - low)}", b""), *inner]
        at = end
    return [("raw", data[: 0x4C - 4]), (f"size 4 {len(body)} {little(data, 0x48) - (at - 0x4C)}", b""), *body, ("raw", data[at:])]


def inverted_records(data: bytes) -> Pieces:
    """``[SCR-MESSAGE]``: records of a size and bytes XORed with FF: a name, a zero, a count, then lines that end with zero.

    With a count of 0 the first text is a choice.
    """
    head = b"[SCR-MESSAGE]"
    if not data.startswith(head) or len(data) < 17 or data[16] >= 0x34:
        return [("raw", data)]
    at = 17 + (2 if data[16] >= 3 else 1)
    out: Pieces = [("raw", data[:at])]
    while at + 4 <= len(data) and (size := little(data, at)):
        text = xor_bytes(data[at + 4 : at + 4 + size], b"\xff")
        first = text.find(b"\0")
        if first < 0:
            inner = [("raw", text)]
        else:
            lines = text[first + 1] > 0 if first + 1 < len(text) else False
            inner = [("name" if lines else "select", text[:first])] if first else []
            rest = text[first:]
            inner += [("raw", rest[:2]), *_texts(rest[2:], re.compile(rb"\0"))] if lines else [("raw", rest)]
        out += [(f"size 4 {len(inner) + 2} 0", b""), ("xor ff", b""), *inner, ("end", b"")]
        at += 4 + size
    return [*out, ("raw", data[at:])]


def string_table(data: bytes) -> Pieces:
    """Records of a type, a size and bytes; the text, XORed with FF, ends at the first end mark.

    ``UF01``: the size of the archive behind the mark, and the records' addresses at the end; ``[STRTBL]``: records of an id
    and a 16-bit size; else the archive's size in front. Type 2 is a name.
    """
    short = data.startswith(b"[STRTBL]")
    indexed = data.startswith(b"UF01")
    mark = 8 if short else 4 if indexed else 0
    at = mark + (8 if short else 4)
    stop = len(data) - at if short else little(data, mark)
    out: Pieces = [("raw", data[:at])] if short else [("raw", data[:mark]), ("", b"")]
    first: list[int] = []
    while at < min(stop, len(data)):
        kind, width = little(data, at), 2 if short else 4
        size = little(data, at + 4, width)
        low = at + 4 + width
        body = data[low : low + size]
        end = body.find(b"\xff" if short else b"\0")
        end = size if end <= 0 else end
        first.append(len(out))
        text = ("name" if kind == 2 and not short else "text", xor_bytes(body[:end], b"\xff"))
        out += [("raw", data[at : at + 4]), (f"size {width} 4 0", b""), ("xor ff", b""), text, ("end", b""), ("raw", body[end:])]
        at = low + size
    if not short:
        out[1] = (f"at 4 {len(out)} -1", b"")
    if indexed and len(data) - at == 4 * len(first):
        return [*out, *[(f"at 4 {p} -1", b"") for p in first]]
    return [*out, ("raw", data[at:])]


def sized_blocks(data: bytes) -> Pieces:
    """Blocks of a size: ``S`` with a text of so many bytes, ``T`` with one of so many 16-bit units, each XORed with that
    number; others are commands."""
    out, at = [], 0
    while at + 5 <= len(data) and 0 < (size := little(data, at)) <= 0xFFFF:
        low, end = at + 4, at + 4 + size
        pre = {0x53: 1, 0x54: 5}.get(data[low])
        n = little(data, low + pre) * (2 if pre == 5 else 1) if pre else 0
        if pre and low + pre + 4 + n <= end and not (pre == 1 and n > 0xFF):
            begin = low + pre + 4
            spec = "size1" if pre == 1 else "half2"
            key = data[begin - 4 : begin - 3] if pre == 1 else data[begin - 4 : begin - 2]
            inner = [("raw", data[low : low + pre]), ("size 4 3 0" if pre == 1 else "half 4 3 0", b""), (f"xor {spec}", b""), ("text", xor_bytes(data[begin : begin + n], key)), ("end", b""), ("raw", data[begin + n : end])]
        else:
            inner = [("raw", data[low:end])]
        out += [(f"size 4 {len(inner)} 0", b""), *inner]
        at = end
    return [*out, ("raw", data[at:])]


# ---- pointer tables and sections -------------------------------------------------------------------------------------


def pointer_sections(data: bytes, sections: int = 4) -> Pieces:
    """Sections of an offset and a count: tables of addresses of texts that end with two zeros."""
    items: list[list[bytes]] = []
    for s in range(sections):
        low, count = little(data, 8 * s), little(data, 8 * s + 4)
        if low + 4 * count > len(data):  # no table that reaches beyond its file
            return [("raw", data)]
        found = []
        for k in range(count):
            begin = little(data, low + 4 * k)
            end = data.find(b"\0\0", begin)
            if end < 0:
                return [("raw", data)]
            found.append(data[begin:end])
        items.append(found)
    out: Pieces = []
    place = 2 * sections
    for found in items:
        out += [(f"at 4 {place} -1", b""), ("raw", len(found).to_bytes(4, "little"))]
        place += 3 * len(found)
    for found in items:
        table = len(out)
        out += [(f"at 4 {table + len(found) + 2 * k} -1", b"") for k in range(len(found))]
        for text in found:
            out += [("text", text), ("raw", b"\0\0")]
    return out


#: By version: what the parameters of a command are. 0: a number, -1: the address of a string, 1: that of a text.
STRING_PARAMETERS: dict[int, dict[int, list[int]]] = {
    1: {0x5E: [1, -1, 1], 0x65: [0, 1], 0x6B: [-1], 0x6D: [-1], 0x6F: [-1], 0x70: [-1], 0x72: [-1], 0x84: [-1], 0xAA: [1, 1, 1, 1, 1]},
    2: {0x5E: [1, -1, 1], 0x65: [0, 1], 0x6A: [1, 1, 0, -1, -1], 0x6B: [-1], 0x6C: [-1], 0x6D: [-1], 0x6E: [-1], 0x80: [-1]},
    3: {0x5E: [0, 0, -1, 1], 0x65: [0, 1], 0x6B: [-1], 0x6D: [-1], 0x6F: [-1], 0x70: [-1], 0x72: [-1], 0x7A: [-1], 0x86: [-1]},
    4: {0x5E: [1, -1, 1], 0x65: [0, 1], 0x6D: [-1], 0x6F: [-1], 0x71: [-1], 0x72: [-1], 0x74: [-1], 0x8A: [-1]},
    5: {0x5E: [1, -1, 1], 0x64: [0, 1], 0x60: [-1], 0x6D: [-1], 0x6F: [-1], 0x71: [-1], 0x72: [-1], 0x74: [-1], 0x7C: [-1], 0x7D: [-1], 0x8A: [-1]},
    6: {0x5E: [1, -1, 1, 0], 0x64: [0, 1], 0x60: [-1], 0x6C: [-1], 0x6E: [-1], 0x70: [-1], 0x71: [-1], 0x73: [-1], 0x7B: [-1], 0x7C: [-1], 0x89: [-1]},
}
_MESSAGE, _NO_STRING = 0x5E, 0xFFFFFFFF


def command_strings(version: int):
    """A header, commands (number, size, 32-bit parameters) and strings, XORed with 7F, that parameters point into.

    Texts are the strings that a parameter of a text command points to; the first of a message is a name.
    """
    codes = STRING_PARAMETERS[version]

    def read(data: bytes) -> Pieces:
        size = little(data, 16)
        commands, low = data[20 : 20 + size], 24 + size
        strings = xor_bytes(data[low : low + little(data, low - 4)], b"\x7f").split(b"\0")
        number, at = {}, 0
        for k, s in enumerate(strings):
            number[at] = k
            at += len(s) + 1
        kinds = ["raw"] * len(strings)
        cut: list[tuple[bytes, int | None]] = []
        at = 0
        while at + 1 < len(commands) and commands[at + 1]:
            code, end = commands[at], at + commands[at + 1]
            cut.append((commands[at : at + 4], None))
            for i in range(commands[at + 1] // 4 - 1):
                p = little(commands, at + 4 + 4 * i)
                use = codes[code][i] if code in codes and i < len(codes[code]) else 0
                hit = number.get(p) if use and p != _NO_STRING else None
                if hit is not None and use == 1:
                    kinds[hit] = "name" if code == _MESSAGE and i == 0 else kinds[hit] if kinds[hit] == "name" else "text"
                cut.append((commands[at + 4 + 4 * i : at + 8 + 4 * i], hit))
            at = end
        cut.append((commands[at:], None))
        body = 2 + len(cut) + 2  # pieces before the first string: header, size, commands, size, xor
        out: Pieces = [("raw", data[:16]), (f"size 4 {len(cut)} 0", b"")]
        out += [("raw", raw) if hit is None else (f"at 4 {body + 2 * hit} {body}", b"") for raw, hit in cut]
        inner: Pieces = []
        for k, s in enumerate(strings):
            inner += [(kinds[k], s), ("raw", b"\0" if k + 1 < len(strings) else b"")]
        out += [(f"size 4 {len(inner) + 2} 0", b""), ("xor 7f", b""), *inner, ("end", b"")]
        return [*out, ("raw", data[low + little(data, low - 4) :])]

    return read


def string_sections(message: int, select: int, key: bytes = b""):
    """``YSTB``-like files: a header of 32 bytes with the sizes of commands, parameters, strings and the rest, each XORed.

    A command is a number, a count of parameters and two bytes; a parameter four bytes, a size and an offset into the
    strings. Strings of message commands are texts, those of select commands choices.
    """

    def read(data: bytes) -> Pieces:
        sizes = [little(data, at) for at in (0x0C, 0x10, 0x14, 0x18)]
        if len(data) < 0x20 + sum(sizes):
            return [("raw", data)]
        cuts = [0x20 + sum(sizes[:k]) for k in range(5)]
        commands, parameters, strings, rest = (xor_bytes(data[a:b], key) for a, b in zip(cuts, cuts[1:], strict=False))
        rows = [(parameters[at : at + 4], little(parameters, at + 4), little(parameters, at + 8)) for at in range(0, len(parameters) - 11, 12)]
        offsets = sorted({offset for _, size, offset in rows if size and offset < len(strings)})
        number = {offset: k for k, offset in enumerate(offsets)}
        texts = [strings[a:b] for a, b in zip(offsets, [*offsets[1:], len(strings)], strict=True)]
        kinds, p = ["raw"] * len(texts), 0
        for at in range(0, len(commands) - 3, 4):
            kind = {message: "text", select: "select"}.get(commands[at])
            for _, size, offset in rows[p : p + commands[at + 1]] if kind else ():
                if size and offset in number:
                    kinds[number[offset]] = kind
            p += commands[at + 1]
        code = key.hex()
        inner: Pieces = []
        base = 11 + 3 * len(rows)  # the strings' first piece: see ``out``
        for raw, size, offset in rows:
            hit = number.get(offset) if size else None
            inner.append(("raw", raw))
            inner += [("raw", size.to_bytes(4, "little")), ("raw", offset.to_bytes(4, "little"))] if hit is None else [(f"len 4 {base + hit} {size - len(texts[hit])}", b""), (f"at 4 {base + hit} {base}", b"")]
        mark = ("xor " + (code or "00"), b"")
        before = strings[: offsets[0]] if offsets else strings
        # the strings' size: from the first string to the mark behind the last
        out: Pieces = [("raw", data[:0x14]), (f"at 4 {base + len(texts)} {base}", b""), ("raw", data[0x18:0x20]), ("raw", b"")]
        out += [mark, ("raw", commands), ("end", b""), mark, *inner, ("raw", parameters[12 * len(rows) :]), ("end", b""), mark]
        if before or len(out) != base:
            return [("raw", data)]
        out += [(k, t) for k, t in zip(kinds, texts, strict=True)]
        out += [("end", b""), mark, ("raw", rest), ("end", b""), ("raw", data[cuts[4] :])]
        return out

    return read


#: By version: how a message, a choice and a jump begin.
COMMAND_SIGNS = {
    0: (rb"\x1f\0{5}", rb"[\x1d\x11\x1c]\0{5}", rb"[\x04\x05\x0a\x0d]\0"),
    1: (rb"\x1b\0{5}", rb"\x16\0{5}", rb"[\x04\x05\x0a\x0d]\0"),
    2: (rb"\x1e\0{5}", rb"\x1b\0{5}", rb"[\x04\x05\x0a\x0d]\0"),
}


def signed_commands(version: int):
    """A header of 16 bytes, then commands of a 16-bit size that counts itself; texts are a size, ``07``, bytes and a zero.

    A message has a name and a text, a choice any number of texts. A jump holds the address of a command, counted from the
    header's end: it is joined to the command that stands there and follows it.
    """
    message, select, jump = (re.compile(s) for s in COMMAND_SIGNS[version])

    def texts(body: bytes, kinds: list[str]) -> Pieces:
        out: Pieces = [("raw", body[:10])]
        at, last = 10, 10
        for kind in kinds or iter(lambda: "select", None):
            if at + 1 >= len(body) or body[at + 1] not in (0x07, 0x06, 0x1C, 0x05, 0x04) or not body[at]:
                break
            size = body[at]
            if body[at + 1] == 0x07 and size > 2:
                out += [("raw", body[last:at]), ("size 1 3 1", b""), ("raw", b"\x07"), (kind, body[at + 2 : at + size - 1]), ("raw", body[at + size - 1 : at + size])]
                last = at + size
            at += size
        return [*out, ("raw", body[last:])]

    def read(data: bytes) -> Pieces:
        commands, at = [], 16
        while at + 2 <= len(data):
            size = little(data, at, 2)
            if not size:
                return [("raw", data)]
            commands.append((at - 16, data[at + 2 : at + size]))
            at += size
        out: Pieces = [("raw", data[:16])]
        place, jumps = {}, []
        for address, body in commands:
            place[address] = len(out)
            if message.match(body):
                inner = texts(body, ["name", "text"])
            elif select.match(body):
                inner = texts(body, [])
            elif jump.match(body) and len(body) >= 6:
                jumps.append((len(out) + 2, little(body, 2)))
                inner = [("raw", body[:2]), ("raw", body[2:6]), ("raw", body[6:])]
            else:
                inner = [("raw", body)]
            out += [(f"size 2 {len(inner)} 2", b""), *inner]
        for p, address in jumps:
            if address >= 0x80 and address in place:
                out[p] = (f"at 4 {place[address]} 1", b"")
        return out

    return read


# ---- a stream cipher -------------------------------------------------------------------------------------------------

#: How the key changes, by the low three bits of the byte before: (changed, bytes added up, constant, whether that byte is added).
KEY_STEPS: list[list[tuple[int, tuple[int, ...], int, bool]]] = [
    [(0, (0,), 0, True), (3, (3,), 2, True), (4, (2,), 11, True), (8, (6,), 7, False)],
    [(2, (9, 10), 0, False), (6, (7, 15), 0, False), (8, (8, 1), 0, False), (15, (5, 3), 0, False)],
    [(1, (1, 2), 0, False), (5, (5, 6), 0, False), (7, (7, 8), 0, False), (10, (10, 11), 0, False)],
    [(9, (2, 1), 0, False), (11, (6, 5), 0, False), (12, (8, 7), 0, False), (13, (11, 10), 0, False)],
    [(0, (1,), 111, False), (3, (4,), 71, False), (4, (5,), 17, False), (14, (15,), 64, False)],
    [(2, (2, 10), 0, False), (4, (5, 12), 0, False), (6, (8, 14), 0, False), (8, (11, 0), 0, False)],
    [(9, (11, 1), 0, False), (11, (13, 3), 0, False), (13, (15, 5), 0, False), (15, (9, 7), 0, False), (1, (9, 5), 0, False), (2, (10, 6), 0, False), (3, (11, 7), 0, False), (4, (12, 8), 0, False)],
    [(1, (9, 5), 0, False), (2, (10, 6), 0, False), (3, (11, 7), 0, False), (4, (12, 8), 0, False)],
]
CIPHER_START = 0x14


def stream_cipher(data: bytes, encrypt: bool = False) -> bytes:
    """Bytes from 20 on XORed with a key of 16 bytes (from 4 on) that changes after every 16, by the plain byte before."""
    key, out = bytearray(data[4:CIPHER_START]), bytearray(data)
    for low in range(CIPHER_START, len(data), 16):
        part = xor_bytes(data[low : low + 16], bytes(key))
        out[low : low + 16] = part
        if len(part) == 16:
            plain = data[low + 15] if encrypt else part[15]
            for to, added, constant, with_byte in KEY_STEPS[plain & 7]:
                key[to] = (sum(key[i] for i in added) + constant + (plain if with_byte else 0)) & 0xFF
    return bytes(out)


def ciphered_strings(data: bytes) -> Pieces:
    """Strings between zeros behind a header of 20 bytes, all but which is ciphered."""
    plain = stream_cipher(data)
    return [("raw", plain[:CIPHER_START]), *_texts(plain[CIPHER_START:], re.compile(rb"\0+"))]


def assemble_ciphered(pieces: Pieces) -> bytes:
    return stream_cipher(b"".join(p for _, p in pieces), encrypt=True)
