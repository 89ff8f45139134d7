"""Small files of each binary layout, written field by field from a name and a text, for the layouts' queries and tests."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.charset import xor_bytes
from ..sources.scripts import stream_cipher


def u8(n: int) -> bytes:
    return struct.pack("<B", n)


def u16(n: int) -> bytes:
    return struct.pack("<H", n)


def u32(n: int) -> bytes:
    return struct.pack("<I", n)


def _sized(data: bytes) -> bytes:
    return u32(len(data)) + data


def lines(name: bytes, text: bytes) -> bytes:
    return name + b"\r\n" + text


def lines_xor(name: bytes, text: bytes) -> bytes:
    return xor_bytes(lines(name, text), b"\xff")


def headed_strings(name: bytes, text: bytes) -> bytes:
    body = name + b"\0" + text + b"\0"
    return u32(12 + len(body)) + u32(6) + b"\0\0" + u16(3) + bytes(4) + bytes(6 + 6) + body


def section_strings(name: bytes, text: bytes) -> bytes:
    body = name + b"\0" + text
    return bytes(8) + u32(20) + u32(len(body)) + b"MOON" + body


def counted_aligned(name: bytes, text: bytes) -> bytes:
    return b"\0\0\0\0" + b"".join(_sized(t) + bytes(-len(t) % 4) for t in (name, text)) + b"\1\2"


def counted_packed(name: bytes, text: bytes) -> bytes:
    body = b"".join(struct.pack(">I", len(t)) + t for t in (name, text))
    packed = zlib.compress(body)
    packed = body if len(packed) == len(body) else packed  # equal sizes say that it isn't deflated
    return bytes(20) + u32(len(body)) + u32(len(packed)) + packed


def length_commands(name: bytes, text: bytes) -> bytes:
    commands = [u32(0x00150050) + name, u32(0x00020007) + b"xyz", u32(0x12340000) + text]
    return u32(len(commands)) + b"".join(u16(len(c)) + c for c in commands)


def length_macros(name: bytes, text: bytes) -> bytes:
    return u16(len(name)) + name + u16(len(text)) + text


def marked_dialogue(name: bytes, text: bytes) -> bytes:
    mark = "[テキスト表示]".encode("cp932")
    return b"NEKOSDK_ADVSCRIPT2" + bytes(6) + _sized(mark) + _sized(name + b"\0") + _sized(text + b"\0") + b"\7\7" + _sized(mark) + u32(1) + b"\0" + _sized(text + b"\0")


def typed_separators(name: bytes, text: bytes) -> bytes:
    return b"\x02\x02char\0x" + name + b"\0\x05%L" + text + b"%K\x00%L" + text + b"%K\x09"


def stack_strings(name: bytes, text: bytes) -> bytes:
    name, text = name[:200], text[:200]
    code = b"\x01\x00\x01" + b"\x0e" + u8(len(name) + 1) + name + b"\0" + b"\x02\0\0\0\0\x0e\x01\0\x04" + b"\x0e" + u8(len(text) + 1) + text + b"\0"
    return u32(4 + len(code)) + code + b"tail"


def typed_segments(name: bytes, text: bytes) -> bytes:
    line = bytes(12) + u32(len(name)) + u32(len(text)) + name + xor_bytes(text, b"\x2b\xc5\x2a\x3d")
    choice = bytes(8) + u32(len(text)) + text
    body = u32(8) + u32(len(line)) + line + u32(0x99) + u32(3) + b"abc" + u32(0x0E) + u32(len(choice)) + choice
    return bytes(0x48) + u32(len(body)) + body


def inverted_records(name: bytes, text: bytes) -> bytes:
    records = [name + b"\0\1" + text + b"\0", text + b"\0\0\5\5"]
    return b"[SCR-MESSAGE]" + b"\0\0\0\x03" + b"\1\2" + b"".join(_sized(xor_bytes(r, b"\xff")) for r in records) + u32(0) + b"tail"


def string_table(name: bytes, text: bytes) -> bytes:
    at, body, places = 8, b"", []
    for kind, t in ((2, name), (0, text)):
        places.append(at + len(body))
        data = xor_bytes(t, b"\xff") + b"\0\1"
        body += u32(kind) + _sized(data)
    return b"UF01" + u32(at + len(body)) + body + b"".join(map(u32, places))


def sized_blocks(name: bytes, text: bytes) -> bytes:
    name, text = (t.decode("utf-8").encode("utf-16-le") for t in (name, text))
    name = name[:200]
    blocks = [b"S" + _sized(xor_bytes(name, u8(len(name)))) + b"\xfe", b"M123", b"T1234" + u32(len(text) // 2) + xor_bytes(text, u16(len(text) // 2))]
    return b"".join(map(_sized, blocks)) + u32(0) + b"tail"


def pointer_sections(name: bytes, text: bytes) -> bytes:
    heads, body, at = b"", b"", 32
    for section in ([name], [], [text, name], [text]):
        heads += u32(at + len(body)) + u32(len(section))
        place = at + len(body) + 4 * len(section)
        table, items = b"", b""
        for t in section:
            table += u32(place + len(items))
            items += t + b"\0\0"
        body += table + items
    return heads + body


def string_sections(name: bytes, text: bytes) -> bytes:
    key = b"\x96\xac\x6f\xd3"
    strings, commands = [b"label", name, text], bytes([0x10, 1, 0, 0, 0x5A, 1, 0, 0, 0x1C, 1, 0, 0])
    parameters, at = b"", 0
    for s in strings:
        parameters += b"\3\0\3\0" + u32(len(s)) + u32(at)
        at += len(s)
    parts = [commands, parameters, b"".join(strings), b"rest"]
    return b"YSTB" + u32(0x1D0) + u32(3) + b"".join(u32(len(p)) for p in parts) + bytes(4) + b"".join(xor_bytes(p, key) for p in parts)


def command_strings_1(name: bytes, text: bytes) -> bytes:
    strings = [b"file", name, text, b""]
    at = [sum(len(s) + 1 for s in strings[:k]) for k in range(4)]
    commands = b"\x6b\x08\0\0" + u32(at[0]) + b"\x11\x08\0\0" + u32(77) + b"\x5e\x10\0\0" + u32(at[1]) + u32(0xFFFFFFFF) + u32(at[2])
    return bytes(16) + _sized(commands) + _sized(xor_bytes(b"\0".join(strings), b"\x7f"))


def signed_commands_0(name: bytes, text: bytes) -> bytes:
    name, text = name[:200], text[:200]
    one = lambda t: u8(len(t) + 3) + b"\x07" + t + b"\0"
    message = b"\x1f" + bytes(9) + one(name) + one(text)
    filler = b"\x55" + bytes(130)
    size = lambda body: u16(len(body) + 2) + body
    first = size(message) + size(filler)
    jump = b"\x04\0" + u32(len(first)) + b"\1\1"
    choice = b"\x1d" + bytes(9) + one(text) + b"\3\x06\0" + one(name)
    return bytes(16) + size(message) + size(filler) + size(choice) + size(jump)


def ciphered_strings(name: bytes, text: bytes) -> bytes:
    return stream_cipher(bytes(range(20)) + name + b"\0\0\0" + text + b"\0", encrypt=True)


#: The texts of a file of each layout, in order: n for the name, t for the text, with their kinds.
CONTENTS: dict[str, list[tuple[str, str]]] = {
    **{k: [("n", "text"), ("t", "text")] for k in ("lines", "lines_xor", "headed_strings", "section_strings", "counted_aligned", "counted_packed", "length_commands", "length_macros", "stack_strings", "sized_blocks", "ciphered_strings")},
    "marked_dialogue": [("n", "name"), ("t", "text"), ("t", "text")],
    "typed_separators": [("n", "name"), ("t", "text"), ("t", "text")],
    "typed_segments": [("t", "text"), ("t", "select")],
    "inverted_records": [("n", "name"), ("t", "text"), ("t", "select")],
    "string_table": [("n", "name"), ("t", "text")],
    "pointer_sections": [("n", "text"), ("t", "text"), ("n", "text"), ("t", "text")],
    "string_sections": [("n", "text"), ("t", "select")],
    "command_strings_1": [("n", "name"), ("t", "text")],
    "signed_commands_0": [("n", "name"), ("t", "text"), ("t", "select"), ("n", "select")],
}
MAKERS: dict[str, Callable[[bytes, bytes], bytes]] = {k: globals()[k] for k in CONTENTS}


def blob(layout: str, name: Column, text: Column) -> Column:
    @F.pandas_udf("binary")
    def run(n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([MAKERS[layout](a.encode(), b.encode()) for a, b in zip(n, t, strict=True)], dtype=object)

    return run(name, text)
