"""Byte-exact encodings: Python's codecs in Arrow batches (survey X12 to X17, X20 to X24, P13, P14, A10, A14)."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEPT = re.compile(r"<([0-9A-Fa-f]+)>")


#: Fixed ranges of a two-byte character: first bytes, and the second bytes that may follow.
_PAIRS = re.compile(rb"[\x81-\x9f\xe0-\xef\xfa\xfb][\x40-\x7e\x80-\xfc]|\xfc[\x40-\x4b]")


def is_shift_jis(data: bytes, single: re.Pattern | None = None) -> bool:
    """Whether bytes are two-byte Shift-JIS characters, but for single ones that the pattern allows."""
    at = 0
    while at < len(data):
        alone = single and single.match(data[at : at + 1])
        pair = None if alone else _PAIRS.match(data, at)
        if not alone and not pair:
            return False
        at += 1 if alone else 2
    return True


def keep_bytes(data: bytes, pattern: bytes) -> bytes:
    """Bytes that match become ``<HEX>`` marks."""
    return re.sub(pattern, lambda m: f"<{m[0].hex().upper()}>".encode("ascii"), data)


def encode_text(text: str, encoding: str, marks: bool = False) -> list[bytes]:
    """The bytes of each character; with ``marks``, a ``<HEX>`` mark is one character of those bytes."""
    out, at = [], 0
    while at < len(text):
        mark = _KEPT.match(text, at) if marks else None
        if mark and len(mark[1]) % 2 == 0:
            out.append(bytes.fromhex(mark[1]))
            at = mark.end()
        else:
            out.append(text[at].encode(encoding))
            at += 1
    return out


def fit_bytes(text: str, size: int, encoding: str = "gbk", padding: bytes = b"", cuts: dict[str, str] | None = None, marks: bool = False) -> tuple[bytes, int]:
    """Exactly ``size`` bytes, and by how much the whole translation is shorter (negative: longer).

    A text too long is first replaced by what ``cuts`` says for it, then cut at a character; a short one is filled with whole
    paddings, then spaces.
    """
    parts = encode_text(text, encoding, marks)
    diff = size - sum(map(len, parts))
    if diff < 0 and cuts and cuts.get(text):
        parts = encode_text(cuts[text], encoding, marks)
        diff = size - sum(map(len, parts))
    out = bytearray()
    for part in parts:
        if len(out) + len(part) > size:
            break
        out += part
    lost = size - len(out)
    whole = lost // len(padding) if padding else 0
    return bytes(out + padding * whole + b" " * (lost - whole * len(padding))), diff


def fitted(text: Column, size: Column, encoding: str = "gbk", padding: bytes = b"", cuts: dict[str, str] | None = None) -> Column:
    """``struct<data binary, diff int>``: null for what can't be encoded."""

    @F.pandas_udf("data binary, diff int")
    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for x, k in zip(t, n, strict=True):
            try:
                rows.append(fit_bytes(x, int(k), encoding, padding, cuts) if x is not None else (None, None))
            except UnicodeEncodeError:
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["data", "diff"])

    return run(text, size)


def encoded(text: Column, encoding: str) -> Column:
    @F.pandas_udf("binary")
    def run(t: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else x.encode(encoding)
            except UnicodeEncodeError:
                return None

        return t.map(one)

    return run(text)


def decoded(data: Column, encoding: str) -> Column:
    """Text of bytes; null where they aren't valid."""

    @F.pandas_udf("string")
    def run(d: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else bytes(x).decode(encoding)
            except UnicodeDecodeError:
                return None

        return d.map(one)

    return run(data)


def xor(data: Column, key: bytes) -> Column:
    """Bytes XOR a repeating key."""

    @F.pandas_udf("binary")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: None if x is None else xor_bytes(bytes(x), key))

    return run(data)


def xor_bytes(data: bytes, key: bytes) -> bytes:
    if not data or not key:
        return data
    k = np.frombuffer((key * (len(data) // len(key) + 1))[: len(data)], np.uint8)
    return (np.frombuffer(data, np.uint8) ^ k).tobytes()


def utf8_start(data: bytes, at: int) -> tuple[int, int]:
    """Position and length of the first UTF-8 character that begins at ``at`` or later."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    if at >= len(data):
        return len(data), 0
    b = data[at]
    return at, 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


def read_prefixed(data: bytes, at: int, width: int, scale: int = 1, add: int = 0) -> bytes:
    """What a little-endian length in front announces."""
    length = int.from_bytes(data[at : at + width], "little") * scale + add
    return data[at + width : at + width + length]


def write_prefixed(data: bytes, width: int, scale: int = 1, add: int = 0) -> bytes:
    return ((len(data) - add) // scale).to_bytes(width, "little") + data


#: The dictionary coder's ring size, longest match, and shortest match that pays.
RING, LONGEST, SHORTEST = 4096, 18, 3


def lzss_decompress(data: bytes, fill: int = 0x20) -> bytes:
    """LZSS with flag bytes, lowest bit first (1: a literal), and 12-bit positions in a ring that starts at its end."""
    ring, at = bytearray([fill]) * RING, RING - LONGEST
    out, i, flags = bytearray(), 0, 1

    def put(b: int) -> None:
        nonlocal at
        out.append(b)
        ring[at] = b
        at = (at + 1) % RING

    while i < len(data):
        if flags == 1:
            flags = data[i] | 0x100
            i += 1
            continue
        if flags & 1:
            put(data[i])
            i += 1
        elif i + 1 < len(data):
            start, n = data[i] | (data[i + 1] & 0xF0) << 4, (data[i + 1] & 0x0F) + SHORTEST
            for k in range(n):
                put(ring[(start + k) % RING])
            i += 2
        else:
            break
        flags >>= 1
    return bytes(out)


def lzss_compress(data: bytes) -> bytes:
    """A stream for :func:`lzss_decompress`; matches are looked up by their first three bytes."""
    out, seen, i = bytearray(), {}, 0
    items: list[bytes | None] = []
    flags = 0

    def flush() -> None:
        nonlocal flags
        if items:
            out.append(flags)
            out.extend(b"".join(items))
            items.clear()
            flags = 0

    while i < len(data):
        best, where = 0, 0
        for j in reversed(seen.get(data[i : i + SHORTEST], [])[-64:]):
            if i - j > RING - LONGEST:
                break
            n = SHORTEST
            while n < LONGEST and i + n < len(data) and data[j + n] == data[i + n]:
                n += 1
            if n > best:
                best, where = n, j
        step = best if best >= SHORTEST and i + SHORTEST <= len(data) else 1
        if step > 1:
            pos = (where + RING - LONGEST) % RING
            items.append(bytes((pos & 0xFF, (pos >> 4) & 0xF0 | (best - SHORTEST))))
        else:
            flags |= 1 << len(items)
            items.append(data[i : i + 1])
        for k in range(i, i + step):
            seen.setdefault(data[k : k + SHORTEST], []).append(k)
        i += step
        if len(items) == 8:
            flush()
    flush()
    return bytes(out)


def inflate(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: None if x is None else zlib.decompress(bytes(x)))

    return run(data)


def deflate(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(d: pd.Series) -> pd.Series:
        return d.map(lambda x: None if x is None else zlib.compress(bytes(x)))

    return run(data)


def huffman_codes(counts: dict[int, int]) -> dict[int, str]:
    """Bit strings of byte values by frequency; of equal weights the earlier node goes left."""
    heap = [(n, i, (b,)) for i, (b, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    codes = {b: "" for b in counts}
    serial = len(heap)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a:
            codes[x] = "0" + codes[x]
        for x in b:
            codes[x] = "1" + codes[x]
        heapq.heappush(heap, (n + m, serial, a + b))
        serial += 1
    return codes if len(codes) != 1 else dict.fromkeys(codes, "0")


def byte_histogram(data: bytes) -> dict[int, int]:
    return dict(Counter(data))


def byte_counts(df, data_col: str, keys: list[str]):
    """``keys, byte int, n long``: how often each byte stands in binary values; a partial aggregate of at most 256 rows a key."""
    pairs = F.regexp_extract_all(F.hex(data_col), F.lit("(..)"))
    exploded = df.select(*keys, F.explode(pairs).alias("_b"))
    counted = exploded.groupBy(*keys, "_b").agg(F.count("*").alias("n"))
    return counted.select(*keys, F.conv("_b", 16, 10).cast("int").alias("byte"), "n")
