"""Binary script layouts as ordered units (survey E1 to E22, F15, S14, section 2.10): a registry of readers and writers.

A layout cuts a file into pieces, ``raw`` bytes and ``text`` units, and puts changed pieces together again with lengths,
checks and padding made anew. Files are independent: reading is one pass of Arrow batches, rebuilding one group per file.
No sample of the formats is at hand; what is tested is that rebuilding unchanged pieces gives the file, byte for byte, and
that changed texts keep a file readable.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scripts
from ..functions.charset import fit_bytes, xor_bytes
from ..shared import slices
from .assemble import TEXTS, Pieces, assemble


@dataclass(frozen=True)
class Layout:
    """``read`` gives the pieces of a file, ``write`` the file of pieces; ``encoding`` is that of its texts."""

    read: Callable[[bytes], Pieces]
    write: Callable[[Pieces], bytes]
    encoding: str = "cp932"
    fixed: bool = False  # texts keep their size in bytes

    def pieces(self, data: bytes) -> Pieces:
        """The pieces of a file; a file that can't be read, or wouldn't be written as it was, is one raw piece."""
        try:
            found = self.read(data)
            whole = self.write(found) == data
        except (IndexError, KeyError, ValueError, OverflowError, zlib.error):
            whole = False
        return found if whole else [("raw", data)]


def _between(data: bytes, low: int, high: int, separator: bytes) -> Pieces:
    """Texts between separators in a section, with what stands around it and the separators as raw pieces."""
    out: Pieces = [("raw", data[:low])]
    for k, part in enumerate(data[low:high].split(separator)):
        out += [("raw", separator)] * (k > 0) + [("text", part)]
    return [*out, ("raw", data[high:])]


def _joined(pieces: Pieces) -> bytes:
    return b"".join(p for _, p in pieces)


def separated(separator: bytes, key: bytes = b"", encoding: str = "cp932") -> Layout:
    """A file of separated texts, XORed with a key if there is one."""
    return Layout(lambda d: _between(x := xor_bytes(d, key), 0, len(x), separator), lambda p: xor_bytes(_joined(p), key), encoding)


def _u32(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def _read_headed(data: bytes) -> Pieces:
    # the header's size is 16, a section's size at 4, and two bytes for each entry counted at 10
    start = _u32(data, 4) + 2 * int.from_bytes(data[10:12], "little") + 16
    return _between(data, start, len(data), b"\0") if start < len(data) else [("raw", data)]


def _write_headed(pieces: Pieces) -> bytes:
    data = _joined(pieces)
    return data if len(pieces) == 1 else (len(data) - 16).to_bytes(4, "little") + data[4:]


def _read_section(data: bytes) -> Pieces:
    # offset and size of the text section at 8 and 12
    start, size = _u32(data, 8), _u32(data, 12)
    if not 16 <= start <= start + size <= len(data):
        return [("raw", data)]
    texts = _between(data, start, start + size, b"\0")[1:]
    # the size is where the last piece begins, counted from the first text
    return [("raw", data[:12]), (f"at 4 {2 + len(texts)} 3", b""), ("raw", data[16:start]), *texts]


def counted(order: str, accept: re.Pattern, align: int = 1, limit: int = 1 << 16) -> Layout:
    """Texts with a 32-bit length in front, found where the announced bytes match a pattern, padded with zeros to ``align``."""

    def read(data: bytes) -> Pieces:
        out: Pieces = []
        at = last = 0
        while at + 4 < len(data):
            size = int.from_bytes(data[at : at + 4], order)
            end = at + 4 + size
            pad = -size % align
            if 0 < size <= limit and end + pad <= len(data) and accept.fullmatch(data, at + 4, end) and not any(data[end : end + pad]):
                out += [("raw", data[last:at]), ("text", data[at + 4 : end])]
                at = last = end + pad
            else:
                at += 1
        return [*out, ("raw", data[last:])]

    def write(pieces: Pieces) -> bytes:
        return b"".join(p if kind == "raw" else len(p).to_bytes(4, order) + p + bytes(-len(p) % align) for kind, p in pieces)

    return Layout(read, write, "utf-8")


def packed(inner: Layout, header: int) -> Layout:
    """A header that ends with the unpacked and packed sizes, then a body that is deflated where the two differ."""

    def read(data: bytes) -> Pieces:
        head, body = data[:header], data[header:]
        plain, stored = _u32(head, header - 8), _u32(head, header - 4)
        return [("raw", head), *inner.read(zlib.decompress(body) if plain != stored else body)]

    def write(pieces: Pieces) -> bytes:
        head, body = pieces[0][1], inner.write(pieces[1:])
        stored = zlib.compress(body) if _u32(head, header - 8) != _u32(head, header - 4) else body
        stored = body if len(stored) == len(body) else stored  # equal sizes say that it isn't deflated
        return head[: header - 8] + len(body).to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored

    return Layout(read, write, inner.encoding)


#: Text of at least one printable byte: no control bytes but line ends and tabs.
_PRINTABLE = re.compile(rb"[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+", re.DOTALL)

LAYOUTS: dict[str, Layout] = {
    "lines_xor": separated(b"\r\n", b"\xff"),
    "lines": separated(b"\r\n"),
    "headed_strings": Layout(_read_headed, _write_headed),
    "section_strings": Layout(_read_section, assemble),
    "counted_aligned": counted("little", _PRINTABLE, align=4),
    "counted_packed": packed(counted("big", _PRINTABLE), 28),
    "length_commands": Layout(scripts.length_commands, assemble),
    "length_macros": Layout(scripts.length_macros, assemble),
    "marked_dialogue": Layout(scripts.marked_dialogue, assemble),
    "typed_separators": Layout(scripts.typed_separators, assemble),
    "stack_strings": Layout(scripts.stack_strings, assemble, fixed=True),
    "typed_segments": Layout(scripts.typed_segments, assemble),
    "inverted_records": Layout(scripts.inverted_records, assemble),
    "string_table": Layout(scripts.string_table, assemble),
    "sized_blocks": Layout(scripts.sized_blocks, assemble, "utf-16-le"),
    "pointer_sections": Layout(scripts.pointer_sections, assemble),
    "string_sections": Layout(scripts.string_sections(0x5A, 0x1C, b"\x96\xac\x6f\xd3"), assemble),
    "ciphered_strings": Layout(scripts.ciphered_strings, scripts.assemble_ciphered),
    **{f"command_strings_{v}": Layout(scripts.command_strings(v), assemble) for v in scripts.STRING_PARAMETERS},
    **{f"signed_commands_{v}": Layout(scripts.signed_commands(v), assemble) for v in scripts.COMMAND_SIGNS},
}


def register(name: str, layout: Layout) -> None:
    """Adds a layout, or replaces one. A module that does so must be importable on the executors, as this one is."""
    LAYOUTS[name] = layout


#: Files whose pieces a worker holds at once.
SLICE_ROWS = 64


def units(blobs: DataFrame, layout: str, only: str | None = None) -> DataFrame:
    """``file, piece_no, kind, piece`` of ``file, data`` rows. Files whose names don't match ``only`` are one raw piece, null data none."""
    how, wanted = LAYOUTS[layout], re.compile(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            rows = []
            for f, d in zip(batch["file"].to_pylist(), batch["data"].to_pylist(), strict=True):
                pieces = how.pieces(d) if not wanted or wanted.search(f) else [("raw", d)]
                rows += [(f, n, k, p) for n, (k, p) in enumerate(pieces)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "piece_no", "kind", "piece"])

    return blobs.select("file", "data").where("data is not null").mapInArrow(run, "file string, piece_no int, kind string, piece binary")


def texts(pieces: DataFrame, layout: str, encoding: str | None = None) -> DataFrame:
    """``file, piece_no, kind, text``: the texts, names and choices among pieces; empty ones and those that can't be decoded aren't any."""
    from ..functions.charset import decoded

    some = pieces.where(F.col("kind").isin(*TEXTS) & (F.octet_length("piece") > 0))
    return some.select("file", "piece_no", "kind", decoded(F.col("piece"), encoding or LAYOUTS[layout].encoding).alias("text")).where("text is not null")


def with_translations(pieces: DataFrame, translations: DataFrame, layout: str, encoding: str | None = None) -> DataFrame:
    """``pieces`` with ``translations(file, piece_no, translated)`` in place, encoded; where texts are of fixed size, cut or filled to it.

    A translation that can't be encoded leaves its piece as it was.
    """
    how = LAYOUTS[layout]
    code = encoding or how.encoding

    @F.pandas_udf("binary")
    def put(piece: pd.Series, text: pd.Series) -> pd.Series:
        def one(p, t):
            if t is None:
                return p
            try:
                return fit_bytes(t, len(p), code)[0] if how.fixed else t.encode(code)
            except UnicodeEncodeError:
                return p

        return pd.Series([one(p, t) for p, t in zip(piece, text, strict=True)], dtype=object)

    joined = pieces.join(translations.select("file", "piece_no", "translated"), ["file", "piece_no"], "left")
    return joined.select("file", "piece_no", "kind", put(F.col("piece"), F.col("translated")).alias("piece"))


def rebuild(pieces: DataFrame, layout: str) -> DataFrame:
    """``file, data`` of the pieces of each file; a file that is one raw piece is that."""
    how = LAYOUTS[layout]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece_no")
        found = list(zip(table["kind"].to_pylist(), table["piece"].to_pylist(), strict=True))
        data = found[0][1] if len(found) == 1 and found[0][0] == "raw" else how.write(found)
        return pa.table({"file": table["file"][:1], "data": pa.array([data], pa.binary())})

    return pieces.groupBy("file").applyInArrow(run, "file string, data binary")
