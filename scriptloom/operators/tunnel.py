"""Characters that a charset lacks, sent through it as codes that no character uses (survey X15).

Which character gets which code is a relation over the corpus: the n-th character, by the place where it is first seen, gets the
n-th code. It is one aggregate of distinct characters, so any partitioning gives the same codes. Translation looks each character up in
Arrow batches: natively it is a pattern over the hex digits of all characters, ten times as long.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codepage
from .dictionary import first_seen

#: Second bytes that would read as a tab, a line break, a space or a comma.
AVOIDED = b"\t\n\r ,"


def codes() -> list[bytes]:
    """The codes in their order: first bytes of two-byte characters, second bytes below those of any character."""
    leads = [*range(0x81, 0xA0), *range(0xE0, 0xFE)]
    return [bytes((lead, trail)) for lead in leads for trail in range(0x01, 0x40) if trail not in AVOIDED]


def tunnel_codes(rows: DataFrame, text_col: str, order: list[str], encoding: str = "cp932") -> DataFrame:
    """``char, code int``: the characters that the charset lacks, numbered from 0 as first seen in the order; null texts have none.

    A text's own order of first places is that of its distinct characters, so at most these leave it.
    """
    lacking = rows.select(*order, F.array_distinct(F.split(codepage.unencodable(F.col(text_col), encoding), "")).alias("chars"))
    each = lacking.select(*order, F.posexplode("chars").alias("nth", "char")).where("char <> ''")
    first = first_seen(each, "char", [*order, "nth"])
    # as many rows as characters that the charset lacks, a million at most
    return first.select(F.col("text").alias("char"), (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


def code_map(numbered: DataFrame) -> dict[str, bytes]:
    """The codes of :func:`tunnel_codes` as a constant: a few thousand at most, more are an error."""
    room = codes()
    found = numbered.limit(len(room) + 1).collect()
    if len(found) > len(room):
        raise ValueError(f"more than {len(room)} characters need a code")
    return {r["char"]: room[r["code"]] for r in found}


#: Texts that a worker holds as objects at once.
SLICE_ROWS = 64


def _each(values: Column, kind: str, known: Callable[[], Callable]) -> Column:
    """``one(value)`` of each value that isn't null, ``one`` being made by ``known`` once a batch; null where it finds something unknown."""
    arrow = pa.binary() if kind == "binary" else pa.string()

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        one = known()

        def tried(x):
            try:
                return None if x is None else one(x)
            except KeyError:
                return None

        made = [pa.array(map(tried, column.slice(at, SLICE_ROWS).to_pylist()), arrow) for at in range(0, len(column), SLICE_ROWS)]
        return pa.concat_arrays(made) if made else pa.array([], arrow)

    return run(values)


def tunnel_encoded(text: Column, numbered: dict[str, bytes], encoding: str = "cp932") -> Column:
    """The bytes of a text, null where a character has neither bytes nor a code: as :func:`.codepage.encoded`, a look-up a character."""

    def known() -> Callable:
        bytes_of = {**{chr(k): bytes((k,)) for k in range(0x80)}, **codepage.characters(encoding), **numbered}.__getitem__
        return lambda t: b"".join(map(bytes_of, t))

    return _each(text, "binary", known)


def tunnel_decoded(data: Column, numbered: dict[str, bytes], encoding: str = "cp932") -> Column:
    """The text of bytes, null where some are no character: as :func:`.codepage.decoded`."""

    def known() -> Callable:
        back = {b: c for c, b in codepage.characters(encoding).items() if b.decode(encoding) == c}
        char_of = {**{bytes((k,)): chr(k) for k in range(0x80)}, **back, **{b: c for c, b in numbered.items()}}.__getitem__
        cut = codepage.character_bytes(encoding).findall
        return lambda b: "".join(map(char_of, cut(b)))

    return _each(data, "string", known)


def tunnel_file(numbered: DataFrame) -> bytes:
    """What a reader of tunneled text needs: the characters in the order of their codes, in UTF-16."""
    return "".join(sorted(found := code_map(numbered), key=found.get)).encode("utf-16-le")
