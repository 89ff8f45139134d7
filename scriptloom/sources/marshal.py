"""Ruby Marshal 4.8 streams as JSON texts (survey S11, D15), from the public format description.

Values map to JSON as: nil, booleans, integers, floats and strings to themselves, arrays and string-keyed hashes to theirs,
everything else to an object with a ``@kind``. Decoding runs per file in Arrow batches; a Ruby file is one unit.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


class Reader:
    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\x04\x08":
            raise ValueError("not a Marshal 4.8 stream")
        self.data, self.at = data, 2
        self.symbols: list[str] = []
        self.objects: list = []

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        c = int.from_bytes(self.take(1), "little", signed=True)
        if c == 0:
            return 0
        if 1 <= c <= 4:
            return int.from_bytes(self.take(c), "little")
        if -4 <= c <= -1:
            return int.from_bytes(self.take(-c), "little") - (1 << (8 * -c))
        return c - 5 if c > 0 else c + 5

    def blob(self) -> bytes:
        return self.take(self.long())

    def keep(self, value):
        self.objects.append(value)
        return value

    def pairs(self) -> list:
        return [(self.value(), self.value()) for _ in range(self.long())]

    def value(self):
        tag = chr(self.take(1)[0])
        if tag in "0TF":
            return {"0": None, "T": True, "F": False}[tag]
        if tag == "i":
            return self.long()
        if tag == ":":
            self.symbols.append(self.blob().decode("utf-8", "replace"))
            return {"@kind": "symbol", "name": self.symbols[-1]}
        if tag == ";":
            return {"@kind": "symbol", "name": self.symbols[self.long()]}
        if tag == "@":
            return self.objects[self.long()]
        if tag == "I":
            value = self.value()
            slots = {k["name"]: v for k, v in self.pairs()}
            if isinstance(value, dict) and value.get("@kind") == "bytes" and (slots.get("E") is not None or "encoding" in slots):
                raw = base64.b64decode(value["data"])
                text = raw.decode("utf-8", "surrogateescape")
                if text.isprintable() or "\n" in text or not text:
                    return text
            return value
        if tag == '"':
            return self.keep({"@kind": "bytes", "data": base64.b64encode(self.blob()).decode()})
        if tag == "f":
            text = self.blob().decode()
            return self.keep(float(text) if text not in ("nan", "inf", "-inf") else {"@kind": "float", "text": text})
        if tag == "l":
            sign = -1 if self.take(1) == b"-" else 1
            return self.keep(sign * int.from_bytes(self.take(self.long() * 2), "little"))
        if tag == "[":
            out = self.keep([])
            out.extend(self.value() for _ in range(self.long()))
            return out
        if tag in "{}":
            out = self.keep({})
            pairs = self.pairs()
            if all(isinstance(k, str) for k, _ in pairs) and tag == "{":
                out.update(pairs)
            else:
                out |= {"@kind": "hash", "pairs": [list(p) for p in pairs]}
            if tag == "}":
                out["default"] = self.value()
            return out
        if tag in "oS":
            out = self.keep({"@kind": "object" if tag == "o" else "struct"})
            out["class"] = self.value()["name"]
            out["slots"] = {k["name"]: v for k, v in self.pairs()}
            return out
        if tag == "u":
            out = self.keep({"@kind": "dumped", "class": self.value()["name"]})
            out["data"] = base64.b64encode(self.blob()).decode()
            return out
        if tag in "UCed":
            out = self.keep({"@kind": {"U": "marshalled", "C": "subclass", "e": "extended", "d": "data"}[tag]})
            out["class"] = self.value()["name"]
            out["value"] = self.value()
            return out
        if tag in "cmM":
            return self.keep({"@kind": "class" if tag == "c" else "module", "name": self.blob().decode()})
        if tag == "/":
            return self.keep({"@kind": "regexp", "source": self.blob().decode("utf-8", "replace"), "options": self.take(1)[0]})
        raise ValueError(f"unknown tag {tag!r} at {self.at - 1}")


def to_json(data: bytes) -> str:
    return json.dumps(Reader(data).value(), ensure_ascii=False)


def marshal_texts(blobs: DataFrame, data_col: str = "data") -> DataFrame:
    """``file, json, error``: a file that can't be read has an error instead of JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for data in batch[data_col].to_pylist():
                try:
                    texts.append(to_json(data))
                    errors.append(None)
                except (ValueError, IndexError, KeyError, TypeError) as e:
                    texts.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["file", "json", "error"])

    return blobs.select("file", data_col).mapInArrow(run, "file string, json string, error string")
