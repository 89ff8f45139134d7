"""Names of files and of run settings (survey S1, W8, X30 to X32)."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """``%NAME%`` replaced by what the environment says; unknown names stay."""
    known = os.environ if env is None else env
    return re.sub(r"%(\w+)%", lambda m: known.get(m[1], m[0]), text)


def reencode_name(name: str, wrong: str = "cp437", right: str = "cp932") -> str:
    """A name that was read in the wrong encoding; as it is where that can't be."""
    try:
        return name.encode(wrong).decode(right)
    except UnicodeError:
        return name


def natural_key(name: Column) -> Column:
    """A sort key in which numbers count by value: each run of digits padded to 20, letters folded."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]")), F.lpad(p, 20, "0")).otherwise(p)), "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches(path: Column, pattern: str | None) -> Column:
    """Whether a file name is chosen by a pattern; all are without one."""
    return F.regexp_like(basename(path), F.lit(pattern)) if pattern else F.lit(True)
