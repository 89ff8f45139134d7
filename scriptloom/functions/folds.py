"""Line functions with running state, as native folds: the state is a struct that ``aggregate`` carries over characters
(survey X28, X33, X39), and replacements to a fix point as rounds over the rows that still change (X29)."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..regexes import java_pattern, java_replacement
from ..shared import fresh, written
from .codepage import table

#: Where a line may be broken, and the brackets that it mustn't be broken in.
PUNCTUATION = "。、！？…」」，．"
OPENS, CLOSES = "「", "」"


@cache
def _wide(encoding: str) -> str:
    return "".join(c for c, unit in table(encoding) if unit > 0xFFFF)


def paired_quotes(text: Column, opens: str = "“", closes: str = "”") -> Column:
    """Straight double quotes become opening and closing ones in turn; a last one alone opens. No state is needed: pairs are matched as such."""
    safe = [x.replace("\\", "\\\\").replace("$", "\\$") for x in (opens, closes)]
    paired = F.regexp_replace(text, '"([^"]*)"', f"{safe[0]}$1{safe[1]}")
    return F.replace(paired, F.lit('"'), F.lit(opens))


def without_ruby(text: Column, pattern: str = r"\{([^/{}]*)/[^{}]*\}") -> Column:
    """Ruby blocks reduced to their base text, the pattern's first group."""
    return F.regexp_replace(text, pattern, "$1")


def parts_for_slots(text: Column, capacities: list[int], encoding: str = "cp932") -> Column:
    """Parts for slots of given byte capacities: each ends at the farthest punctuation that fits, outside brackets.

    Where no punctuation fits, a part is cut at a character; what is left over goes to the last part. A character that the charset lacks counts as
    one byte. A slot looks at no more characters than it has bytes, and one.
    """
    wide = _wide(encoding)
    number = lambda x: F.lit(x).cast("int")
    punctuation = f"^[\\s\\S]*[{PUNCTUATION}]"

    def once(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def outside(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == OPENS, 1).when(c == CLOSES, -1).otherwise(0)
        cut = F.when((depth <= 0) & F.contains(F.lit(PUNCTUATION), c), s["at"] + 1).otherwise(s["cut"])
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), cut.alias("cut"))

    def last_break(head: Column) -> Column:
        # only a head with an opening bracket needs the fold
        state = F.struct(number(0).alias("depth"), number(0).alias("at"), number(0).alias("cut"))
        folded = F.aggregate(F.filter(F.split(head, ""), lambda c: c != ""), state, outside, lambda s: s["cut"])
        return F.when(F.contains(head, F.lit(OPENS)), folded).otherwise(F.length(F.regexp_extract(head, punctuation, 0)))

    def slot(done: Column, room: Column) -> Column:
        rest = done["rest"]
        # the widths of all characters in one translation: a wide one is Ww, any other one letter
        letters = F.translate(F.substring(rest, F.lit(1), room + 1), wide + "Ww", "W" * len(wide) + "nn")
        bytes_ = F.replace(letters, F.lit("W"), F.lit("Ww"))
        fits = lambda b: F.length(F.replace(F.regexp_replace(F.substring(b, F.lit(1), room), "W\\z", ""), F.lit("w"), F.lit("")))
        measured = once(bytes_, lambda b: F.struct(fits(b).alias("fits"), (F.length(b) > room).alias("over")))

        def cut(m: Column) -> Column:
            broken = lambda b: F.when(b > 0, b).otherwise(m["fits"])
            return F.when(m["over"], once(last_break(F.substring(rest, F.lit(1), m["fits"])), broken)).otherwise(m["fits"])

        parted = lambda at: F.struct(F.concat(done["parts"], F.array(F.substring(rest, F.lit(1), at))).alias("parts"), F.substring(rest, at + 1, F.length(rest)).alias("rest"))
        return once(once(measured, cut), parted)

    begin = F.struct(F.array().cast("array<string>").alias("parts"), text.alias("rest"))
    filled = lambda done: F.concat(done["parts"], F.array(done["rest"]))
    if len(capacities) < 2:
        return F.when(text.isNotNull(), F.array(text))
    return F.when(text.isNotNull(), F.aggregate(F.array(*map(number, capacities[:-1])), begin, slot, filled))


def fixed_point(rows: DataFrame, text_col: str, pairs: list[tuple[str, str]], most: int = 1000, rounds_col: str = "rounds") -> DataFrame:
    """``rows`` with pattern replacements repeated on ``text_col`` until none changes it, and how many rounds did change it.

    Only rows that the last round changed go on to the next, so later rounds are small. Pairs are applied in order in
    each round. After ``most`` rounds rows that still change are an error: the rules then go in circles or grow without end.
    A null text stays null, after no round.
    """
    before, = fresh(rows, "_before")
    rule = reduce(lambda t, p: F.regexp_replace(t, java_pattern(p[0]), java_replacement(p[1])), pairs, F.col(text_col))
    active, ended = rows.withColumn(rounds_col, F.lit(0)), []
    for _ in range(most + 1):
        after = written(active.withColumn(before, F.col(text_col)).withColumn(text_col, rule), "rounds")
        same = F.col(before).eqNullSafe(F.col(text_col))
        ended.append(after.where(same).drop(before))
        active = after.where(~same).drop(before).withColumn(rounds_col, F.col(rounds_col) + 1)
        if active.isEmpty():
            return reduce(DataFrame.unionByName, ended)
    raise ValueError(f"the replacements still change texts after {most} rounds")
