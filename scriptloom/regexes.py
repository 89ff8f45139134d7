"""Python patterns as Java ones, for rules that Spark's own functions can run (survey 7.5)."""

from __future__ import annotations

import re

_PYTHON_ONLY = re.compile(r"\(\?P=|\(\?\(|\\[AZ]|\(\?[aLu]|\{,")


def java_pattern(pattern: str) -> str | None:
    """The pattern for Java, its groups unnamed, or None where the two dialects may differ.

    ``(?dU)`` makes Java's line ends and classes those of Python: only ``\\n`` ends a line, and ``\\s \\d \\w`` are Unicode's.
    """
    if _PYTHON_ONLY.search(pattern) or "[[" in pattern or "&&" in pattern:
        return None
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    return None if "(?<!" in out and "*" in out else "(?dU)" + out


def segments(pattern: str) -> list[tuple[str, bool]] | None:
    """The pattern as a sequence of parts that follow each other, each with whether it is a capture group; None where it isn't one.

    A match is then its parts' matches side by side, so that lengths tell places. That holds where groups are neither nested, nor
    repeated or optional, nor alternatives, where nothing refers back to a group, and where no match is empty.
    """
    if re.search(r"\\[1-9]|\(\?[a-zA-Z-]+\)", pattern):
        return None
    out: list[tuple[str, bool]] = []
    plain, at, depth, begin, group = "", 0, 0, 0, False
    tokens = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<\w+>|\(\?<?[:=!]|\(\?[a-zA-Z-]*:|[()|]|[^\\\[()|]+|.", re.DOTALL)
    for m in tokens.finditer(pattern):
        token, at = m[0], m.end()
        if token.startswith("(") and token[0] != "\\":
            captures = token == "(" or token.startswith("(?P<")
            if captures and depth:
                return None
            if not depth:
                begin, group = m.start(), captures
            depth += 1
        elif token == ")":
            depth -= 1
            if depth < 0:
                return None
            if not depth and group:
                if pattern[at : at + 1] in ("?", "*", "+", "{"):
                    return None
                out += [(plain, False)] if plain else []
                out.append((pattern[begin:at], True))
                plain, group = "", False
            elif not depth:
                plain += pattern[begin:at]
        elif token == "|" and not depth:
            return None
        elif not depth:
            plain += token
    out += [(plain, False)] if plain else []
    low, _ = re._parser.parse(pattern).getwidth()
    return out if not depth and low > 0 and re.compile(pattern).groups == sum(g for _, g in out) else None


def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of the pattern has, as far as its top level shows; '' for none."""
    tree = re._parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    best = run = ""
    todo = list(tree)
    while todo:
        op, value = todo.pop(0)
        if str(op) == "LITERAL":
            run += chr(value)
            best = max(best, run, key=len)
        elif str(op) == "SUBPATTERN" and not value[1] and not value[2]:
            todo = list(value[3]) + todo  # a group without flags of its own stands in the sequence
        elif str(op) != "AT":
            run = ""
    return best


def java_replacement(text: str) -> str:
    """``\\1`` and ``\\g<1>`` as ``$1``; other dollars and backslashes stand for themselves."""
    out, at = [], 0
    for m in re.finditer(r"\\(\d)|\\g<(\d+)>", text):
        out += [text[at : m.start()].replace("\\", "\\\\").replace("$", "\\$"), f"${m[1] or m[2]}"]
        at = m.end()
    return "".join([*out, text[at:].replace("\\", "\\\\").replace("$", "\\$")])
