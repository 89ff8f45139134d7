"""Run options and the rule-text parser (survey P1, P2, P9; D19)."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

#: Punctuation after which a redistributed line may break.
SYMBOLS = "[\u3000-\u303f\uff00-\uff65\u2000-\u206f]"


@dataclass(frozen=True)
class ExtractConfig:
    """Options of a run; the defaults are those of the interactive application."""

    structure: str = ""
    startline: int = 0
    post_skip: str | None = None
    serial_search: bool = False
    name_keep_ctrl: bool = True
    skip_ignore_ctrl: bool = False
    skip_ignore_unfinish: bool = False
    name_list: tuple[str, ...] = ()
    para_sep: str = "\r\n"
    add_space: str = "\u3000"
    max_per_line: int = 512
    max_line_count: int = 3
    add_bytes: str = ""
    allow_empty: bool = False
    name_move_up: bool = False
    import_names: bool = True
    ignore_same_line_count: bool = False
    ignore_not_max_count: bool = False
    fixed_max_per_line: bool = False
    keep_tail: bool = True
    symbols: str = SYMBOLS
    cutoff: bool = False
    cutoff_copy: bool = True
    ignore_decode_error: bool = False
    #: A pattern between units; '' for lines. Without a group in front its matches go (see :func:`separators_kept`).
    separate: str = ""
    write_offset: int = 0
    #: Bytes of a length in front of each capture (little-endian), where it stands ("start": at the match; a number: from
    #: the capture's start; none: just before it), and what makes it the capture's length: length * scale + add.
    pre_len: int = 0
    pre_len_offset: int | str | None = None
    pre_len_scale: int = 1
    pre_len_add: int = 0
    #: The capture ends where the length says, not where the pattern does; the length is rewritten on import.
    pre_len_strict: bool = False
    pre_len_fix: bool = True
    #: Binary texts: their encoding, allowed single bytes among two-byte ones (a pattern; none: no check), and whether
    #: captures that can't be decoded are dropped.
    encoding: str = "cp932"
    check_jis: str | None = None
    #: Bracketed scripts: brackets, what a segment that ends a paragraph or holds a command looks like, the pattern of text
    #: in a segment, and a pattern behind a bracket that keeps it inside the text.
    sep_str: str = "[,]"
    end_str: str = "np"
    ctrl_str: str = "^[A-Za-z]"
    extract_key: str = ""
    merge_str: str = ""
    join_after_split: bool = False
    extra_data: str = ""


#: Option names of rule texts whose name here isn't just the snake-case form.
RENAMED = {"struct": "structure", "maxCountPerLine": "max_per_line", "splitParaSep": "para_sep", "checkJIS": "check_jis", "OldEncodeName": "encoding", "contentSeparate": "separate"}


#: Options that belong to one step only and are its arguments: a rule text that sets one is told so.
ARGUMENTS = {
    "two_line_flag": "formats.read_two_line", "keep_format": "tree.keep_format_roles", "dynamic_replace": "text.with_symbols", "engine_name": "text.engine_fix",
}


def _snake(name: str) -> str:
    return RENAMED.get(name) or re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def separators_kept(separate: str) -> bool:
    """Whether what separates units is a unit itself: its pattern begins with a group."""
    return separate.startswith("(")


@dataclass(frozen=True)
class Role:
    """What a capture group's name says about its captures."""

    keys: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    type: str | None = None
    blocks: str | None = None
    interval: str | None = None  # a key that starts to hold; "" ends it
    skip: bool = False
    nolen: bool = False  # a capture without a length in front

    @classmethod
    def parse(cls, group: str | None) -> Role:
        if not group:
            return cls()
        if group.startswith("skip"):
            return cls(skip=True)
        keys, flags, kind, blocks, interval = [], [], None, None, None
        for part in group.rstrip("0123456789").split("AND"):
            if part.startswith("pre"):
                # "+X" sets X on the capture before, "-X" takes it away; other names that start so do nothing
                if part.startswith("pre_"):
                    flags.append("+" + part[4:])
                elif part.startswith("predel_"):
                    flags.append("-" + part[7:])
            elif part.startswith("type_"):
                kind = part[5:]
            elif part.startswith("start_"):
                interval = part[6:]
            elif part.startswith("end_"):
                interval = ""
            elif part.startswith("not_"):
                blocks = part[4:]
            else:
                keys.append("unfinish" if part == "un" else part)
        return cls(tuple(keys), tuple(flags), kind, blocks, interval, nolen=group.startswith("nolen"))


@dataclass(frozen=True)
class Rule:
    key: str
    pattern: str

    @property
    def kind(self) -> str | None:
        return "skip" if "skip" in self.key else "search" if "search" in self.key else None

    def roles(self) -> list[Role]:
        compiled = re.compile(self.pattern)
        names = {i: n for n, i in compiled.groupindex.items()}
        return [Role.parse(names.get(i)) for i in range(1, compiled.groups + 1)]


@dataclass(frozen=True)
class RuleProgram:
    """Rules in text order, and the options that the text sets."""

    rules: tuple[Rule, ...]
    config: ExtractConfig

    @classmethod
    def parse(cls, text: str, config: ExtractConfig = ExtractConfig()) -> RuleProgram:
        """Reads ``key=value`` lines up to a blank line or ``sample``. A key that comes again replaces its pattern in place; an
        option that isn't known is an error."""
        rules: dict[str, str] = {}
        known = {f.name: f.type for f in fields(ExtractConfig)}
        options: dict = {}

        def put(name: str, value) -> None:
            if name in ARGUMENTS:
                raise ValueError(f"{name!r} isn't read from rule texts: it is an argument of {ARGUMENTS[name]}")
            if name not in known:
                raise ValueError(f"unknown option {name!r}")
            options[name] = str(value) if known[name] == "str" and not isinstance(value, bool) else value

        for line in (text or "").split("\n"):
            line = line.rstrip("\r")
            if not line or line.startswith("sample"):
                break
            if line[0] in "<;/#":
                continue
            key, _, value = line.partition("=")
            if key == "flag":
                for name in value.split(","):
                    put(_snake(name), True)
            elif "_skip" in key or "_search" in key:
                rules[key] = value
            elif value in ("True", "true", "False", "false"):
                put(_snake(key), value[0] in "Tt")
            else:
                number = re.fullmatch(r"-?\d+", value) and key not in ("extraData", "extractKey")
                put(_snake(key), int(value) if number else value)
        return cls(tuple(Rule(k, p) for k, p in rules.items()), replace(config, **options))
