"""Rule patterns are written once, in the ECMAScript dialect web scanners use.

``to_java`` spells a pattern so that the JVM regex engine gives the ECMAScript
meaning; ``to_re2`` does the same for RE2, which the SQL checks run on.  Only
the handful of constructs whose meaning differs is touched.
"""

from __future__ import annotations

from dataclasses import dataclass

# The white space of ECMAScript regular expressions.
SPACE_CODES = (
    "0009", "000a", "000b", "000c", "000d", "0020", "00a0", "1680",
    "2000-200a", "2028", "2029", "202f", "205f", "3000", "feff",
)


@dataclass(frozen=True)
class _Dialect:
    escape: str        # how a code point is spelled
    boundary: str      # \b
    end: str           # $ without the m flag


_JAVA = _Dialect(r"\u{}", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\z")
_RE2 = _Dialect(r"\x{{{}}}", r"\b", r"\z")


def _members(codes: tuple[str, ...], dialect: _Dialect) -> str:
    return "".join("-".join(dialect.escape.format(c) for c in code.split("-")) for code in codes)


def space_class(dialect: _Dialect = _JAVA) -> str:
    """Members of the white space class, to stand inside ``[...]``."""
    return _members(SPACE_CODES, dialect)


JS_SPACE = f"[{space_class()}]"


def _rewrite(pattern: str, dialect: _Dialect) -> str:
    space = space_class(dialect)
    line_ends = _members(("000a", "000d", "2028", "2029"), dialect)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        token = pattern[i:i + 2] if ch == "\\" else ch
        i += len(token)
        if token == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif token == r"\S":
            # Inside a class ECMAScript only ever unions it with \s here.
            out.append(r"\x{0}-\x{10FFFF}" if in_class else f"[^{space}]")
        elif in_class:
            in_class = token != "]"
            out.append("\\" + token if token in ("[", "&") else token)
        elif token == "[":
            in_class = True
            out.append(token)
        elif token == r"\b":
            out.append(dialect.boundary)
        elif token == "$":
            out.append(dialect.end)
        elif token == ".":
            out.append(f"[^{line_ends}]")
        else:
            out.append(token)
    return "".join(out)


def to_java(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _rewrite(pattern, _JAVA)


def to_re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + _rewrite(pattern, _RE2)
