"""Regexes that users write, read as ECMAScript reads them and spelled for the JVM.

``dialect.to_java`` expects patterns of the rule table, which keep to a common
subset. Users write what the browser takes: ``{`` and ``]`` as characters,
``[^]``, escapes of any letter, group names with ``_`` and ``$``. What ECMAScript
refuses (possessive quantifiers, atomic groups, inline flags) is refused here too.
"""

from __future__ import annotations

import re

from pyspark import SparkContext

from pagesieve.functions.dialect import to_java

_NAME = re.compile(r"\(\?<([A-Za-z_$][\w$]*)>", re.ASCII)
_GROUP = re.compile(r"\(\?(?::|=|!|<=|<!)")
_TIMES = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")
_NO_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def _groups(pattern: str) -> tuple[int, list[str]]:
    """The number of capturing groups, and the names of the named ones in order."""
    n, names, in_class, i = 0, [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            named = _NAME.match(pattern, i)
            if named:
                names.append(named[1])
            n += bool(named) or pattern[i + 1:i + 2] != "?"
        i += 1
    return n, names


def _escape(pattern: str, i: int, in_class: bool, n: int, names: list[str]) -> tuple[str, int]:
    """The escape at ``i``, spelled for both dialects, and where it ends."""
    if i + 1 >= len(pattern):
        raise ValueError("a backslash at the end")
    ch, rest = pattern[i + 1], pattern[i + 2:]
    if ch in "dDwWsSfnrt":
        return "\\" + ch, i + 2
    if ch in "bB":
        if in_class:
            return ("\\x08" if ch == "b" else "B"), i + 2
        return ("\\b" if ch == "b" else _NO_BOUNDARY), i + 2
    if ch == "v":
        return "\\x0B", i + 2
    if ch == "c":
        if re.match("[A-Za-z]", rest):
            return f"\\x{ord(rest[0]) % 32:02x}", i + 3
        return "\\\\", i + 1
    for letter, digits in (("x", 2), ("u", 4)):
        if ch == letter:
            found = re.match(f"[0-9A-Fa-f]{{{digits}}}", rest)
            return (f"\\{letter}{found[0]}", i + 2 + digits) if found else (letter, i + 2)
    if ch == "k" and names and not in_class:
        found = re.match(r"<([A-Za-z_$][\w$]*)>", rest, re.ASCII)
        if not found or found[1] not in names:
            raise ValueError("a reference to a group that is not there")
        return f"\\k<n{names.index(found[1])}>", i + 2 + len(found[0])
    if ch in "0123456789":
        number = re.match("[0-9]+", pattern[i + 1:])[0]
        if ch != "0" and not in_class and int(number) <= n:
            return f"(?:\\{number})", i + 1 + len(number)
        octal = re.match("[0-3][0-7]{0,2}|[4-7][0-7]?", pattern[i + 1:])
        return (f"\\x{int(octal[0], 8):02x}", i + 1 + len(octal[0])) if octal else (ch, i + 2)
    return (ch if ch.isascii() and ch.isalpha() else "\\" + ch), i + 2


def _common(pattern: str) -> str:
    """The pattern in the subset that ``to_java`` reads."""
    n, names = _groups(pattern)
    out, opened, i, repeats = [], [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        times = _TIMES.match(pattern, i)
        if ch == "\\":
            piece, end = _escape(pattern, i, False, n, names)
            repeats = piece not in ("\\b", _NO_BOUNDARY)
        elif ch == "[":
            piece, end = _char_class(pattern, i, n, names)
            repeats = True
        elif ch == "(":
            named, special = _NAME.match(pattern, i), _GROUP.match(pattern, i)
            if not named and not special and pattern[i + 1:i + 2] == "?":
                raise ValueError("a group ECMAScript does not have")
            piece = f"(?<n{names.index(named[1])}>" if named else special[0] if special else "("
            end = i + len((named or special)[0]) if named or special else i + 1
            opened.append(piece)
            repeats = False
        elif ch == ")":
            if not opened:
                raise ValueError("a group is closed that is not open")
            piece, end, repeats = ch, i + 1, opened.pop() not in ("(?<=", "(?<!")
        elif ch in "*+?" or times:
            if not repeats:
                raise ValueError("nothing to repeat")
            end = times.end() if times else i + 1
            end += pattern[end:end + 1] == "?"
            piece, repeats = pattern[i:end], False
        else:
            piece, end, repeats = ("\\" + ch if ch in "{}]" else ch), i + 1, ch not in "^$|"
        out.append(piece)
        i = end
    if opened:
        raise ValueError("a group is not closed")
    if len(set(names)) < len(names):
        raise ValueError("two groups of one name")
    return "".join(out)


def _char_class(pattern: str, i: int, n: int, names: list[str]) -> tuple[str, int]:
    """The class that opens at ``i``; an empty one holds nothing, its negation all."""
    for empty, meaning in (("[^]", "[\\s\\S]"), ("[]", "(?!)")):
        if pattern.startswith(empty, i):
            return meaning, i + len(empty)
    out, i = ["["], i + 1
    while i < len(pattern) and pattern[i] != "]":
        piece, i = _escape(pattern, i, True, n, names) if pattern[i] == "\\" else (pattern[i], i + 1)
        out.append(piece)
    if i == len(pattern):
        raise ValueError("a class is not closed")
    return "".join(out) + "]", i + 1


def user_pattern(pattern: str) -> str:
    """The pattern for the JVM; a ValueError where ECMAScript, or the JVM, does not take it."""
    java = to_java(_common(pattern))
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
    except Exception as err:
        raise ValueError(f"not a regex: {pattern}") from err
    return java
