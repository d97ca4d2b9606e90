"""Strings drawn from regular expressions, made anew for each test run."""

import random
import re
from re import _constants as C
from re import _parser

_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
_SETS = {
    C.CATEGORY_WORD: _WORD, C.CATEGORY_DIGIT: "0123456789", C.CATEGORY_SPACE: " \t",
    C.CATEGORY_NOT_SPACE: _WORD + "-+/", C.CATEGORY_NOT_WORD: " -/", C.CATEGORY_NOT_DIGIT: "abc",
}


def _members(items):
    out, negate = [], False
    for kind, value in items:
        if kind is C.NEGATE:
            negate = True
        elif kind is C.LITERAL:
            out.append(chr(value))
        elif kind is C.RANGE:
            out += [chr(c) for c in range(value[0], value[1] + 1)]
        elif kind is C.CATEGORY:
            out += _SETS[value]
    return [c for c in _WORD + "-./=" if c not in out] if negate else out


def _draw(tree, rng):
    out = []
    for kind, value in tree:
        if kind is C.LITERAL:
            out.append(chr(value))
        elif kind is C.ANY:
            out.append(rng.choice(_WORD))
        elif kind is C.IN:
            out.append(rng.choice(_members(value)))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = value
            for _ in range(rng.randint(low, low + 3 if high is C.MAXREPEAT else min(high, low + 3))):
                out.append(_draw(body, rng))
        elif kind is C.SUBPATTERN:
            out.append(_draw(value[3], rng))
        elif kind is C.BRANCH:
            out.append(_draw(rng.choice(value[1]), rng))
        elif kind is C.GROUPREF:
            out.append('"')
        elif kind not in (C.AT, C.ASSERT, C.ASSERT_NOT):
            raise NotImplementedError(kind)
    return "".join(out)


def python_regex(rule):
    return re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))


def samples(rule, n, seed):
    """Texts the rule matches, with something around the match."""
    rng, regex, tree = random.Random(f"{rule.rule_id}{seed}"), python_regex(rule), _parser.parse(rule.pattern)
    found = []
    for _ in range(50 * n):
        text = rng.choice(("", "x = ", "\n<a> ", "é ")) + _draw(tree, rng) + rng.choice((" y", ";\n", "\"", ""))
        if regex.search(text):
            found.append(text)
        if len(found) == n:
            break
    return found
