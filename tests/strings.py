"""Strings that a regex matches, put together from its parse tree, so that no key-shaped text is stored."""

from __future__ import annotations

import random
import string
from re import _constants as op
from re import _parser

_CLASSES = {op.CATEGORY_DIGIT: string.digits, op.CATEGORY_WORD: string.ascii_letters + string.digits + "_", op.CATEGORY_SPACE: " ", op.CATEGORY_NOT_SPACE: string.ascii_lowercase}


def _members(items) -> str:
    if items[0][0] is op.NEGATE:
        return "".join(sorted(set(string.ascii_lowercase + string.digits) - set(_members(items[1:])))) if len(items) > 1 else string.ascii_lowercase
    out = ""
    for code, value in items:
        if code is op.LITERAL:
            out += chr(value)
        elif code is op.RANGE:
            out += "".join(chr(c) for c in range(value[0], value[1] + 1))
        elif code is op.CATEGORY:
            out += _CLASSES[value]
    return out


def _made(nodes, rng: random.Random, extra: int) -> str:
    out = ""
    for code, value in nodes:
        if code is op.LITERAL:
            out += chr(value)
        elif code is op.IN:
            out += rng.choice(_members(value))
        elif code is op.NOT_LITERAL:
            out += rng.choice("qrtvwz")
        elif code is op.ANY:
            out += rng.choice(string.ascii_letters)
        elif code is op.SUBPATTERN:
            out += _made(value[3], rng, extra)
        elif code is op.BRANCH:
            out += _made(rng.choice(value[1]), rng, extra)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            out += "".join(_made(body, rng, extra) for _ in range(rng.randint(least, min(most, least + extra))))
    return out


def matching_string(regex: str, rng: random.Random, extra: int = 2) -> str:
    return _made(_parser.parse(regex), rng, extra)
