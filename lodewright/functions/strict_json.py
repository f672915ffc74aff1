"""RFC 8259 texts: one value, nothing lenient."""

from __future__ import annotations

import json
import re


def _refuse(name: str) -> float:
    raise ValueError(f"{name} is no JSON number")


# Numbers become floats: integers of any length stay readable and never pass for text or flags.
_DECODER = json.JSONDecoder(strict=True, parse_int=float, parse_float=float, parse_constant=_refuse)
_TOKEN = re.compile(
    r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*+")'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null)|([\[\]{}:,]))"
)
_WORDS = {"true": True, "false": False, "null": None}


def _loads_deep(text: str):
    """The same grammar with an explicit stack, for texts nested deeper than the interpreter recurses."""
    pos, end = 0, len(text.rstrip(" \t\n\r"))
    stack: list = []  # [container, pending key or None]
    want, root = "value", None
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"unexpected character at {pos}")
        pos = m.end()
        string, number, word, mark = m.groups()
        if want == "end":
            raise ValueError("text after the value")
        if mark == ":":
            if want != "colon":
                raise ValueError("unexpected colon")
            want = "value"
            continue
        if mark == ",":
            if want != "next":
                raise ValueError("unexpected comma")
            want = "key" if isinstance(stack[-1][0], dict) else "value"
            continue
        if mark in ("}", "]"):
            kind = dict if mark == "}" else list
            empty = stack and not stack[-1][0] and want in (("first key",) if kind is dict else ("first value",))
            if not stack or not isinstance(stack[-1][0], kind) or not (want == "next" or empty):
                raise ValueError("unexpected end of a container")
            stack.pop()
            want = "next" if stack else "end"
            continue
        if want in ("key", "first key"):
            if string is None:
                raise ValueError("a name must be a string")
            stack[-1][1], want = _DECODER.decode(string), "colon"
            continue
        if want not in ("value", "first value"):
            raise ValueError("unexpected value")
        if mark:
            value = {} if mark == "{" else []
        elif string is not None:
            value = _DECODER.decode(string)
        else:
            value = float(number) if number is not None else _WORDS[word]
        if not stack:
            root = value
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)
        if mark:
            stack.append([value, None])
            want = "first key" if mark == "{" else "first value"
        else:
            want = "next" if stack else "end"
    if want != "end":
        raise ValueError("the text ends early")
    return root


def loads(text: str):
    """The value of a strict JSON text; ValueError for anything else. Of repeated names the last counts."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _loads_deep(text)
