"""JSON texts of any depth: the standard parser, and the same without recursion where texts nest too deep for it."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9]\d*))(\.\d+)?([eE][-+]?\d+)?")
# The words of JSON and of its usual extensions, the latter kept as texts.
_WORDS = {"true": True, "false": False, "null": None, "NaN": "NaN", "Infinity": "Infinity", "-Infinity": "-Infinity"}


def parse(text: str) -> object:
    """The value of a JSON text; NaN and infinities become texts. ValueError if it is none."""
    try:
        return json.loads(text, parse_constant=str)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str) -> object:
    root: list = []
    holders: list[tuple[object, str | None]] = [(root, None)]  # container and, for an object, the key that waits
    at = _SPACE.match(text, 0).end()
    while True:
        holder, key = holders[-1]
        opened = text[at : at + 1]
        if opened in ("{", "["):
            value: object = {} if opened == "{" else []
            end = at + 1
        elif opened == '"':
            value, end = scanstring(text, at + 1)
        elif number := _NUMBER.match(text, at):
            whole, part, power = number.groups()
            value, end = (float(number.group()) if part or power else int(whole)), number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, at)), None)
            if word is None:
                raise ValueError(f"no value at {at}")
            value, end = _WORDS[word], at + len(word)
        if key is None:
            holder.append(value)
        else:
            holder[key] = value
        at = _SPACE.match(text, end).end()
        if opened in ("{", "["):
            holders.append((value, None))
            if text[at : at + 1] != ("}" if opened == "{" else "]"):
                if opened == "{":
                    at = _key(text, at, holders)
                continue
        while len(holders) > 1:  # what closes here
            holder = holders[-1][0]
            if text[at : at + 1] != ("}" if isinstance(holder, dict) else "]"):
                break
            holders.pop()
            at = _SPACE.match(text, at + 1).end()
        if len(holders) == 1:
            if at != len(text):
                raise ValueError(f"more text at {at}")
            return root[0]
        if text[at : at + 1] != ",":
            raise ValueError(f"no comma at {at}")
        at = _SPACE.match(text, at + 1).end()
        if isinstance(holders[-1][0], dict):
            at = _key(text, at, holders)


def _key(text: str, at: int, holders: list) -> int:
    """Note the key at ``at`` for the innermost object; the position of its value."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, end = scanstring(text, at + 1)
    at = _SPACE.match(text, end).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    holders[-1] = (holders[-1][0], key)
    return _SPACE.match(text, at + 1).end()


def scalar(value: object) -> str:
    """JSON of a text, number, boolean or null; 1 and 1.0 are the same number."""
    if isinstance(value, float) and value == value and abs(value) < 2**53 and value == int(value):
        value = int(value)
    return json.dumps(value)


def canonical(value: object) -> str:
    """JSON with sorted keys and without spaces, of a value of any depth."""
    out: list[str] = []
    todo: list[object] = [value]
    raw: list[bool] = [False]  # whether the entry of ``todo`` is text to write
    while todo:
        x, written = todo.pop(), raw.pop()
        if written:
            out.append(x)
        elif isinstance(x, dict):
            parts: list[tuple[object, bool]] = [("{", True)]
            for i, k in enumerate(sorted(x)):
                parts += [(("," if i else "") + json.dumps(k) + ":", True), (x[k], False)]
            parts.append(("}", True))
            todo += [p for p, _ in reversed(parts)]
            raw += [w for _, w in reversed(parts)]
        elif isinstance(x, list):
            parts = [("[", True)]
            for i, v in enumerate(x):
                parts += [(",", True)] * (i > 0) + [(v, False)]
            parts.append(("]", True))
            todo += [p for p, _ in reversed(parts)]
            raw += [w for _, w in reversed(parts)]
        else:
            out.append(scalar(x))
    return "".join(out)
