"""UBF-A, a text form of terms: encoder and decoder between bytes and JSON.

JSON stands for terms so: numbers and strings (binaries) for themselves, true, false and null for
the atoms true, false and undefined, arrays for lists, and objects of one key for the rest:
{"$atom": name}, {"$tuple": [...]}, {"$string": text}, {"$datetime": "Y-m-dTH:i:s"}.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from datetime import datetime, timedelta
from typing import Any, NamedTuple

from .text import float_digits

#: Bytes of a value at most.
LIMIT = 10 * 1024 * 1024
_EPOCH = datetime(1970, 1, 1)
_SKIPPED = b" ,\n\r\t"
_RESERVED = frozenset(b" 0123456789{},~%#>\n\r\t\"'-&$`")
_KEYS = [c for c in range(32, 256) if c not in _RESERVED]


class Atom(NamedTuple):
    name: str


class Text(NamedTuple):
    """A string in quotes."""

    value: bytes


class UbfError(ValueError):
    pass


_ATOMS = {"true": True, "false": False, "undefined": None}


def _quoted(data: bytes, at: int, quote: bytes) -> tuple[bytes, int]:
    m = re.compile(rb"((?:[^\\" + quote + rb"]|\\.)*)" + quote, re.S).match(data, at)
    if not m:
        raise UbfError("unterminated text")
    return re.sub(rb"\\(.)", rb"\1", m[1], flags=re.S), m.end()


def _tagged(value: Any, tag: bytes) -> Any:
    try:
        if tag == b"f":
            return float(value)
        if tag == b"dt":
            return _EPOCH + timedelta(seconds=value)
    except (TypeError, ValueError, OverflowError) as e:
        raise UbfError(f"bad value for {tag.decode()}") from e
    return value


def loads(data: bytes, limit: int = LIMIT) -> tuple[Any, bytes]:
    """The first term of data, and what follows it."""
    if len(data) > limit:
        raise UbfError("size")
    stack: list[list[Any]] = [[]]
    known: dict[int, Any] = {}
    at = 0

    def pop() -> Any:
        if not stack[-1]:
            raise UbfError("nothing to take")
        return stack[-1].pop()

    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c in b"'\"":
            text, at = _quoted(data, at, c)
            name = text.decode("utf-8", "replace")
            stack[-1].append(text if c == b'"' else _ATOMS[name] if name in _ATOMS else Atom(name))
        elif c == b"`":
            tag, at = _quoted(data, at, c)
            stack[-1].append(_tagged(pop(), tag))
        elif c == b"%":
            _, at = _quoted(data, at, c)
        elif c == b"~":
            size = pop()
            if not isinstance(size, int) or size < 0 or data[at + size : at + size + 1] != b"~":
                raise UbfError("tilde")
            stack[-1].append(data[at : at + size])
            at += size + 1
        elif c == b"-" or c.isdigit():
            m = re.compile(rb"[0-9]*").match(data, at if c == b"-" else at - 1)
            number = int(m[0] or b"0")
            stack[-1].append(-number if c == b"-" else number)
            at = m.end()
        elif c == b"{":
            stack.append([])
        elif c == b"}":
            if len(stack) < 2:
                raise UbfError("brace")
            items = stack.pop()
            stack[-1].append(tuple(items))
        elif c == b"#":
            stack[-1].append([])
        elif c == b"&":
            head, tail = pop(), pop()
            if not isinstance(tail, list):
                raise UbfError("no list to add to")
            # Lists come last element first; kept so until the end.
            tail.append(head)
            stack[-1].append(tail)
        elif c == b"$":
            if len(stack) != 1 or len(stack[0]) != 1:
                raise UbfError("not one term")
            return _turned(stack[0][0]), data[at:]
        elif c == b">":
            if at >= len(data):
                raise UbfError("end of data")
            known[data[at]] = pop()
            at += 1
        elif c not in _SKIPPED:
            if data[at - 1] not in known:
                raise UbfError(f"unknown character {data[at - 1]}")
            stack[-1].append(known[data[at - 1]])
    raise UbfError("end of data")


def _turned(term: Any) -> Any:
    if isinstance(term, list):
        return [_turned(x) for x in reversed(term)]
    return tuple(map(_turned, term)) if type(term) is tuple else term


def _escaped(data: bytes, quote: bytes) -> bytes:
    return quote + re.sub(rb"([\\" + quote + rb"])", rb"\\\1", data) + quote


def _name(term: Any) -> str | None:
    if isinstance(term, Atom):
        return term.name
    return next((k for k, v in _ATOMS.items() if v is term), None)


def dumps(term: Any, record_names: frozenset[str] = frozenset()) -> bytes:
    """Atoms and whole numbers that occur often, inside of tuples, get one-byte keys, by what that saves."""
    seen: Counter = Counter()

    def count(x: Any) -> None:
        if type(x) is tuple:
            for y in reversed(x):
                count(y)
        elif _name(x) is not None or type(x) is int:
            seen[_name(x) if type(x) is not int else x, type(x) is int] += 1

    count(term)
    saved = sorted(((len(str(x)) - 1) * n, not number, x if number else 0, "" if number else x, number) for (x, number), n in seen.items() if n > 1 and len(str(x)) > 1)
    keys: dict[tuple, bytes] = {}
    head = b""
    for (_, _, value, name, number), key in zip(reversed(saved), _KEYS, strict=False):
        x = value if number else name
        keys[x, number] = bytes([key])
        head = (str(x).encode() if number else _escaped(x.encode(), b"'")) + b">" + bytes([key]) + head

    def plain(x: Any) -> bool:
        if _name(x) is not None:
            return True
        first = x[0] if type(x) is tuple and len(x) == 2 else None
        return isinstance(first, bytes) or first is not None and (name := _name(first)) is not None and name not in record_names

    def write(x: Any) -> bytes:
        if (name := _name(x)) is not None:
            return keys.get((name, False)) or _escaped(name.encode(), b"'")
        if type(x) is int:
            return keys.get((x, True)) or b"%d" % x
        if isinstance(x, bytes):
            return b"%d~%s~" % (len(x), x)
        if isinstance(x, Text):
            return _escaped(x.value, b'"')
        if isinstance(x, float):
            return f'"{float_digits(x)}"`f`'.encode()
        if isinstance(x, datetime):
            return write(None) if x.year == 9999 else b"%d`dt`" % ((x - _EPOCH) // timedelta(seconds=1))
        if isinstance(x, list):
            inner = b"".join(write(y) + b"&" for y in reversed(x))
            bag = x and all(map(plain, x)) and not all(_name(y) is not None for y in x)
            return b"#" + inner + (b"`plist`" if bag else b"")
        return b"{" + b",".join(map(write, x)) + b"}"

    return head + write(term) + b"$"


def to_json(term: Any) -> Any:
    if isinstance(term, Atom):
        return {"$atom": term.name}
    if isinstance(term, datetime):
        return {"$datetime": term.isoformat()}
    if isinstance(term, bytes):
        return term.decode("utf-8", "replace")
    if isinstance(term, list):
        return [to_json(x) for x in term]
    return {"$tuple": [to_json(x) for x in term]} if isinstance(term, tuple) else term


def from_json(value: Any) -> Any:
    if isinstance(value, dict):
        (kind, inner), *more = value.items()
        if more:
            raise UbfError("an object of one key is wanted")
        if kind == "$atom":
            return _ATOMS[inner] if inner in _ATOMS else Atom(inner)
        if kind == "$tuple":
            return tuple(map(from_json, inner))
        if kind == "$string":
            return Text(inner.encode("latin-1"))
        if kind == "$datetime":
            return datetime.fromisoformat(inner)
        raise UbfError(f"unknown kind {kind}")
    if isinstance(value, list):
        return [from_json(x) for x in value]
    return value.encode() if isinstance(value, str) else value


def encode(text: str | None, record_names: tuple[str, ...] = ()) -> bytes | None:
    """A term in JSON as UBF-A; null for what is no term."""
    try:
        return None if text is None else dumps(from_json(json.loads(text)), frozenset(record_names))
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


def decode(data: bytes | None) -> dict | None:
    """{ok, json} or {ok, error}."""
    if data is None:
        return None
    try:
        return {"ok": True, "json": json.dumps(to_json(loads(bytes(data))[0]), ensure_ascii=False)}
    except (UbfError, RecursionError) as e:
        return {"ok": False, "error": str(e) or "nested too deeply"}
