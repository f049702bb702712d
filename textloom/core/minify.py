"""Minifiers of CSS and JavaScript."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RUN = {
    "selector": re.compile(r"[^{@\n /]+|/"),
    "at": re.compile(r"[^{;\n/]+|/"),
    "declaration": re.compile(r"[^(;} /]+|/"),
}


def css(text: str | None) -> str | None:
    """Without comments and needless spaces; only space and newline are white space.

    Outside of blocks all white space goes, in selectors and declarations a run of spaces is one.
    """
    if text is None:
        return None
    out: list[str] = []
    at, state = 0, "outside"

    def last() -> str:
        return next((x[-1] for x in reversed(out) if x), "")

    def blank(i: int, chars: str) -> int:
        while i < len(text) and text[i] in chars:
            i += 1
        return i

    while at < len(text):
        c = text[at]
        if state != "paren" and text.startswith("/*", at):
            at = _COMMENT.match(text, at).end()
        elif state == "outside":
            if c in " \n":
                at += 1
            elif c == "@":
                out.append(c)
                at, state = at + 1, "at"
            else:
                state = "selector"
        elif state == "block":
            if c == "}":
                out.append(c)
                at, state = at + 1, "outside"
            else:
                at, state = blank(at, " \n"), "declaration"
        elif state == "paren":
            end = text.find(")", at)
            end = len(text) if end < 0 else end + 1
            out.append(text[at:end])
            at, state = end, "declaration"
        elif m := _RUN[state].match(text, at):
            out.append(m[0])
            at = m.end()
        elif c == "{":
            out.append(c)
            at, state = at + 1, "block"
        elif state == "selector":
            if c == "@":
                out.append(c)
                state = "at"
                at += 1
            elif c == "\n":
                at += 1
            else:
                at = blank(at, " ")
                if not text.startswith("{", at) and last() != " ":
                    out.append(" ")
        elif state == "at":
            at += 1
            if c == ";":
                out.append(c)
                state = "outside"
            elif text.startswith("\n", at):
                out.append(";")
                state = "outside"
            else:
                out.append(" ")
        else:
            at += 1
            if c == "(":
                out.append(c)
                state = "paren"
            elif c == "}":
                out.append(c)
                state = "outside"
            elif c == ";":
                after = blank(at, " \n")
                if text[after : after + 1] in ("}", ";") and after < len(text):
                    at = after
                else:
                    out.append(c)
                state = "block" if at < len(text) else "outside"
                if text.startswith(";", at):
                    state = "declaration"
            elif last() != " ":
                out.append(" ")
    return "".join(out)


class JsError(Exception):
    pass


_WORD = re.compile(r"[A-Za-z0-9_\\$\x7f-\U0010ffff]")
#: After these a slash begins a regular expression.
_BEFORE_REGEXP = frozenset("(,=:[!&|?+-~*/{\n")
_STRINGS = {q: re.compile(rf"{q}(?:[^\\{q}]|\\.)*{q}", re.S) for q in "\"'`"}
_REGEXP = re.compile(r"/(?:\[(?:[^\]\\]|\\.)*\]|\\.|[^/\\\[])*/", re.S)


def _js(text: str) -> str:
    out: list[str] = []
    at, n = 0, len(text)
    while True:
        # Comments and control characters ahead, as what they stand for.
        while text.startswith("//", at):
            m = re.compile(r"[\x00-\n]").search(text, at + 2)
            at = m.start() if m else n
        if at >= n:
            break
        c, step = text[at], 1
        if text.startswith("/*", at) and not text.startswith("/*!", at):
            end = text.find("*/", at + 2)
            if end < 0:
                raise JsError("unterminated comment")
            c, step = " ", end + 2 - at
        elif c == "\r":
            c = "\n"
        elif c < " " and c != "\n":
            c = " "
        last = out[-1][-1] if out else ""
        at += step
        if c == "\n":
            if last not in ("", "\n", ";"):
                out.append("\n")
        elif c == " ":
            after = text[at : at + 1]
            if last not in ("", " ", "\n") and (_WORD.match(last) and _WORD.match(after) or after == last and after in ("-", "+")):
                out.append(" ")
        elif c in _STRINGS:
            m = _STRINGS[c].match(text, at - 1)
            if not m:
                raise JsError("unterminated string")
            out.append(m[0])
            at = m.end()
        elif c == "/" and text.startswith("*!", at):
            end = text.find("*/", at + 2)
            if end < 0:
                raise JsError("unterminated comment")
            out.append(text[at - 1 : end + 2])
            at = end + 2
        elif c == "/" and last in _BEFORE_REGEXP and last:
            m = _REGEXP.match(text, at - 1)
            if not m or text[m.end() : m.end() + 1] in ("/", "*") and m.end() < n:
                raise JsError("unterminated regular expression")
            out += [" ", m[0]] if last in "/*" else [m[0]]
            at = m.end()
        else:
            out.append(c)
    return "".join(out).rstrip(" \n")


def js(text: str | None) -> str | None:
    """Without comments (but /*! ones) and needless white space; null if something in it does not end."""
    return js_checked(text)["js"] if text is not None else None


def js_checked(text: str | None) -> dict | None:
    """{js, error}."""
    if text is None:
        return None
    try:
        return {"js": _js(text), "error": None}
    except JsError as e:
        return {"js": None, "error": str(e)}
