"""CSS 2.1: tokens, a parser, and a sanitizer that keeps a style inside its box and off the network."""

from __future__ import annotations

import re
from typing import Any, NamedTuple

_HEX = "[0-9a-fA-F]"
_ESCAPE = rf"(?:\\{_HEX}+[ \t\r\n\f]?|\\[^\r\n\f0-9a-fA-F])"
_WIDE = " -\U0010ffff"
_IDENT = rf"-?(?:[_a-zA-Z{_WIDE}]|{_ESCAPE})(?:[_a-zA-Z0-9{_WIDE}-]|{_ESCAPE})*"
_NAME = rf"(?:[_a-zA-Z0-9{_WIDE}-]|{_ESCAPE})+"
_NUMBER = r"(?:[0-9]*\.[0-9]+|[0-9]+)"
_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_OPEN_STRING = [rf"{q}(?:[^\n\r\f\\{q}]|\\[\n\r\f]|{_ESCAPE})*" for q in "\"'"]
_STRING = "|".join(x + q for x, q in zip(_OPEN_STRING, "\"'", strict=True))
_BLANK = r"[ \t\r\n\f\x0b]*"
_URL = rf"(?:[!#$%&*-~{_WIDE}]|{_ESCAPE})*"

#: Kinds of tokens; the longest match counts, of equal ones the first.  "" is skipped.
_RULES = [
    (kind, re.compile(pattern, re.S))
    for kind, pattern in (
        ("", r"[ \t\r\n\f\x0b]+"),
        ("", _COMMENT),
        ("bad_comment", r"/\*.*\Z"),
        ("", "<!--|-->"),
        ("includes", "~="),
        ("dashmatch", r"\|="),
        ("string", _STRING),
        ("bad_string", "|".join(rf"{x}\\?" for x in _OPEN_STRING)),
        ("ident", _IDENT),
        ("hash", f"#{_NAME}"),
        ("import", "@(?i:import)"),
        ("page", "@(?i:page)"),
        ("media", "@(?i:media)"),
        ("charset", r"@(?i:charset)[ \t\r\n\f]"),
        ("important", rf"!(?:[ \t\r\n\f]|{_COMMENT})*(?i:important)"),
        ("dimension", f"{_NUMBER}{_IDENT}"),
        ("percentage", f"{_NUMBER}%"),
        ("number", _NUMBER),
        ("uri", rf"(?i:url)\({_BLANK}(?:{_STRING}|{_URL}){_BLANK}\)"),
        ("bad_uri", rf"(?i:url)\({_BLANK}(?:{_STRING}|{_URL}){_BLANK}"),
        ("function", rf"{_IDENT}\("),
        ("mark", "."),
    )
]
_UNITS = {u: kind for kind, units in (("ems", "em"), ("exs", "ex"), ("length", "px cm mm in pt pc"), ("angle", "deg rad grad"), ("time", "ms s"), ("freq", "hz khz")) for u in units.split()}
_VALUES = frozenset("number percentage length ems exs angle time freq dimension string ident uri hash".split())

#: Functions that stay; of others only the argument does.
ALLOWED_FUNCTIONS = frozenset("attr calc cubic-bezier hsl hsla linear-gradient minmax radial-gradient repeating-linear-gradient repeating-radial-gradient rgb rgba var".split())


class Token(NamedTuple):
    kind: str
    line: int
    text: str


class CssError(Exception):
    def __init__(self, line: int, message: str) -> None:
        super().__init__(message)
        self.line, self.message = line, message


def tokens(text: str) -> list[Token]:
    """Marks are tokens of their own kind: the character itself."""
    out, at, line = [], 0, 1
    while at < len(text):
        kind, end = "mark", at
        for k, pattern in _RULES:
            m = pattern.match(text, at)
            if m and m.end() > end:
                kind, end = k, m.end()
        piece = text[at:end]
        if kind == "dimension":
            kind = _UNITS.get(re.sub(_NUMBER, "", piece, count=1).lower(), kind)
        if kind:
            out.append(Token(piece if kind == "mark" else kind, line, piece))
        line += piece.count("\n")
        at = end
    return out


class _Parser:
    """Writes the sanitized sheet while it reads; Expr knows the operators / and , only."""

    def __init__(self, text: str) -> None:
        self.found, self.at = tokens(text), 0

    def kind(self) -> str:
        return self.found[self.at].kind if self.at < len(self.found) else "end"

    def take(self, *kinds: str) -> str:
        if self.kind() not in kinds:
            if self.at < len(self.found):
                token = self.found[self.at]
                raise CssError(token.line, f"syntax error before: {token.text!r}")
            raise CssError(self.found[-1].line if self.found else 1, "syntax error at the end")
        self.at += 1
        return self.found[self.at - 1].text

    def sheet(self) -> tuple[bool, list[str]]:
        """Whether it has a charset or import, and its rules."""
        heads = self.at
        if self.kind() == "charset":
            self.take("charset")
            self.take("string")
            self.take(";")
        if self.kind() == "import":
            self.take("import")
            self.take("string", "uri")
            self.media_list()
            self.take(";")
        heads = self.at > heads
        rules = []
        while self.kind() != "end":
            rules.append(self.media() if self.kind() == "media" else self.page() if self.kind() == "page" else self.rule())
        return heads, rules

    def media_list(self) -> str:
        out = [self.take("ident")]
        while self.kind() == ",":
            self.take(",")
            out.append(self.take("ident"))
        return ",".join(out)

    def media(self) -> str:
        self.take("media")
        names, inner = self.media_list(), []
        self.take("{")
        while self.kind() != "}":
            inner.append(self.rule())
        self.take("}")
        return f"@media {names} {{\n{''.join(inner)}}}\n"

    def page(self) -> str:
        self.take("page")
        pseudo = ""
        if self.kind() == ":":
            pseudo = self.take(":") + self.take("ident")
        self.take("{")
        inner = self.declarations()
        self.take("}")
        return f"@page {pseudo} {{\n{inner}}}\n"

    def rule(self) -> str:
        names = [self.selector()]
        while self.kind() == ",":
            self.take(",")
            names.append(self.selector())
        self.take("{")
        inner = self.declarations()
        self.take("}")
        return ",\n".join(names) + f"{{\n{inner}}}\n"

    def selector(self) -> str:
        out = self.simple()
        while self.kind() in ("+", ">", "*", "ident", "hash", ".", "[", ":"):
            out += self.take(self.kind()) + " " + self.simple() if self.kind() in ("+", ">") else self.simple()
        return out

    def simple(self) -> str:
        first = self.take("*", "ident", "hash", ".", "[", ":")
        if first == ".":
            first += self.take("ident")
        elif first == ":":
            if self.kind() == "function":
                first += self.take("function") + self.take("ident") + self.take(")")
            else:
                first += self.take("ident")
        elif first == "[":
            first += self.take("ident")
            if self.kind() in ("=", "includes", "dashmatch"):
                first += self.take(self.kind()) + self.take("ident", "string")
            first += self.take("]")
        return first + " "

    def declarations(self) -> str:
        out = []
        while True:
            if self.kind() == "ident":
                name = self.take("ident") + self.take(":")
                value = self.expression()
                out.append(name + value + (" !important" if self.kind() == "important" and self.take("important") else "") + ";\n")
            if self.kind() != ";":
                return "".join(out)
            self.take(";")

    def expression(self) -> str:
        out = self.term()
        while self.kind() in ("/", ","):
            out += self.take("/", ",") + self.term()
        return out

    def term(self) -> str:
        kind = self.kind()
        if kind in ("-", "+"):
            return self.take(kind) + self.term()
        if kind == "function":
            name = self.take("function")
            inner = self.expression()
            self.take(")")
            return f"{name}{inner})" if name[:-1] in ALLOWED_FUNCTIONS else inner
        text = self.take(*_VALUES)
        if kind == "uri":
            return "url()"
        if kind == "string":
            return _clean_string(text)
        return "absolute" if kind == "ident" and text.lower() == "fixed" else text


def _clean_string(text: str) -> str:
    from .html import escape_check, strip

    return f'"{escape_check(strip(text[1:-1]))}"'


def _result(work: Any) -> dict:
    try:
        return {"ok": True, "css": work()}
    except CssError as e:
        return {"ok": False, "line": e.line, "error": e.message}


def sanitize(text: str | None) -> dict | None:
    """{ok, css} or {ok, line, error}."""
    return None if text is None else _result(lambda: "".join(_Parser(text).sheet()[1]))


def sanitize_style(text: str | None) -> dict | None:
    """The same for a style attribute; braces that make it more than one rule are an error."""
    if text is None:
        return None

    def work() -> str:
        heads, rules = _Parser(f"a {{ {text} }}").sheet()
        if heads or len(rules) != 1 or not rules[0].startswith("a {\n"):
            raise CssError(1, "not a single rule")
        return rules[0][len("a {\n") : -len("}\n")].replace("\n", " ")

    return _result(work)


def token_rows(text: str | None) -> list[dict] | None:
    return None if text is None else [t._asdict() for t in tokens(text)]
