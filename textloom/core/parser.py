"""A tolerant HTML and XML parser: tokens, trees, and texts made of them.

Tokens are tuples: ("start", name, attrs, singleton), ("end", name), ("data", text, is_white_space),
("comment", text), ("doctype", words), ("pi", name or raw text, attrs or None).
Tree nodes are Node, str for text, and comment and pi tuples.
"""

from __future__ import annotations

import json
import re
import sys
from html.entities import name2codepoint
from typing import Any

from .tables import HTML_ATTRS, HTML_TAGS

#: Elements that may be open at once; deeper ones become siblings.  A walk takes a few Python frames for each.
DEPTH = 400
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))

VOID = frozenset("wbr source param meta link input img hr embed col br base area".split())
_WS = " \t\r\n"
_ENTITY = re.compile(r"[^ \t\r\n'\"/<>&;]*")
_DATA = re.compile(r"[^<&]*")
_NAME = re.compile(r"[^& \t\r\n>/=]+")
_BARE = re.compile(r"[^& \t\r\n>/]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\r\n>/])", re.I) for name in ("script", "textarea")}


class Node:
    """An element: tag, attrs (pairs) and children in order."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: list[tuple[str, str]], children: list[Any] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs, [] if children is None else children

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.attrs if k == name), None)


def charref(name: str | None) -> int | None:
    """The code point that a reference's name (without & and ;) stands for."""
    if not name:
        return None
    if name[0] != "#":
        return name2codepoint.get(name)
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    try:
        return int(digits, base) if digits and digits.isalnum() else None
    except ValueError:
        return None


def character(code: int | None) -> str | None:
    return chr(code) if code is not None and 0 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else None


class Tokenizer:
    def __init__(self, text: str, mode: str = "html", lowercase: bool = False) -> None:
        self.text, self.at, self.mode, self.lowercase = text, 0, mode, lowercase

    def _known(self, name: str, attribute: bool) -> str:
        low = name.casefold()
        if self.lowercase:
            return low
        if self.mode == "xml":
            return name
        known = low in HTML_ATTRS or low.startswith("data-") if attribute else low in HTML_TAGS
        return low if known else name

    def _reference(self) -> str:
        """Just behind an ampersand: the text it gives."""
        t, start = self.text, self.at
        end = _ENTITY.match(t, start).end()
        if end == len(t):
            return "&"
        found = character(charref(t[start:end]))
        if t[end] == ";":
            if found is None:
                return "&"
            self.at = end + 1
            return found
        self.at = end
        return t[start - 1 : end] if found is None else found

    def _literal(self, attribute: bool) -> str:
        t = self.text
        if self.at < len(t) and t[self.at] in ">/=":
            self.at += 1
            return t[self.at - 1]
        parts = []
        while self.at < len(t):
            if t[self.at] == "&":
                self.at += 1
                parts.append(self._reference())
            elif m := _NAME.match(t, self.at):
                parts.append(m[0])
                self.at = m.end()
            else:
                break
        return self._known("".join(parts), attribute)

    def _skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in _WS:
            self.at += 1

    def _value(self, name: str) -> str:
        t = self.text
        self._skip()
        if not t.startswith("=", self.at):
            return name
        self.at += 1
        self._skip()
        if self.at >= len(t):
            return ""
        parts, quote = [], t[self.at] if t[self.at] in "\"'" else None
        if quote:
            self.at += 1
            plain = re.compile(f"[^&{quote}]+")
        while self.at < len(t):
            c = t[self.at]
            if c == "&":
                self.at += 1
                parts.append(self._reference())
            elif quote:
                if c == quote:
                    self.at += 1
                    break
                m = plain.match(t, self.at)
                parts.append(m[0])
                self.at = m.end()
            elif t.startswith("/>", self.at) or c in _WS or c == ">":
                break
            elif m := _BARE.match(t, self.at):
                parts.append(m[0])
                self.at = m.end()
            else:
                parts.append(c)
                self.at += 1
        return "".join(parts)

    def _attributes(self) -> list[tuple[str, str]]:
        t, out = self.text, []
        while True:
            self._skip()
            if self.at >= len(t) or t[self.at] in ">/" or t.startswith("?>", self.at):
                return out
            before = self.at
            name = self._literal(True)
            out.append((name, self._value(name)))
            if self.at == before:
                self.at += 1

    def _to_gt(self) -> bool:
        end = self.text.find(">", self.at)
        end = len(self.text) if end < 0 else end
        slash = "/" in self.text[self.at : end]
        self.at = min(end + 1, len(self.text))
        return slash

    def _until(self, mark: str, skip: int) -> str:
        start = self.at + skip
        end = self.text.find(mark, start)
        if end < 0:
            end, self.at = len(self.text), len(self.text)
        else:
            self.at = end + len(mark)
        return self.text[start:end]

    def _doctype(self) -> list[str]:
        t, words = self.text, []
        while True:
            self._skip()
            if self.at >= len(t):
                return words
            if t[self.at] == ">":
                self.at += 1
                return words
            if t[self.at] in "\"'":
                quote = t[self.at]
                end = t.find(quote, self.at + 1)
                end = len(t) if end < 0 else end
                words.append(t[self.at + 1 : end])
                self.at = min(end + 1, len(t))
            else:
                words.append(self._literal(False))

    def _next(self) -> tuple:
        t, at = self.text, self.at
        if t[at] == "&":
            self.at += 1
            return "data", self._reference(), False
        if t[at] != "<":
            self.at = _DATA.match(t, at).end()
            return "data", t[at : self.at], False
        if t.startswith("<!--", at):
            return "comment", self._until("-->", 4)
        if t[at : at + 9] in ("<!DOCTYPE", "<!doctype"):
            self.at = min(at + 10, len(t))
            return "doctype", self._doctype()
        if t.startswith("<![CDATA[", at):
            return "data", self._until("]]>", 9), False
        if t.startswith("<?php", at):
            return "pi", self._until("?>", 2), None
        if t.startswith("<?", at):
            self.at += 2
            name, attrs = self._literal(False), self._attributes()
            end = re.compile(r"\?>|>|/>").search(t, self.at)
            self.at = end.end() if end else len(t)
            return "pi", name, attrs
        if t.startswith("</", at):
            self.at += 2
            name = self._literal(False)
            self._to_gt()
            return "end", name
        if not re.match(r"[A-Za-z_]", t[at + 1 : at + 2]):
            self.at = _DATA.match(t, at + 1).end()
            return "data", t[at : self.at], False
        self.at += 1
        name, attrs = self._literal(False), self._attributes()
        slash = self._to_gt()
        return "start", name, attrs, slash or self.mode != "xml" and name in VOID

    def tokens(self) -> list[tuple]:
        out = []
        while self.at < len(self.text):
            token = self._next()
            out.append(token)
            if self.mode != "xml" and token[0] == "start" and not token[3] and (end := _RAW_END.get(token[1].casefold())):
                m = end.search(self.text, self.at)
                stop = m.start() if m else len(self.text)
                out.append(("data", self.text[self.at : stop], False))
                self.at = stop
        return out


def tokens(text: str, mode: str = "html", lowercase: bool = False) -> list[tuple]:
    return Tokenizer(text, mode, lowercase).tokens()


def _nearest(stack: list[Node], names: tuple[str, ...]) -> str | None:
    """Which of names is open inside the current table: None if none, "" outside of tables."""
    for node in reversed(stack):
        if node.tag == "table":
            return None
        if node.tag in names:
            return node.tag
    return ""


def _close(stack: list[Node], name: str, mode: str) -> None:
    if name == "br" and mode != "xml":
        return
    for i in range(len(stack) - 1, -1, -1):
        if stack[i].tag == name:
            del stack[max(i, 1) :]
            return
    if mode != "xml" and name in VOID:
        # The end of a singleton that stands here already: what came since belongs into it.
        siblings = stack[-1].children
        for i in range(len(siblings) - 1, -1, -1):
            if isinstance(siblings[i], Node) and siblings[i].tag == name:
                siblings[i].children += siblings[i + 1 :]
                del siblings[i + 1 :]
                return


_ROWS = ("tbody", "thead", "tfoot", "colgroup")


def _open(stack: list[Node], node: Node, mode: str) -> None:
    tag, top = node.tag, stack[-1].tag
    if mode != "xml":
        if tag in ("li", "option") and top == tag or tag in ("dd", "dt") and top in ("dd", "dt"):
            _close(stack, top, mode)
        elif tag in ("td", "th", "tr", *_ROWS):
            group = ("td", "th") if tag in ("td", "th") else ("tr",) if tag == "tr" else _ROWS
            inner = _nearest(stack, group)
            if inner == "":
                return
            if inner is None and tag in _ROWS:
                inner = _nearest(stack, ("tr",))
            if inner:
                _close(stack, inner, mode)
    if len(stack) > DEPTH:
        stack.pop()
    stack[-1].children.append(node)
    stack.append(node)


def tree(found: list[tuple], mode: str = "html") -> Node | None:
    """The tree below the first start tag that is no singleton; None without one."""
    at = next((i for i, t in enumerate(found) if t[0] == "start" and (not t[3] or mode == "xml")), None)
    if at is None:
        return None
    root = Node(found[at][1], found[at][2])
    if found[at][3]:
        return root
    stack, text = [root], []
    for token in [*found[at + 1 :], ("doctype", [])]:
        kind = token[0]
        if kind == "data":
            text.append(token)
            continue
        if text:
            if not all(t[2] for t in text):
                stack[-1].children.append("".join(t[1] for t in text))
            text = []
        if kind == "end":
            if token[1] == root.tag and not any(n.tag == token[1] for n in stack[1:]):
                break
            _close(stack, token[1], mode)
        elif kind == "start":
            node = Node(token[1], token[2])
            if token[3]:
                stack[-1].children.append(node)
            else:
                _open(stack, node, mode)
        elif kind != "doctype":
            stack[-1].children.append(token)
    return root


def parse(text: str | None, mode: str = "html", lowercase: bool = False) -> Node | None:
    return None if text is None else tree(tokens(text, mode, lowercase), mode)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def escape_attr(text: str) -> str:
    return escape(text).replace('"', "&quot;")


def to_html(node: Node, mode: str = "html") -> str:
    """Written out again; text after an end tag stands as it is up to the next start tag."""
    out: list[str] = []
    safe = True

    def write(x: Any) -> None:
        nonlocal safe
        if isinstance(x, str):
            out.append(escape(x) if safe else x)
        elif isinstance(x, Node):
            attrs = "".join(f' {escape(k)}="{escape_attr(v)}"' for k, v in x.attrs)
            single = not x.children and (mode == "xml" or x.tag in VOID)
            out.append(f"<{x.tag}{attrs} />" if single else f"<{x.tag}{attrs}>")
            safe = mode == "xml" or x.tag != "script"
            if not single:
                for child in x.children:
                    write(child)
                out.append(f"</{x.tag}>")
                safe = False
        elif x[0] == "comment":
            out.append(f"<!--{x[1]}-->")
        elif x[2] is None:
            out.append(f"<?{x[1]}?>")
        else:
            out.append(f"<?{x[1]}" + "".join(f' {escape(k)}="{escape_attr(v)}"' for k, v in x[2]) + "?>")

    write(node)
    return "".join(out)


def roundtrip(text: str | None, mode: str = "html") -> str | None:
    node = parse(text, mode)
    return None if node is None else to_html(node, mode)


def _listed(node: Any) -> Any:
    if isinstance(node, Node):
        return [node.tag, [list(a) for a in node.attrs], [_listed(c) for c in node.children]]
    return node if isinstance(node, str) else list(node)


def tree_json(text: str | None, mode: str = "html", lowercase: bool = False) -> str | None:
    """[tag, [[name, value]...], [children...]] as JSON; comments and instructions as ["comment", text] and ["pi", ...]."""
    node = parse(text, mode, lowercase)
    return None if node is None else json.dumps(_listed(node), ensure_ascii=False)


def _mapped(node: Node, into: dict) -> dict:
    if any(isinstance(c, Node) for c in node.children):
        inner: dict = {}
        for child in reversed(node.children):
            if isinstance(child, Node):
                _mapped(child, inner)
        if node.attrs:
            inner["@attributes"] = dict(node.attrs)
        values = [inner]
    else:
        values = [c for c in node.children if isinstance(c, str)]
        if node.attrs:
            values = [{"@attributes": dict(node.attrs), "value": values}]
    into[node.tag] = values + into.get(node.tag, [])
    return into


def to_map_json(text: str | None, mode: str = "html", lowercase: bool = True) -> str | None:
    """Elements as keys with lists of values, attributes under @attributes: JSON."""
    node = parse(text, mode, lowercase)
    return None if node is None else json.dumps(_mapped(node, {}), ensure_ascii=False, sort_keys=True)


def _pairs(attrs: list | None) -> list[dict] | None:
    return None if attrs is None else [{"k": k, "v": v} for k, v in attrs]


def token_rows(text: str | None, mode: str = "html", lowercase: bool = False) -> list[dict] | None:
    return None if text is None else _rows(tokens(text, mode, lowercase))


def _rows(found: list[tuple]) -> list[dict]:
    out = []
    for t in found:
        row = dict.fromkeys(("kind", "name", "attrs", "data", "is_ws", "singleton")) | {"kind": t[0]}
        if t[0] == "start":
            row |= {"name": t[1], "attrs": _pairs(t[2]), "singleton": t[3]}
        elif t[0] == "end":
            row["name"] = t[1]
        elif t[0] == "data":
            row |= {"data": t[1], "is_ws": t[2]}
        elif t[0] == "pi":
            row |= {"data": t[1]} if t[2] is None else {"name": t[1], "attrs": _pairs(t[2])}
        else:
            row["data"] = t[1] if isinstance(t[1], str) else " ".join(t[1])
        out.append(row)
    return out


def node_rows(text: str | None, mode: str = "html", lowercase: bool = False) -> list[dict] | None:
    """The tree in pre-order: a row for each element and text, with its parent and depth."""
    root = parse(text, mode, lowercase)
    if root is None:
        return None
    out: list[dict] = []
    todo: list[tuple[Any, int | None, int]] = [(root, None, 0)]
    while todo:
        node, parent, depth = todo.pop()
        row = {"node_id": len(out), "parent_id": parent, "depth": depth, "tag": None, "attrs": None, "text": None}
        if isinstance(node, Node):
            row |= {"tag": node.tag, "attrs": _pairs(node.attrs)}
            todo += [(c, row["node_id"], depth + 1) for c in reversed(node.children)]
        elif isinstance(node, str):
            row["text"] = node
        else:
            row |= {"tag": "!--" if node[0] == "comment" else "?", "text": node[1]}
        out.append(row)
    return out


def _node(value: Any) -> Any:
    """A tree in JSON as nodes; [tag, children] and [tag] are short forms."""
    if isinstance(value, str):
        return value
    if value[0] in ("comment", "pi") and not isinstance(value[-1], list):
        return tuple(value) if value[0] == "comment" or len(value) == 3 else ("pi", value[1], None)
    tag, *rest = value
    attrs, children = ([], rest[0] if rest else []) if len(rest) < 2 else rest
    return Node(tag, [(k, v) for k, v in attrs], [_node(c) for c in children])


def json_to_html(text: str | None, mode: str = "html") -> str | None:
    return None if text is None else to_html(_node(json.loads(text)), mode)


def tree_tokens(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    found: list[tuple] = []

    def walk(x: Any) -> None:
        if isinstance(x, str):
            found.append(("data", x, x.strip(_WS) == ""))
        elif isinstance(x, Node):
            found.append(("start", x.tag, x.attrs, not x.children and x.tag in VOID))
            if not found[-1][3]:
                for child in x.children:
                    walk(child)
                found.append(("end", x.tag))
        else:
            found.append(x)

    walk(_node(json.loads(text)))
    return _rows(found)


def tokens_to_tree(rows: list[Any] | None, mode: str = "html") -> str | None:
    """Token rows to a tree in JSON; data of white space only is dropped where a token says so."""
    if rows is None:
        return None
    pairs = lambda a: None if a is None else [(x["k"], x["v"]) for x in a]
    found: list[tuple] = []
    for r in rows:
        kind = r["kind"]
        if kind == "start":
            found.append((kind, r["name"], pairs(r["attrs"]) or [], bool(r["singleton"])))
        elif kind == "end":
            found.append((kind, r["name"]))
        elif kind == "data":
            found.append((kind, r["data"], bool(r["is_ws"])))
        elif kind == "pi":
            found.append((kind, r["data"], None) if r["name"] is None else (kind, r["name"], pairs(r["attrs"]) or []))
        else:
            found.append((kind, r["data"] if kind == "comment" else (r["data"] or "").split(" ")))
    node = tree(found, mode)
    return None if node is None else json.dumps(_listed(node), ensure_ascii=False)
