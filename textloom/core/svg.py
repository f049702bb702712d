"""SVG without scripts and without references to elsewhere."""

from __future__ import annotations

from typing import Any

from . import html
from .parser import Node, parse
from .tables import SVG_ATTRS, SVG_TAGS

_PROLOG = '<?xml version="1.0" standalone="no"?><!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd">'
_BLANK = "".join(map(chr, range(33)))


def _local(value: str) -> bool:
    value = value.lstrip(_BLANK)
    if value.startswith("#"):
        return True
    if value.startswith("url(#"):
        return value.find(")") == len(value) - 1
    return "://" not in value


def write(node: Any, out: list[str]) -> None:
    """Appends the allowed part of a tree; an element that is not allowed goes with all it holds."""
    if isinstance(node, str):
        out.append(html.marks(node))
    elif not isinstance(node, Node):
        if node[0] == "comment":
            out.append("<!--" + node[1].replace("<", "&lt;").replace(">", "&gt;") + "-->")
    elif node.tag in SVG_TAGS:
        out.append(f"<{node.tag}")
        for name, value in node.attrs:
            space = name.startswith("xmlns:")
            if not space and name not in SVG_ATTRS:
                continue
            if not space and name != "xmlns":
                value = html.attr_value(name.split(":", 1)[-1], value) if _local(value) else ""
            out.append(f' {name}="{html.escape(value)}"')
        out.append(">")
        for child in node.children:
            write(child, out)
        out.append(f"</{node.tag}>")


def sanitize(text: str | None) -> str | None:
    if text is None:
        return None
    text = text.lstrip(_BLANK)
    node, out = parse(text), [_PROLOG] if text.startswith("<?xml ") else []
    if node is not None:
        write(node, out)
    return "".join(out)
