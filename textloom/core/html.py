"""HTML kernels: unescape, strip, truncate, sanitize, links, properties."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from typing import Any

from . import css, svg
from .parser import Node, character, parse
from .parser import charref as charref
from .tables import ONCE_TAGS, SAFE_ATTRS, SAFE_TAGS
from .text import sanitize_utf8, trim
from .url import abs_link, decode_data_url

_EMPTY = ("wbr", "img", "hr", "br")
_DROPPED = ("head", "deleteme", "script", "style")


def marks(text: str) -> str:
    """< > and quotes as entities, ampersands as they are."""
    for old, new in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(old, new)
    return text


def escape(text: str) -> str:
    return marks(text.replace("&euro;", "€").replace("&", "&amp;"))


def escape_check(text: str) -> str:
    return marks(re.sub(r"&(?!(?:[A-Za-z]+|#[0-9A-Fa-f]*|#x27|#x2F);)", "&amp;", text.replace("&euro;", "€")))


def nl2br(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", "<br />", text)


def unescape(text: str | None) -> str | None:
    if text is None or "&" not in text:
        return text
    # Behind the last semicolon nothing can match: references are not looked for there time and again.
    head, mark, rest = text.rpartition(";")
    return re.sub(r"&([^;]*);", lambda m: character(charref(m[1])) or m[0], head + mark) + rest


_HIDDEN = re.compile(r"<(noscript|script|style)")
_TAG_REST = re.compile(r"""(?:[^>"']|"(?:[^"\\]|\\.)*(?:"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z))*""", re.S)


def strip(html: str | None, limit: int | None = None) -> str:
    """The text between tags."""
    if not html:
        return ""
    out, size, at, n = [], 0, 0, len(html)

    def put(text: str) -> None:
        nonlocal size
        if limit is not None:
            text = text[: max(0, limit - size)]
        if text:
            out.append(text)
            size += len(text)

    while at < n and (limit is None or size < limit):
        lt = html.find("<", at)
        if lt != at:
            put(html[at : lt if lt >= 0 else n])
            if lt < 0:
                break
            at = lt
            continue
        if quiet := next((t for t in ("<wbr>", "</span>", "</a>") if html.startswith(t, at)), None):
            at += len(quiet)
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            if end < 0:
                break
            at = end + 3
            continue
        if m := _HIDDEN.match(html, at):
            close = f"</{m[1]}"
            end = html.find(close, m.end())
            if end < 0:
                break
            at = end + len(close)
        else:
            at += 1
        at = _TAG_REST.match(html, at).end() + 1
        if at >= n:
            break
        if html[at] <= " ":
            put(html[at])
            at += 1
        elif out and not html.startswith("</", at) and out[-1][-1] > " ":
            put(" ")
    return "".join(out)


def truncate(html: str | None, n: int, append: str = "") -> str | None:
    """n characters of text; tags are free and closed again, an entity is one character."""
    if html is None:
        return None
    if n <= 0:
        return ""
    if len(html.encode()) <= n:
        return html
    out, opened = [], []
    for m in re.finditer(r"<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|&[^;]*(?:;|\Z)|.", html, re.S):
        piece = m[0]
        if n == 0 and not piece.startswith("</"):
            return "".join([*out, append, *(f"</{t}>" for t in reversed(opened))])
        if piece.startswith("<!--"):
            out.append(piece)
        elif piece[0] == "<":
            if not piece.endswith(">"):
                break
            out.append(piece)
            if piece.startswith("</"):
                opened = opened[:-1]
            elif not piece.endswith("/>"):
                opened.append(piece[1:-1].split(" ")[0])
        else:
            out.append(piece)
            n -= 1
    return "".join(out)


def ensure_escaped_amp(html: str | None) -> str:
    """Ampersands that begin no entity are escaped; a comment that does not end takes the rest along."""
    if html is None:
        return ""
    at = html.find("<!--")
    while at >= 0:
        end = html.find("-->", at + 4)
        if end < 0:
            html = html[:at]
            break
        at = html.find("<!--", end + 3)
    return re.sub(r"(<!--.*?-->)|&(?!(?:[A-Za-z]+|#[0-9A-Fa-f]*);)", lambda m: m[1] or "&amp;", html, flags=re.S)


def noscript(url: str | None, allow_data: bool = False) -> str | None:
    """url without a scheme that runs scripts."""
    if url is None:
        return None
    url = trim(sanitize_utf8(url) or "")
    seen, ahead = [], list(reversed(url))
    while ahead and ahead[-1] not in ":/#":
        c = ahead.pop()
        if c == "%":
            digits = "".join(reversed(ahead[-2:]))
            if not re.fullmatch(r"[0-9A-Fa-f]{2}", digits):
                return ""
            del ahead[-2:]
            # A byte above ASCII is no character by itself.
            if (code := int(digits, 16)) < 128:
                ahead.append(chr(code))
        elif c > " " and c != "\\":
            seen.append(c.lower() if c.isascii() else c)
    seen = "".join(seen)
    if not ahead or ahead[-1] != ":":
        return url if ahead or seen else ""
    rest = "".join(reversed(ahead[:-1]))
    if seen in ("javascript", "script", "vbscript"):
        return "#script-removed"
    if seen == "data":
        if not allow_data:
            return ""
        safe = _safe_data(rest)
        return f"data:{safe}" if safe else ""
    return f"{seen}:{trim(rest) if seen == 'mailto' else rest}"


def _safe_data(data: str) -> str:
    if data.startswith("image/svg"):
        found = decode_data_url(f"data:{data}")
        if not found or not found["ok"]:
            return ""
        clean = svg.sanitize(found["data"].decode("utf-8", "ignore")) or ""
        return f"{found['mime']};base64,{base64.b64encode(clean.encode()).decode()}"
    return data if data.startswith(("image/", "audio/", "video/", "text/plain;")) else ""


def ensure_protocol(link: str) -> str:
    if not link or link[0] in "#?/" or link.startswith(("http:", "https:", "data:", "urn:", "ftp:")):
        return link
    if link.startswith("://"):
        return f"http{link}"
    if link.startswith("mailto:"):
        return f"mailto:{trim(link[7:])}"
    if link.startswith("www."):
        return f"https://{link}"
    if ":" in link:
        return link
    return f"https://{link}" if "." in link.split("/")[0] else f"/{link}"


def sanitize_uri(uri: str | None, allow_data: bool = True) -> str | None:
    if not uri:
        return uri
    url = ensure_protocol(noscript(trim(uri), allow_data) or "")
    extra = ",;" if url.startswith("data:") else ""
    whole = rb"%[0-9A-Z]{2}|[A-Za-z0-9_.~&:/=?#+" + extra.encode() + rb"-]|."
    return re.sub(whole, lambda m: m[0] if len(m[0]) > 1 or re.match(rb"[A-Za-z0-9_.~&:/=?#+" + extra.encode() + rb"-]", m[0]) else b"%%%02X" % m[0][0], url.encode(), flags=re.S).decode()


_LINK = re.compile(r"(?:mailto:[-a-zA-Z0-9_.()+=%~]+@|ftp://|https?://|www\.)[-a-zA-Z0-9]+(?:\.[-a-zA-Z0-9]+)+(?:/[-/_a-zA-Z0-9.:+%;~]*)?(?:\?[-_a-zA-Z0-9.:+%=&;$/~]*)?(?:#[-_a-zA-Z0-9.:+%=&;$/~]*)?")


def escape_link(text: str | None) -> str | None:
    """Escaped text with its addresses as links."""
    if text is None:
        return None
    out, at = [], 0
    for m in _LINK.finditer(text):
        safe = noscript(m[0]) or ""
        out += [escape(text[at : m.start()]), f'<a href="{escape(ensure_protocol(safe))}" rel="noopener nofollow noreferrer">{escape(safe)}</a>']
        at = m.end()
    return nl2br("".join([*out, escape(text[at:])]))


def scrape_link_elements(html: str | None) -> list[dict[str, str]] | None:
    """The attributes of each link tag, names in lower case."""
    if html is None:
        return None
    found = (parse(f"<p>{m}</p>") for m in re.findall(r"<link[^>]+>", html, re.I))
    return [{k.lower(): v for k, v in node.children[0].attrs} for node in found if node and node.children and isinstance(node.children[0], Node)]


def abs_links(html: str | None, base: str | None) -> str:
    """src and href made absolute; of equal ones the first that is still to be found, each time."""
    if html is None:
        return ""
    for attr, link in re.findall(r'(src|href)="([^"]*)"', html):
        full = abs_link(link, base or "")
        if full != link:
            html = html.replace(f'{attr}="{link}"', f'{attr}="{full}"', 1)
    return html


def _rel(attrs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """A target gets a rel that gives nothing away, except on links of the own site."""
    if not any(k == "target" for k, _ in attrs):
        return attrs
    href = next((v for k, v in attrs if k == "href"), "")
    if href[:1] in ("#", "/"):
        return attrs
    words = next((v for k, v in attrs if k == "rel"), "").split()
    for word in ("follow", "opener", "referrer", "nofollow", "noopener", "noreferrer"):
        if word in words:
            words.remove(word)
    return [("rel", " ".join(["nofollow", "noopener", "noreferrer", *words])), *((k, v) for k, v in attrs if k != "rel")]


def attr_value(name: str, value: str) -> str:
    if name == "style":
        found = css.sanitize_style(value)
        return found["css"] if found and found["ok"] else ""
    if name == "class":
        return re.sub(r"do_[0-9a-zA-Z_]+", "", value)
    if name in ("href", "src", "poster"):
        return noscript(value, name != "href") or ""
    return value


def _allowed(tag: str, stack: list[str], elements: tuple[str, ...]) -> bool:
    return tag in SAFE_TAGS or tag in elements or tag in ONCE_TAGS and tag not in stack


def sanitize(html: str | None, elements: tuple[str, ...] = (), attributes: tuple[str, ...] = (), element: Callable[[Any, list[str]], Any] | None = None) -> str | None:
    """HTML with allowed elements and attributes only."""
    if html is None:
        return None
    root = parse(f"<sanitize>{ensure_escaped_amp(html)}</sanitize>")

    def hook(node: Any, stack: list[str]) -> Any:
        if element is not None:
            return element(node, stack)
        return "" if isinstance(node, tuple) and re.search("[<>]", node[1]) else node

    def write(node: Any, stack: list[str]) -> str:
        if isinstance(node, str):
            kept = hook(("text", node), stack) if element else ("text", node)
            return escape(kept[1]) if isinstance(kept, tuple) and kept[0] == "text" else flat(kept, stack)
        if isinstance(node, tuple):
            return flat(hook(node, stack), stack) if node[0] == "comment" else ""
        if node.tag == "li" and (not stack or stack[0] not in ("ul", "ol")):
            return write(Node("ul", [], [node]), stack)
        if node.tag == "svg":
            drawn: list[str] = []
            if "svg" in elements:
                svg.write(node, drawn)
            return "".join(drawn)
        if not _allowed(node.tag, stack, elements):
            return "" if node.tag in _DROPPED else "".join(write(c, stack) for c in node.children)
        inner = "".join(write(c, [node.tag, *stack]) for c in node.children)
        kept = [(k, v) for k, v in node.attrs if k in SAFE_ATTRS or k in attributes or k.startswith("data-") and "data-" in attributes]
        return flat(hook(Node(node.tag, kept, [("safe", inner)]), stack), stack)

    def flat(node: Any, stack: list[str]) -> str:
        if isinstance(node, str):
            return marks(node)
        if isinstance(node, tuple):
            return node[1] if node[0] == "safe" else f"<!--{node[1].replace('-->', '-- >')}-->"
        if node is None:
            return ""
        inner = "".join(flat(c, stack) for c in node.children)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in _rel([(k, attr_value(k, v)) for k, v in node.attrs]))
        return f"<{node.tag}{attrs} />" if node.tag in _EMPTY and not inner else f"<{node.tag}{attrs}>{inner}</{node.tag}>"

    if root is None:
        return ""
    return "".join(write(c, [] if element is None else []) for c in root.children)


def _bool(v: Any) -> bool:
    return v not in (None, False, 0, "", "\x00", "0", "false", "FALSE", "n", "N", "no", "NO", "disabled", "DISABLED", [], {})


def _int(v: Any) -> int | None:
    try:
        return int(v) if re.fullmatch(r"[+-]?[0-9]+", str(v)) else None
    except ValueError:
        return None


def _by_type(keys: list[str], value: Any, check: bool) -> Any:
    """keys: the parts of the name that are still to be looked at, last first."""
    safe = escape_check if check else escape
    kind, rest = (keys[0], keys[1:]) if keys else ("", [])
    if value is None or isinstance(value, bool | int | float):
        return value
    if kind == "list":
        values = value if isinstance(value, list) else [value]
        return [_by_type(rest, v, check) for v in values]
    if kind == "unsafe":
        return value
    if isinstance(value, dict):
        return escape_props(value, check)
    if isinstance(value, list):
        return [_by_type(rest, v, check) for v in value]
    if kind == "html":
        return sanitize(value)
    if kind in ("uri", "url"):
        return safe(sanitize_uri(unescape(value) if check else value) or "")
    if kind == "int":
        return _int(value)
    if kind == "id" and not check:
        return None if value == "" else _int(value) if _int(value) is not None else safe(value)
    return safe(value)


def escape_props(props: dict, check: bool = False) -> dict:
    """Each value made safe by the name of its key."""
    safe = escape_check if check else escape
    out = {}
    for key, value in props.items():
        if value is None or isinstance(value, bool | int | float):
            out[key] = value
        elif key.startswith("body") and isinstance(value, str):
            out[key] = sanitize(value)
        elif key == "summary" and isinstance(value, str):
            out[key] = nl2br(safe(value))
        elif key == "blocks" and isinstance(value, list):
            out[key] = [escape_props(v, check) if isinstance(v, dict) else v for v in value]
        elif key in ("website", "@id") and isinstance(value, str):
            out[key] = safe(sanitize_uri(unescape(value) if check else value) or "")
        elif key.startswith("is_a"):
            out[key] = [_by_type([], v, check) for v in (value if isinstance(value, list) else [value])]
        elif key.startswith("is_"):
            out[key] = _bool(value)
        else:
            out[key] = _by_type(key.split("_")[::-1], value, check)
    return out


def escape_props_json(text: str | None, check: bool = False) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return json.dumps(escape_props(value, check), ensure_ascii=False) if isinstance(value, dict) else None
