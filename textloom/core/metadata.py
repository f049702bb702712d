"""What a fetched page says about itself: titles, descriptions, images, icons, links."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any
from urllib.parse import unquote_plus

from .html import sanitize_uri
from .parser import Node, parse
from .text import trim
from .url import abs_link, parts

#: Parts of addresses of tracking pixels, the size up to which an image is small.
TRACKERS = ("//www.facebook.com/tr?", "//www.googleadservices.com/pagead/", "futuresimple.com/api/v1/", "tracking.cirrusinsight.com", "list-manage.com/track", "mjt.lu/oo", "/1x1/")
SMALL = 16
#: What a meta element's name, and a link element's rel, is filed under.
META_KEYS = {"title": "mtitle", "keywords": "keywords", "description": "description", "author": "author", "thumbnail": "thumbnail", "content-type": "content_type"}
LINK_KEYS = {"canonical": "canonical_url", "shortlink": "short_url", "shorturl": "short_url", "icon": "icon_fav", "shortcut icon": "icon_shortcut", "apple-touch-icon": "icon_touch"}
#: Keys whose values are addresses: made absolute and safe, or absolute only.
SAFE_LINKS = frozenset(("canonical_url", "short_url", "image_nav", "image", "icon_nav", "icon_shortcut"))
PLAIN_LINKS = frozenset(("og:url", "twitter:url", "twitter:image:src", "twitter:image", "og:image", "icon_touch", "icon_fav"))
_FRONT = re.compile(r"(/|/index\..*|/default\.htm|/Default\.htm|index\..*|default\.htm|Default\.htm)?\Z", re.S)
_CHARSET = re.compile(rb"<meta[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)

Pairs = list[tuple[str, str]]


def parse_header(text: str) -> tuple[str, Pairs]:
    """`type; name=value; ...` with names in lower case and quotes taken off the values."""
    first, *rest = (trim(x) for x in text.split(";"))
    split = (x.partition("=") for x in rest)
    return first, [(trim(k).casefold(), _unquoted(trim(v))) for k, eq, v in split if k and eq and v]


def _unquoted(value: str) -> str:
    if not value.startswith('"'):
        return value
    inner = value[1:]
    if re.fullmatch(r'(?:[^\\]|\\.)*"', inner, re.S):
        inner = inner[:-1]
    return re.sub(r"\\(.)", r"\1", inner, flags=re.S)


def split_links(header: str) -> list[str]:
    """A Link header's items: cut at commas outside of quotes and angle brackets."""
    items = re.findall(r'(?:"[^"]*"?|<[^>]*>?|[^",<])+|(?<=,)(?=,|\Z)', header)
    return [trim(x) for x in items] or [""]


def lower_headers(headers: Iterable[tuple[str, str]]) -> Pairs:
    out: Pairs = []
    for k, v in headers:
        low = k.casefold()
        out += [(low, v)] if low == k else [(low, v), (k, v)]
    return out


def first(pairs: Pairs, key: str) -> str | None:
    return next((v for k, v in pairs if k == key), None)


def content_length(headers: Pairs) -> int | None:
    span = first(headers, "content-range")
    text = first(headers, "content-length") if span is None else span.rpartition("/")[2] if span.startswith("bytes ") else None
    return int(text) if text is not None and re.fullmatch(r"[+-]?[0-9]+", text) else None


def is_html(mime: str) -> bool:
    return mime in ("text/html", "application/xhtml") or mime.startswith("application/xhtml+")


def is_text(mime: str) -> bool:
    return mime.startswith("text/") or mime == "application/javascript" or is_html(mime)


def decode(body: bytes, charset: str | None, html: bool) -> str:
    """body as text: by the header's charset, else Latin-1; a meta element overrules both."""
    name = charset or "iso-8859-1"
    if html and (m := _CHARSET.search(body)):
        name = m[1].decode()
    try:
        return body.decode(name.lower())
    except (LookupError, UnicodeDecodeError):
        return body.decode("utf-8", "ignore")


def is_index_page(url: str) -> bool:
    _, _, path, query = parts(url)
    return query is None and bool(_FRONT.match(path))


def filename(url: str, headers: Pairs) -> str | None:
    """The name in the content disposition, else the last part of the address' path."""
    named = first(headers, "content-disposition")
    if named is not None and (name := first(parse_header(named)[1], "filename")):
        return name
    last = "" if url.startswith("data:") else parts(url)[2].rpartition("/")[2]
    if not last:
        return None
    return last if re.search(r"%(?![0-9A-Fa-f]{2})", last) else unquote_plus(last)


def _text(nodes: list[Any]) -> str:
    out, todo = [], list(reversed(nodes))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, Node):
            todo += reversed(node.children)
    return trim("".join(out))


def _small(size: str | None) -> bool:
    return bool(size) and bool(re.fullmatch(r"[+-]?[0-9]+", size)) and int(size) <= SMALL


class _Walk:
    def __init__(self) -> None:
        self.found: Pairs = []
        self.links: list[tuple[str, dict[str, str]]] = []
        self.has_h1 = False

    def meta(self, node: Node) -> None:
        name = (node.get("name") or "").casefold() or node.get("property") or node.get("http-equiv")
        if not name:
            if (charset := node.get("charset")) is not None:
                self.found.append(("charset", charset))
            return
        content = node.get("content")
        content = node.get("value") if content is None else content
        key = name if name.startswith(("og:", "twitter:")) else META_KEYS.get(name)
        if key and content:
            self.found.append((key, content))

    def link(self, node: Node) -> None:
        rel, href = (node.get("rel") or "").casefold(), node.get("href")
        if not rel or href is None or not (href := trim(href)):
            return
        if (key := LINK_KEYS.get(rel)) and href != "undefined" and not (rel == "icon" and node.get("mask") is not None):
            self.found.append((key, href))
        self.links.append((rel, {k: v for k, v in node.attrs if k != "rel"} | {"href": href}))

    def image(self, node: Node, in_nav: bool) -> None:
        src = node.get("src")
        if src and not any(x in src for x in TRACKERS) and not _small(node.get("width")) and not _small(node.get("height")):
            self.found.append(("image_nav" if in_nav else "image", src))

    def go(self, root: Node) -> None:
        todo: list[tuple[Any, bool]] = [(root, False)]
        while todo:
            node, in_nav = todo.pop()
            if not isinstance(node, Node):
                continue
            tag = node.tag
            if tag == "meta":
                self.meta(node)
            elif tag == "link":
                self.link(node)
            elif tag == "img":
                self.image(node, in_nav)
            elif tag == "title":
                self.found.append(("title", _text(node.children)))
            elif tag == "h1":
                if not in_nav and not self.has_h1:
                    self.has_h1 = True
                    self.found.append(("h1", _text(node.children)))
            else:
                if tag == "html":
                    if (lang := node.get("lang")) is not None:
                        self.found.append(("language", lang))
                elif tag in ("nav", "header", "footer", "aside"):
                    in_nav = True
                else:
                    classes, own = (node.get("class") or "").split(" "), node.get("id") or ""
                    if own in ("ad", "ads") or not {"ads", "ad", "deckad"}.isdisjoint(classes):
                        continue
                    in_nav = in_nav or any(c.startswith(("nav", "menu")) for c in classes) or own == "top" or own.startswith("header")
                todo += [(c, in_nav) for c in reversed(node.children)]


def html_meta(html: str) -> tuple[Pairs, list[tuple[str, dict[str, str]]]]:
    """A page's properties in order, and its link elements by rel."""
    walk = _Walk()
    if root := parse(f"<partial>{html}</partial>"):
        walk.go(root)
    return walk.found, walk.links


def metadata(url: str | None, headers: Iterable[tuple[str, str]] | None, body: str | bytes | None) -> dict | None:
    """All that is known of a page; without headers it is taken for HTML, without address for https://example.com/."""
    if body is None:
        return None
    url = url or "https://example.com/"
    known = lower_headers(headers or [("content-type", "text/html")])
    mime, options = parse_header(first(known, "content-type") or "application/octet-stream")
    mime = mime.casefold()
    html = is_html(mime)
    if isinstance(body, bytes | bytearray):
        body = decode(bytes(body), first(options, "charset"), html) if is_text(mime) else ""
    found, elements = html_meta(body) if html else ([], [])
    links: dict[str, list[dict[str, str]]] = {}
    for value in (v for k, v in known if k == "link"):
        for item in split_links(value):
            href, fields = parse_header(item)
            rel = trim(first(fields, "rel") or "").casefold()
            if href and rel:
                bare = href[1:-1] if href.startswith("<") and href.endswith(">") else href
                links.setdefault(rel, []).append({k: v for k, v in reversed(fields) if k != "rel"} | {"href": bare})
    for rel, attrs in elements:
        links.setdefault(rel, []).append(attrs)

    def target(key: str, value: str) -> str | None:
        value = trim(value)
        if not value or key not in SAFE_LINKS and key not in PLAIN_LINKS:
            return None
        full = abs_link(value, url)
        return full if key in PLAIN_LINKS else abs_link(sanitize_uri(full) or "", url)

    return {
        "final_url": url,
        "content_type": mime,
        "content_type_options": [{"name": k, "value": v} for k, v in options],
        "content_length": content_length(known),
        "metadata": [{"key": k, "value": v, "link": target(k, v)} for k, v in found],
        "links": links,
        "is_index_page": is_index_page(url),
        "headers": [{"name": k, "value": v} for k, v in known],
        "filename": filename(url, known),
    }
