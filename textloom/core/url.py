"""URL kernels."""

from __future__ import annotations

import base64
import binascii
import re
from urllib.parse import quote, unquote_to_bytes

PARTS = re.compile(r"(?:([^:/?#]+):)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.S)
_KNOWN = re.compile(r"(?:https?|wss?|mailto|file|ftp|spdy|data|pass):")


def parts(url: str) -> tuple[str | None, str | None, str, str | None]:
    """Scheme, authority without user, path and query."""
    m = PARTS.fullmatch(url)
    return (m[1], m[2], m[3], m[4]) if m else (None, None, url, None)


def split_base_host(url: str) -> tuple[str, str]:
    scheme, authority, path, _ = parts(url)
    if not authority:
        return "", url
    host = f"{scheme or 'http'}://{authority}"
    folders = [p for p in path.split("/") if p][:-1]
    return host, host + "/" + "".join(f"{p}/" for p in folders)


def abs_link(link: str | None, base: str | None) -> str | None:
    """link as seen from the page base."""
    if link is None or base is None:
        return None
    host, folder = split_base_host(base)
    while True:
        if _KNOWN.match(link):
            return link
        if link.startswith("./"):
            link = link[2:]
        elif link.startswith("//"):
            return ("https:" if host.startswith("https:") else "http:") + link
        elif link.startswith("/"):
            return host + link
        elif link.startswith("../"):
            link, folder = link[3:], re.sub(r"^(.*//.*/)[^/]+/$", r"\1", folder)
        else:
            full = folder + link
            return "http" + full if full.startswith("://") else full


def decode_data_url(url: str | None) -> dict | None:
    """ok, mime, charset, data, or error."""
    if url is None:
        return None
    if not url.startswith("data:"):
        return {"ok": False, "error": "nodata"}
    head, comma, body = url[5:].partition(",")
    if not comma:
        return {"ok": False, "error": "unknown_encoding"}
    fields = head.split(";")
    mime = fields[0] if fields[0] and "=" not in fields[0] else "text/plain"
    charset = next((f[8:] for f in fields if f.startswith("charset=")), "US-ASCII")
    if fields[-1] == "base64":
        data = body.encode().translate(bytes.maketrans(b"-_", b"+/")).rstrip(b"=")
        try:
            data = base64.b64decode(data + b"=" * (-len(data) % 4))
        except binascii.Error:
            return {"ok": False, "error": "nodata"}
    else:
        data = body.encode() if fields[-1] == "utf8" else unquote_to_bytes(body.replace("+", " "))
    return {"ok": True, "mime": mime, "charset": charset, "data": data}


def percent_encode(text: str) -> str:
    return quote(text, safe="-_.~")
