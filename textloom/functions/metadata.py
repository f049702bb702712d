"""Page metadata: one parse gives a struct, and all getters are plain expressions on it."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import metadata as K
from .strings import ColumnOrName, _c, trim
from .udf import BOOL, LONG, TEXT, kernel3, struct
from .urls import site_name

_PAIRS = T.ArrayType(struct(name=TEXT, value=TEXT))
METADATA = struct(
    final_url=TEXT,
    content_type=TEXT,
    content_type_options=_PAIRS,
    content_length=LONG,
    metadata=T.ArrayType(struct(key=TEXT, value=TEXT, link=TEXT)),
    links=T.MapType(TEXT, T.ArrayType(T.MapType(TEXT, TEXT))),
    is_index_page=BOOL,
    headers=_PAIRS,
    filename=TEXT,
)


def _pairs(headers: Any) -> Iterable[tuple[str, str]] | None:
    if headers is None:
        return None
    return [(h["name"], h["value"]) for h in headers if h["name"] is not None and h["value"] is not None]


def _row(url: str | None, headers: Any, body: str | bytes | None) -> dict | None:
    return K.metadata(url, _pairs(headers), body)


_metadata = kernel3(_row, METADATA)


def url_metadata(url: ColumnOrName, body: ColumnOrName, headers: ColumnOrName | None = None) -> Column:
    """The metadata struct of fetched pages; body is text, or bytes that are decoded by what headers and page say.

    Null or empty headers: text/html.  A null body gives null fields.
    """
    none = F.lit(None).cast(_PAIRS)
    return _metadata(_c(url), none if headers is None else F.when(F.size(_c(headers)) > 0, _c(headers)), _c(body))


def html_meta(body: ColumnOrName) -> Column:
    """A page's properties in order: array<struct<key, value, link>>."""
    return url_metadata(F.lit("https://example.com/"), body)["metadata"]


def _first(md: Column, key: str, link: bool) -> Column:
    found = F.get(F.filter(md["metadata"], lambda x: x["key"] == key), F.lit(0))
    value = F.nullif(trim(found["value"]), F.lit(""))
    return F.when(value.isNotNull(), F.nullif(found["link"], F.lit(""))) if link else value


def prop(md: ColumnOrName, *keys: str) -> Column:
    """The first of keys that has text; addresses of the page's own images and links are absolute and safe."""
    return F.coalesce(*(_first(_c(md), k, k in K.SAFE_LINKS) for k in keys))


def _link(md: Column, *keys: str) -> Column:
    return F.coalesce(*(_first(md, k, True) for k in keys))


def page_url(md: ColumnOrName) -> Column:
    return F.coalesce(_link(_c(md), "og:url", "twitter:url", "canonical_url", "short_url"), _c(md)["final_url"])


def page_site(md: ColumnOrName) -> Column:
    return F.coalesce(prop(md, "og:site_name", "twitter:site"), site_name(F.coalesce(prop(md, "canonical_url"), _c(md)["final_url"])))


def page_title(md: ColumnOrName) -> Column:
    return F.coalesce(prop(md, "og:title", "twitter:title", "mtitle", "h1", "title"), _c(md)["filename"])


def page_summary(md: ColumnOrName) -> Column:
    return prop(md, "og:description", "twitter:description", "description")


def _picture(md: Column, front: tuple[str, ...], inner: tuple[str, ...]) -> Column:
    return F.when(md["content_type"].startswith("image/"), md["final_url"]).when(md["is_index_page"], _link(md, *front)).otherwise(_link(md, *inner))


def page_image(md: ColumnOrName) -> Column:
    named = ("twitter:image:src", "twitter:image", "og:image")
    return _picture(_c(md), (*named, "image_nav", "image"), (*named, "image", "image_nav"))


def page_icon(md: ColumnOrName) -> Column:
    return _picture(_c(md), ("image_nav", "icon_touch", "icon_shortcut", "icon_fav"), ("icon_touch", "image_nav", "icon_shortcut", "icon_fav"))


def page_tags(md: ColumnOrName) -> Column:
    parts = F.transform(F.split(prop(md, "keywords"), ",", -1), lambda x: trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def header(md: ColumnOrName, name: str) -> Column:
    """The first header of this name."""
    return F.get(F.filter(_c(md)["headers"], lambda h: h["name"] == name), F.lit(0))["value"]
