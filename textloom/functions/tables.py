"""Table functions: one row in, many rows out, for LATERAL joins in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..core import css as CSS
from ..core import html as H
from ..core import parser as P
from .udf import ATTRS, BOOL, INT, TEXT, struct


@udtf(returnType=struct(seq=INT, kind=TEXT, name=TEXT, attrs=ATTRS, data=TEXT, is_ws=BOOL, singleton=BOOL))
class HtmlTokens:
    def eval(self, html: str) -> Iterator[tuple]:
        for i, r in enumerate(P.token_rows(html) or []):
            yield i, r["kind"], r["name"], r["attrs"], r["data"], r["is_ws"], r["singleton"]


@udtf(returnType=struct(node_id=INT, parent_id=INT, depth=INT, tag=TEXT, attrs=ATTRS, text=TEXT))
class HtmlNodes:
    def eval(self, html: str) -> Iterator[tuple]:
        for r in P.node_rows(html) or []:
            yield r["node_id"], r["parent_id"], r["depth"], r["tag"], r["attrs"], r["text"]


@udtf(returnType=struct(seq=INT, tag=TEXT, href=TEXT, text=TEXT))
class HtmlLinks:
    """The a and area elements with an href, in order."""

    def eval(self, html: str) -> Iterator[tuple]:
        rows = P.node_rows(html) or []
        text: dict[int, list[str]] = {}
        parent = {r["node_id"]: r["parent_id"] for r in rows}
        links = {r["node_id"]: (r["tag"], next((a["v"] for a in r["attrs"] if a["k"] == "href"), None)) for r in rows if r["tag"] in ("a", "area")}
        for r in rows:
            if r["text"] is not None and r["tag"] is None:
                up = r["parent_id"]
                while up is not None:
                    if up in links:
                        text.setdefault(up, []).append(r["text"])
                    up = parent[up]
        for seq, (node, (tag, href)) in enumerate((k, v) for k, v in links.items() if v[1] is not None):
            yield seq, tag, href, "".join(text.get(node, []))


@udtf(returnType=struct(seq=INT, kind=TEXT, line=INT, text=TEXT))
class CssTokens:
    def eval(self, css: str) -> Iterator[tuple]:
        for i, r in enumerate(CSS.token_rows(css) or []):
            yield i, r["kind"], r["line"], r["text"]


@udtf(returnType=struct(attrs=T.MapType(TEXT, TEXT)))
class LinkElements:
    def eval(self, html: str) -> Iterator[tuple]:
        for attrs in H.scrape_link_elements(html) or []:
            yield (attrs,)


TABLE_FUNCTIONS = {"html_tokens": HtmlTokens, "html_nodes": HtmlNodes, "html_links": HtmlLinks, "css_tokens": CssTokens, "link_elements": LinkElements}


def register_tables(spark: SparkSession) -> None:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
