"""HTML, SVG, CSS and JavaScript functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import css as CSS
from ..core import html as H
from ..core import minify as M
from ..core import parser as P
from ..core import svg as S
from .strings import ColumnOrName, _c
from .udf import ATTRS, BOOL, INT, TEXT, kernel, kernel2, struct


def _chain(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_MARKS = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def escape(c: ColumnOrName) -> Column:
    return _chain(_c(c), ("&euro;", "€"), ("&", "&amp;"), *_MARKS)


def escape_check(c: ColumnOrName) -> Column:
    """escape that keeps entities that are there already."""
    text = F.replace(_c(c), F.lit("&euro;"), F.lit("€"))
    return _chain(F.regexp_replace(text, r"&(?!(?:[A-Za-z]+|#[0-9A-Fa-f]*|#x27|#x2F);)", "&amp;"), *_MARKS)


def escape_map(c: ColumnOrName) -> Column:
    """escape for the values of a map of languages."""
    return F.transform_values(_c(c), lambda k, v: escape(v))


def escape_text(c: ColumnOrName) -> Column:
    """The parser's own form: & < > and the no-break space."""
    return _chain(_c(c), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\xa0", "&nbsp;"))


def escape_attr(c: ColumnOrName) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def escape_html_text(c: ColumnOrName) -> Column:
    """Marks but not ampersands."""
    return _chain(_c(c), *_MARKS)


def escape_html_comment(c: ColumnOrName) -> Column:
    return _chain(_c(c), ("<", "&lt;"), (">", "&gt;"))


def nl2br(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), "\r\n|\r|\n", "<br />")


def br2nl(c: ColumnOrName) -> Column:
    return _chain(_c(c), ("<br/>", "\n"), ("<br />", "\n"))


unescape = kernel(H.unescape)
escape_link = kernel(H.escape_link)
ensure_escaped_amp = kernel(H.ensure_escaped_amp)
abs_links = kernel2(H.abs_links)
charref = kernel(H.charref, T.LongType())
svg_sanitize = kernel(S.sanitize)
css_minify = kernel(M.css)
js_minify = kernel(M.js)
js_minify_checked = kernel(M.js_checked, struct(js=TEXT, error=TEXT))
_roundtrip = kernel(P.roundtrip)
html_to_map = kernel(P.to_map_json)
_tree = kernel(P.tree_json)
PAIRS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
scrape_link_elements = kernel(H.scrape_link_elements, PAIRS)
TOKENS = T.ArrayType(struct(kind=TEXT, name=TEXT, attrs=ATTRS, data=TEXT, is_ws=BOOL, singleton=BOOL))
NODES = T.ArrayType(struct(node_id=INT, parent_id=INT, depth=INT, tag=TEXT, attrs=ATTRS, text=TEXT))
STYLE = struct(ok=BOOL, css=TEXT, line=INT, error=TEXT)
css_sanitize = kernel(CSS.sanitize, STYLE)
css_sanitize_style = kernel(CSS.sanitize_style, STYLE)
CSS_TOKENS = T.ArrayType(struct(kind=TEXT, line=INT, text=TEXT))
css_tokens = kernel(CSS.token_rows, CSS_TOKENS)


def html_tokens(c: ColumnOrName, mode: str = "html", lowercase: bool = False) -> Column:
    """All tokens; mode xml: no element is special and names stay as they are; lowercase: all names are lower-cased."""
    return kernel(P.token_rows, TOKENS, mode=mode, lowercase=lowercase)(_c(c))


def html_nodes(c: ColumnOrName, mode: str = "html", lowercase: bool = False) -> Column:
    """The tree in pre-order."""
    return kernel(P.node_rows, NODES, mode=mode, lowercase=lowercase)(_c(c))


def html_tree(c: ColumnOrName, mode: str = "html", lowercase: bool = False) -> Column:
    """The tree in JSON."""
    return kernel(P.tree_json, mode=mode, lowercase=lowercase)(_c(c))


def html_roundtrip(c: ColumnOrName, mode: str = "html") -> Column:
    """The text of the tree."""
    return kernel(P.roundtrip, mode=mode)(_c(c))


def strip(c: ColumnOrName, limit: int | None = None) -> Column:
    """The text of HTML, at most limit characters; null: empty."""
    return kernel(H.strip, limit=limit)(_c(c))


def truncate(c: ColumnOrName, n: int, append: str = "…") -> Column:
    return kernel(H.truncate, n=n, append=append)(_c(c))


def sanitize(c: ColumnOrName, elements: tuple[str, ...] = (), attributes: tuple[str, ...] = (), element: Callable | None = None) -> Column:
    """Safe HTML by allow-lists; further elements and attributes, and a function of (node, stack) for each element."""
    return kernel(H.sanitize, elements=elements, attributes=attributes, element=element)(_c(c))


def noscript(c: ColumnOrName, allow_data: bool = False) -> Column:
    return kernel(H.noscript, allow_data=allow_data)(_c(c))


sanitize_uri = kernel(H.sanitize_uri)


def flatten_attr(name: str, c: ColumnOrName) -> Column:
    """An attribute as it stands in a tag."""
    return F.concat(F.lit(f'{name}="'), escape(c), F.lit('"'))


def sanitize_attr_value(name: str, c: ColumnOrName) -> Column:
    """The safe form of an attribute's value: styles, classes and addresses have rules of their own."""
    return kernel(_attr_value, name=name)(_c(c))


def _attr_value(value: str | None, name: str) -> str | None:
    return None if value is None else H.attr_value(name, value)


def parse_tokens(c: ColumnOrName, mode: str = "html") -> Column:
    """The tree, as JSON, of an array of tokens as html_tokens gives them."""
    return kernel(P.tokens_to_tree, mode=mode)(_c(c))


def to_html(c: ColumnOrName, mode: str = "html") -> Column:
    """HTML text of a tree in JSON."""
    return kernel(P.json_to_html, mode=mode)(_c(c))


def to_tokens(c: ColumnOrName) -> Column:
    """Tokens of a tree in JSON."""
    return kernel(P.tree_tokens, TOKENS)(_c(c))


def escape_props(c: ColumnOrName, check: bool = False) -> Column:
    """A JSON object with every value made safe by the name of its key; check: entities that are there stay."""
    return kernel(H.escape_props_json, check=check)(_c(c))
