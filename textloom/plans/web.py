"""Queries of the HTML, CSS, URL, metadata, network and serialisation functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import metadata as M
from ..functions import net as N
from ..functions import serial as B
from ..functions import urls as U
from ..operators import pages as P
from ..sources import fetch as X
from .base import Book, read

BOOK = Book()


def _doc(name, sql, **made):
    BOOK.columns(name, "documents", "doc_id", sql, **made)


def _page(name, sql, **made):
    BOOK.columns(name, "pages", "page_id", sql, **made)


MARKS = "replace(replace(replace(replace({0}, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_page("escape", {"t": MARKS.format("replace(replace(html, '&euro;', '€'), '&', '&amp;')")}, t=lambda: H.escape("html"))
_page("escape_check", {"t": MARKS.format(r"replace(replace(regexp_replace(replace(html, '&euro;', '€'), '&([A-Za-z]+|#[0-9A-Fa-f]*|#x27|#x2F);', chr(1) || '\1;', 'g'), '&', '&amp;'), chr(1), '&')")}, t=lambda: H.escape_check("html"))
_doc("escape_map", {"en": MARKS.format("replace(text, '&', '&amp;')")}, en=lambda: H.escape_map(F.create_map(F.lit("en"), F.col("text")))["en"])
_page("escape_text", {"t": "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;')", "attr": "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;'), '\"', '&quot;')"}, t=lambda: H.escape_text("html"), attr=lambda: H.escape_attr("html"))
_page("escape_html_text", {"t": MARKS.format("html"), "comment": "replace(replace(html, '<', '&lt;'), '>', '&gt;')"}, t=lambda: H.escape_html_text("html"), comment=lambda: H.escape_html_comment("html"))
_doc("nl2br", {"t": r"regexp_replace(text, '\r\n|\r|\n', '<br />', 'g')"}, t=lambda: H.nl2br("text"))
_doc("br2nl", {"t": "replace(text, chr(13), '')"}, t=lambda: H.br2nl(H.nl2br(F.replace("text", F.lit("\r"), F.lit("")))))
ENTITIES = "replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
_page("unescape", {"t": ENTITIES.format("html")}, t=lambda: H.unescape("html"))
# Hidden elements are tags, comments nothing; a run of tags is one space where none is beside it.
RUNS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', '<x>', 'gs'), '<style.*?</style>', '<x>', 'gs'), '<!--.*?-->', '', 'gs'), '(<[^>]*>)+', chr(1), 'g')"
STRIPPED = rf"regexp_replace(regexp_replace(regexp_replace({RUNS}, '^\x01|\x01$', '', 'g'), '([\x00-\x20])\x01|\x01([\x02-\x20])', '\1\2', 'g'), '\x01', ' ', 'g')"
_page("strip", {"t": STRIPPED, "some": f"left({STRIPPED}, 200)"}, t=lambda: H.strip("html"), some=lambda: H.strip("html", 200))
# What the tables' pages are like: in an article, paragraphs stand in a bold text that is never closed, often several.
DECODED = "replace(replace({0}, '&copy;', '©'), '&middot;', '·')"
BODY = "regexp_extract(html, '<body>(.*?)(</body>)?(</html>)?$', 1, 's')"
QUOTED = "replace(replace({0}, '\"', '&quot;'), '''', '&#39;')"
_ARTICLE = QUOTED.format(f"regexp_extract({BODY}, '</h1><p><b>(.*)</article>', 1, 's')")
_FOOTER = QUOTED.format(f"regexp_replace(regexp_extract({BODY}, '</article>(.*)$', 1, 's'), '</?footer>', '', 'g')")
INNER = f"replace(replace(replace(replace({_ARTICLE}, '<br>', '<br />'), '<p>', ''), '</p>', ''), '<b>', '')"
SANITIZED = DECODED.format(f"regexp_extract({BODY}, '^(.*</h1>)', 1, 's') || '<p><b>' || {INNER} || '</b></p></article>' || {_FOOTER}")
CLOSED = "replace(replace(replace(replace(regexp_replace(html, '(</body>)?(</html>)?$', ''), '<!DOCTYPE html>', ''), '<meta charset=\"utf-8\">', '<meta charset=\"utf-8\" />'), '<br>', '<br />'), '</article>', repeat('</b></p>', len(regexp_extract_all(html, '<b>'))) || '</article>')"
WRITTEN = f"replace({DECODED.format(CLOSED)}, '&quot;', '\"') || '</body></html>'"
PIECES = f"len(regexp_extract_all(replace({WRITTEN}, '\"</p>\"', ''), '<!--.*?-->|<[^>]*>|[^<]+'))::int"
_page("html_truncate", None, t=lambda: H.truncate("html", 300))
_page("sanitize", {"t": SANITIZED}, t=lambda: H.sanitize("html"))
_page("noscript", {"t": "regexp_replace(url, '^([^:]*):.*$', '\\1') || ':' || substr(url, strpos(url, ':') + 1)"}, t=lambda: H.noscript("url"))
_page("sanitize_uri", {"t": "url"}, t=lambda: H.sanitize_uri("url"))
_doc("escape_link", None, t=lambda: H.escape_link("text"))
_page("link_elements", {"n": "0"}, n=lambda: F.size(H.scrape_link_elements("html")))
_page("ensure_escaped_amp", {"t": r"replace(replace(regexp_replace(html, '&([A-Za-z]+|#[0-9A-Fa-f]*);', chr(1) || '\1;', 'g'), '&', '&amp;'), chr(1), '&')"}, t=lambda: H.ensure_escaped_amp("html"))
HOST = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_page("abs_links", {"t": rf'''regexp_replace(html, 'href="/([^"]*)"', 'href="' || {HOST} || '/\1"', 'g')'''}, t=lambda: H.abs_links("html", "url"))
_page("escape_props", None, t=lambda: H.escape_props(F.to_json(F.struct(F.col("html").alias("body"), F.col("url").alias("website"), F.col("url").alias("title"), F.lit("12").alias("n_int")))), check=lambda: H.escape_props(F.to_json(F.struct(F.col("html").alias("body"), F.col("html").alias("summary"), F.lit("no").alias("is_ok"))), check=True))
_page("flatten_attr", {"t": "'title=\"' || " + MARKS.format("replace(url, '&', '&amp;')") + " || '\"'"}, t=lambda: H.flatten_attr("title", "url"))
_page("sanitize_attr_value", {"href": "url", "style": "'position:absolute; '"}, href=lambda: H.sanitize_attr_value("href", "url"), style=lambda: H.sanitize_attr_value("style", F.lit("position: fixed")))

BOOK.add("html_tokens", lambda spark, sf: P.page_tokens(read(spark, sf, "pages")))
BOOK.add("html_nodes", lambda spark, sf: P.page_nodes(read(spark, sf, "pages")))
_count = lambda pattern: f"len(regexp_extract_all(html, '{pattern}'))"
BOOK.add("html_token_counts", lambda spark, sf: P.page_tokens(read(spark, sf, "pages")).groupBy("page_id").agg(F.count_if(F.col("kind") == "start").alias("starts"), F.count_if(F.col("kind") == "end").alias("ends"), F.count_if(F.col("kind") == "comment").alias("comments"), F.count_if(F.col("kind") == "doctype").alias("doctypes")), f"select page_id, {_count('<[a-z]')} as starts, {_count('</[a-z]')} - {_count('</p>.;track')} as ends, {_count('<!--')} as comments, {_count('<!DOCTYPE')} as doctypes from pages")
BOOK.add("html_node_counts", lambda spark, sf: P.page_nodes(read(spark, sf, "pages")).groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("a"), F.count_if(F.col("tag") == "li").alias("li"), F.count_if(F.col("tag") == "p").alias("p"), F.count_if(F.col("tag") == "br").alias("br")), f"select page_id, {_count('<a ')} as a, {_count('<li>')} as li, {_count('<p>')} as p, {_count('<br>')} as br from pages")
_page("html_roundtrip", {"t": WRITTEN}, t=lambda: H.html_roundtrip("html"))
_page("html_tree", None, t=lambda: H.html_tree("html"))
_page("html_parse_tokens", None, t=lambda: H.parse_tokens(H.html_tokens(F.col("html"))))
_page("html_to_tokens", {"n": PIECES}, n=lambda: F.size(H.to_tokens(H.html_tree(F.col("html")))))
_page("html_to_html", {"t": WRITTEN}, t=lambda: H.to_html(H.html_tree(F.col("html"))))
_page("html_to_map", None, t=lambda: H.html_to_map("html"))
BOOK.cases("charref", ["amp", "copy", "#1234", "#xfF", "#x", "eacute", "nosuch", "apos", "", None], {"n": "case c when 'amp' then 38 when 'copy' then 169 when '#1234' then 1234 when '#xfF' then 255 when 'eacute' then 233 end::bigint"}, n=lambda: H.charref("c"))

SVG = ['<svg xmlns="http://www.w3.org/2000/svg"><path d="M0 0" onclick="x()"/><script>x</script></svg>', '<?xml version="1.0"?><svg><a xlink:href="http://x.com/y"><text>t</text></a></svg>', "", None]
_NEW_PROLOG = '<?xml version="1.0" standalone="no"?><!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd">'
SAFE_SVG = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '<script>.*?</script>', ''), '<(path)([^>]*?) onclick="[^"]*"/>', '<\1\2></\1>'), 'xlink:href="http[^"]*"', 'xlink:href=""'), '^<\?xml [^>]*>', '{_NEW_PROLOG}')"""
BOOK.cases("svg_sanitize", SVG, {"t": SAFE_SVG}, t=lambda: H.svg_sanitize("c"))
SHEETS = ["a { position: fixed; color: red }", "@import url(x.css); p:hover > b, i { background: URL(http://x.com/y.png) }", "@media screen { p { margin: 0 } }", "a { margin: 0 auto }", "", None]
# Rules are written out one declaration to a line; positions are held in the page, and what is no sheet has no result.
_RULES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(c, 'fixed', 'absolute'), '([a-z]+): ([a-z0-9]+);? ?', '\1:\2;' || chr(10), 'g'), '\{ ', '{' || chr(10), 'g'), '\} ?', '}' || chr(10), 'g'), ' +$', '', 'g')"
_NO_SHEET = "(c like '% auto %' or c like '@import url(%')"
BOOK.cases("css_sanitize", SHEETS, {"ok": f"not {_NO_SHEET}", "css": f"case when not {_NO_SHEET} then {_RULES} end"}, ok=lambda: H.css_sanitize("c")["ok"], css=lambda: H.css_sanitize("c")["css"])
_NO_STYLE = r"regexp_matches(c, '\}|; *[a-z]+ *$')"
BOOK.cases("css_sanitize_style", ["position: fixed", "color: red; x", "a: b} c{d: e", "", None], {"ok": f"not {_NO_STYLE}", "css": rf"case when not {_NO_STYLE} then regexp_replace(replace(c, 'fixed', 'absolute'), '([a-z]+): ([a-z]+)', '\1:\2; ', 'g') end"}, ok=lambda: H.css_sanitize_style("c")["ok"], css=lambda: H.css_sanitize_style("c")["css"])
_STYLE = r"regexp_extract(html, '<style>([^<]*)</style>', 1)"
_style = lambda: F.regexp_extract("html", r"<style>([^<]*)</style>", 1)
_script = lambda: F.regexp_extract("html", r"<script>((?s:.*?))</script>", 1)
_page("css_tokens", {"n": "6"}, n=lambda: F.size(H.css_tokens(_style())))
_page("css_minify", {"t": _STYLE}, t=lambda: H.css_minify(_style()))
_page("css_parse", {"css": "'p {' || chr(10) || 'margin:0;' || chr(10) || '}' || chr(10)"}, css=lambda: H.css_sanitize(_style())["css"])
_page("js_minify", {"t": r"regexp_replace(regexp_extract(html, '<script>(.*?)</script>', 1, 's'), ' ?([=;]) ?', '\1', 'g')"}, t=lambda: H.js_minify(_script()))

PCT = "url_encode({0})"
_doc("percent_encode", {"t": PCT.format("text")}, t=lambda: U.percent_encode("text"))
_doc("url_encode", {"t": f"replace({PCT.format('text')}, '~', '%7E')"}, t=lambda: U.url_encode("text"))
_doc("url_decode", {"t": "text"}, t=lambda: U.url_decode(U.url_encode("text")))
_page("url_path_encode", {"t": "replace(replace(replace(replace(replace(replace(url_encode(regexp_replace(url, '/+', '/', 'g')), '%2F', '/'), '%26', '&'), '%3D', '='), '%24', '$'), '%2C', ','), '%3B', ';')"}, t=lambda: U.url_path_encode("url"))
_page("url_chars", {"reserved": "regexp_full_match(substr(url, 5, 1), '[!*''();:@&=+$,/?%#\\[\\]\"]')", "unreserved": "regexp_full_match(left(url, 1), '[A-Za-z0-9_.~-]')", "valid": "true"}, reserved=lambda: U.url_reserved_char(F.substring("url", 5, 1)), unreserved=lambda: U.url_unreserved_char(F.left("url", F.lit(1))), valid=lambda: U.url_valid_char(F.left("url", F.lit(1))))
_doc("hex_encode", {"up": "hex(encode(text))", "low": "lower(hex(encode(text)))"}, up=lambda: U.hex_encode(F.encode("text", "UTF-8")), low=lambda: U.hex_encode_lc(F.encode("text", "UTF-8")))
_doc("hex_decode", {"t": "text", "odd": "null::varchar"}, t=lambda: F.decode(U.hex_decode(U.hex_encode(F.encode("text", "UTF-8"))), "UTF-8"), odd=lambda: F.decode(U.hex_decode(F.lit("ABC")), "UTF-8"))
_page("remove_protocol", {"t": "regexp_replace(url, '^[^:]*:(//)?', '')", "none": "''"}, t=lambda: U.remove_protocol("url"), none=lambda: U.remove_protocol(F.lit("abc")))
SITE = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', ''), '^www\\.', '')"
_page("site_name", {"t": f"nullif({SITE}, '')"}, t=lambda: U.site_name("url"))
PATH = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"
_page("split_base_host", {"host": HOST, "dir": f"{HOST} || '/' || case when len({PATH}) > 1 then array_to_string(({PATH})[1:len({PATH}) - 1], '/') || '/' else '' end"}, host=lambda: U.split_base_host("url")["host"], dir=lambda: U.split_base_host("url")["dir"])
_page("abs_link", {"root": f"{HOST} || '/x/y'", "known": "'mailto:a@b.c'"}, root=lambda: U.abs_link(F.lit("/x/y"), F.col("url")), known=lambda: U.abs_link(F.lit("mailto:a@b.c"), F.col("url")))
_page("is_index_page", {"t": "not contains(regexp_extract(url, '^([^#]*)', 1), '?') and regexp_full_match(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/?|/?index\\..*|/?[dD]efault\\.htm')"}, t=lambda: U.is_index_page("url"))
_doc("encode_data_url", {"plain": "'data:,' || url_encode(text)", "b64": "'data:image/png;base64,' || base64(encode(text))"}, plain=lambda: U.encode_data_url(F.encode("text", "UTF-8")), b64=lambda: U.encode_data_url(F.encode("text", "UTF-8"), "image/png"))
_doc("decode_data_url", {"t": "text", "mime": "'image/png'"}, t=lambda: F.decode(U.decode_data_url(U.encode_data_url(F.encode("text", "UTF-8"), "image/png"))["data"], "UTF-8"), mime=lambda: U.decode_data_url(U.encode_data_url(F.encode("text", "UTF-8"), "image/png"))["mime"])

TITLE = ENTITIES.format("trim(regexp_extract(html, '<title>(.*?)</title>', 1))")
H1 = ENTITIES.format("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1))")
BOOK.add("page_metadata", lambda spark, sf: P.page_metadata(read(spark, sf, "pages")).select("page_id", "title", "h1", "title_element", "language", "site", "url", "summary", "image", "icon", "tags"), f"select page_id, {H1} as title, {H1} as h1, {TITLE} as title_element, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) as language, {SITE} as site, url, null::varchar as summary, null::varchar as image, null::varchar as icon, []::varchar[] as tags from pages")
_page("html_meta", {"keys": "['language', 'charset', 'title', 'h1']"}, keys=lambda: F.transform(M.html_meta("html"), lambda x: x["key"]))
_page("fetch_data", {"mime": "'text/html'", "charset": "'utf-8'", "size": "length(html)::bigint", "filename": "nullif(regexp_extract(url, '^[a-z]+://[^/?#]*/(?:[^/?#]*/)*([^?#]*)', 1), '')"}, mime=lambda: _fetched()["content_type"], charset=lambda: F.get(_fetched()["content_type_options"], F.lit(0))["value"], size=lambda: _fetched()["content_length"], filename=lambda: _fetched()["filename"])
_page("header", {"v": "length(html)::varchar"}, v=lambda: M.header(_fetched(), "content-length"))
BOOK.add("links_by_rel", lambda spark, sf: _link_headers(spark, sf), "select page_id, 'self' as rel, 1 as n, url as href from pages")
BOOK.add("page_links", lambda spark, sf: P.page_links(read(spark, sf, "pages")), rf"select page_id, {ENTITIES.format('href')} as href, {HOST} || {ENTITIES.format('href')} as target from (select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages)")
BOOK.add("site_report", lambda spark, sf: P.site_report(read(spark, sf, "pages")), f"select nullif({SITE}, '') as site, count(*) as n_pages, round(avg(length({STRIPPED})), 3) as mean_text_chars, round(avg(({TITLE} = {H1})::int), 6) as same_heading from pages group by 1")


def _fetched():
    headers = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit('text/html; charset="utf-8"').alias("value")), F.struct(F.lit("Content-Length").alias("name"), F.length("html").cast("string").alias("value")))
    return M.url_metadata("url", "html", headers)


def _link_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.array(F.struct(F.lit("content-type").alias("name"), F.lit("text/html").alias("value")), F.struct(F.lit("Link").alias("name"), F.concat(F.lit("<"), "url", F.lit('>; rel="Self"')).alias("value")))
    found = P.links_by_rel(read(spark, sf_dir, "pages").withColumn("headers", headers), headers_col="headers")
    return found.select("page_id", "rel", F.size("links").alias("n"), F.col("links")[0]["href"].alias("href"))


def _fetched_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a data: address, fetched."""
    pages = read(spark, sf_dir, "pages").select(U.encode_data_url(F.encode("html", "UTF-8"), "text/html").alias("url"))
    out = X.fetch(pages, max_length=None)
    return out.select(F.md5("url").alias("k"), "ok", "status", "length")


BOOK.add("fetch", _fetched_data, "select md5('data:text/html;base64,' || base64(encode(html))) as k, true as ok, 200 as status, octet_length(encode(html))::bigint as length from (select distinct html from pages)")

def _echo(method, url, headers, body, timeout):
    """A server that has moved every page once, and answers with its address over and over, in the range asked for."""
    if method == "head":
        return (200, [], b"") if "moved" in url else (301, [("Location", f"{url}?moved")], b"")
    data = (url * 40).encode()
    first, _, last = dict(headers).get("Range", "bytes=0-")[6:].partition("-")
    part = data[int(first) : int(last or len(data)) + 1]
    return 206, [("Content-Type", "text/plain"), ("Content-Range", f"bytes {first}-{int(first) + len(part) - 1}/{len(data)}")], part


def _page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").where("not contains(url, '?') and not contains(url, '#')").select("url")


_URLS = "(select distinct url from pages where not contains(url, '?') and not contains(url, '#'))"
BOOK.add("fetch_partial", lambda spark, sf: X.fetch(_page_urls(spark, sf), max_length=64, transport=_echo).select("url", "ok", "status", "length", F.decode("data", "UTF-8").alias("data")), f"select url, true as ok, 206 as status, 64::bigint as length, left(repeat(url, 40), 64) as data from {_URLS}")
BOOK.add("location", lambda spark, sf: X.locations(_page_urls(spark, sf), transport=_echo), f"select url, url || '?moved' as location from {_URLS}")


def _fetched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read(spark, sf_dir, "pages").select(U.encode_data_url(F.encode("html", "UTF-8"), "text/html").alias("url"))
    md = F.col("metadata")
    return X.fetch_metadata(urls).select(F.md5("url").alias("k"), "ok", "status", md["content_type"].alias("mime"), M.prop(md, "title").alias("title"), M.prop(md, "h1").alias("h1"))


BOOK.add("fetch_metadata", _fetched_metadata, f"select md5('data:text/html;base64,' || base64(encode(html))) as k, true as ok, 200 as status, 'text/html' as mime, {H1} as title, {H1} as h1 from (select distinct html from pages)")

EMAIL = N.EMAIL.replace("'", "''")
FOUND = rf"list_sort(list_distinct(list_transform(regexp_extract_all(' ' || text || ' ', '[^a-zA-Z0-9.@+\-]({EMAIL})', 1), lambda x: lower(x))))"
_doc("extract_emails", {"found": FOUND}, found=lambda: N.extract_emails("text"))
BOOK.add("emails", lambda spark, sf: P.emails(read(spark, sf, "documents"), "doc_id").withColumn("valid", N.is_email("email")), f"select doc_id, email, regexp_full_match(email, '{EMAIL}') as valid from (select doc_id, unnest({FOUND}) as email from documents)")
_page("is_email", {"no": f"regexp_full_match(url, '{EMAIL}')", "yes": "true"}, no=lambda: N.is_email("url"), yes=lambda: N.is_email(F.concat(F.lit("plop.blaat-hallo@x"), F.col("page_id").cast("string"), F.lit(".com"))))

_IP = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}"


def _ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in documents, and one made from each event."""
    found = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(rf"({_IP})"), F.lit(1))).alias("ip"))
    made = read(spark, sf_dir, "events").select(F.concat_ws(".", *((F.col("event_id") * k % m).cast("string") for k, m in ((7, 256), (13, 256), (29, 256), (3, 256)))).alias("ip"))
    return found.union(made).distinct()


IPS = rf"(select distinct ip from (select unnest(regexp_extract_all(text, '{_IP}')) as ip from documents union all select (event_id * 7 % 256) || '.' || (event_id * 13 % 256) || '.' || (event_id * 29 % 256) || '.' || (event_id * 3 % 256) from events))"
_part = lambda i: f"split_part(ip, '.', {i})::bigint"
LONG = f"({_part(1)} * 16777216 + {_part(2)} * 65536 + {_part(3)} * 256 + {_part(4)})"
LOCAL = f"({_part(1)} in (127, 10) or ip like '192.168.%' or ip like '169.254.%' or {_part(1)} = 172 and {_part(2)} between 16 and 31 or {_part(1)} = 100 and {_part(2)} = 64 and {_part(3)} < 4)"
BOOK.add("ip_to_long", lambda spark, sf: _ips(spark, sf).select("ip", N.ip_to_long("ip").alias("n")), f"select ip, {LONG} as n from {IPS}")
BOOK.add("long_to_ip", lambda spark, sf: _ips(spark, sf).select(N.ip_to_long("ip").alias("n"), N.long_to_ip(N.ip_to_long("ip")).alias("back")), f"select {LONG} as n, ip as back from {IPS}")
BOOK.add("ip_to_text", lambda spark, sf: _ips(spark, sf).select("ip", N.ip_to_text("ip").alias("t"), F.hex(N.ip_to_bytes("ip")).alias("b")), f"select ip, ip as t, upper(lpad(to_hex({LONG}), 8, '0')) as b from {IPS}")
BOOK.add("is_local", lambda spark, sf: _ips(spark, sf).select("ip", N.is_local("ip").alias("local"), N.is_local_v4("ip").alias("v4")), f"select ip, {LOCAL} as local, {LOCAL} as v4 from {IPS}")
BOOK.add("is_local_name", lambda spark, sf: N.is_local_name(_ips(spark, sf).select(F.concat(F.lit("h"), "ip").alias("name")), _ips(spark, sf).select(F.concat(F.lit("h"), "ip").alias("name"), "ip")), f"select 'h' || ip as name, {LOCAL} as is_local from {IPS}")
BOOK.add("ip_match", lambda spark, sf: _ips(spark, sf).select("ip", N.ip_match("ip", "10.0.0.0/8, 7.13.29.3, fe80::/10, 128.0.0.0/3").alias("listed"), N.ip_match("ip", "local, none").alias("local"), N.ip_match("ip", "any").alias("any_")), f"select ip, ip like '10.%' or ip = '7.13.29.3' or {_part(1)} between 128 and 159 as listed, {LOCAL} as local, true as any_ from {IPS}")
BOOK.add("reverse_ip", lambda spark, sf: _ips(spark, sf).select("ip", N.reverse_ip("ip").alias("name")), f"select ip, split_part(ip, '.', 4) || '.' || split_part(ip, '.', 3) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 1) || '.' as name from {IPS}")


def _block_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd addresses are on a block list, those divisible by 5 on an allow list, those by 3 have an answer that does not count."""
    ips = _ips(spark, sf_dir)
    n = N.ip_to_long("ip")
    answer = lambda on, lists, text: ips.where(on).select("ip", F.lit(lists).alias("list"), F.lit(text).alias("answer"))
    answers = answer(n % 2 == 1, N.BLOCK_LISTS[0], "127.0.0.4").union(answer(n % 5 == 0, N.ALLOW_LISTS[0], "127.0.2.1")).union(answer(n % 3 == 0, N.BLOCK_LISTS[1], "127.0.0.255"))
    return N.block_status(ips, answers)


BOOK.add("block_status", _block_status, f"select ip, case when {LONG} % 5 = 0 then 'allowed' when {LONG} % 2 = 1 then 'blocked' else 'notlisted' end as status, case when {LONG} % 5 <> 0 and {LONG} % 2 = 1 then ['{N.BLOCK_LISTS[0]}'] end as lists from {IPS}")
BOOK.add("is_blocked", lambda spark, sf: _block_status(spark, sf).select("ip", (F.col("status") == "blocked").alias("blocked")), f"select ip, {LONG} % 5 <> 0 and {LONG} % 2 = 1 as blocked from {IPS}")
_doc("os_escape", {"t": r"regexp_replace(text, '([^A-Za-z0-9_.+/\-])', '\\\1', 'g')"}, t=lambda: N.os_escape("text"))
BOOK.columns("os_filename", "part", "p_partkey", {"t": "'''' || p_name || ''''"}, t=lambda: N.os_filename("p_name"))

_term = lambda: F.to_json(F.array("event_id", "user_id", F.lit(None).cast("bigint")), {"ignoreNullFields": "false"})
BOOK.columns("ubf_encode", "events", "event_id", {"t": "'#''undefined''&' || user_id || '&' || event_id || '&$'"}, t=lambda: F.decode(B.ubf_encode(_term()), "UTF-8"))
BOOK.columns("ubf_decode", "events", "event_id", {"ok": "true", "json": "'[' || event_id || ', ' || user_id || ', null]'"}, ok=lambda: B.ubf_decode(B.ubf_encode(_term()))["ok"], json=lambda: B.ubf_decode(B.ubf_encode(_term()))["json"])
_doc("ubf_texts", {"json": "'[\"' || replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"]'"}, json=lambda: B.ubf_decode(B.ubf_encode(F.to_json(F.array("text"))))["json"])
