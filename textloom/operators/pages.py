"""Whole-table operators on web pages and on what is found in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import metadata as M
from ..functions import net as N
from ..functions import urls as U


def page_metadata(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", headers_col: str | None = None) -> DataFrame:
    """(id, title, h1, language, site, url, summary, image, icon, tags): one parse of each page, all fields from it.

    Null pages have null fields and no tags.
    """
    md = F.col("_md")
    own = pages.select(id_col, M.url_metadata(url_col, html_col, headers_col).alias("_md"))
    return own.select(
        id_col,
        M.page_title(md).alias("title"),
        M.prop(md, "h1").alias("h1"),
        M.prop(md, "title").alias("title_element"),
        M.prop(md, "language").alias("language"),
        M.page_site(md).alias("site"),
        M.page_url(md).alias("url"),
        M.page_summary(md).alias("summary"),
        M.page_image(md).alias("image"),
        M.page_icon(md).alias("icon"),
        M.page_tags(md).alias("tags"),
    )


def exploded(df: DataFrame, id_col: str, values: str, place: str = "seq") -> DataFrame:
    """A row for each struct of an array column, with its place from 0."""
    return df.select(id_col, F.posexplode(values).alias(place, "_x")).select(id_col, place, "_x.*")


def page_tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, seq, kind, name, attrs, data, is_ws, singleton): all tokens of all pages."""
    return exploded(pages.select(id_col, H.html_tokens(F.col(html_col)).alias("_t")), id_col, "_t")


def page_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, node_id, parent_id, depth, tag, attrs, text): all trees in pre-order."""
    return pages.select(id_col, F.explode(H.html_nodes(F.col(html_col))).alias("_n")).select(id_col, "_n.*")


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, href, target): the addresses that a page's a elements name, and where they lead from the page."""
    nodes = pages.select(id_col, url_col, F.explode(H.html_nodes(F.col(html_col))).alias("_n")).where(F.col("_n.tag") == "a")
    href = F.get(F.filter(F.col("_n.attrs"), lambda a: a["k"] == "href"), F.lit(0))["v"]
    links = nodes.select(id_col, url_col, href.alias("href")).where("href is not null")
    return links.select(id_col, "href", U.abs_link(F.col("href"), F.col(url_col)).alias("target"))


def links_by_rel(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", headers_col: str | None = None) -> DataFrame:
    """(id, rel, links): link elements and Link headers, grouped by rel in their order."""
    own = pages.select(id_col, M.url_metadata(url_col, html_col, headers_col)["links"].alias("_l"))
    return own.select(id_col, F.explode("_l").alias("rel", "links"))


def emails(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, email): the distinct addresses of each text."""
    return texts.select(id_col, F.explode(N.extract_emails(text_col)).alias("email"))


def site_report(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, n_pages, mean_text_chars, same_heading): for each site how many pages it has, how long their texts are, and the share whose title is their first heading."""
    own = pages.select(M.url_metadata(url_col, html_col).alias("md"), F.length(H.strip(html_col)).alias("chars"))
    one = own.select(M.page_site("md").alias("site"), "chars", (M.prop("md", "title") == M.prop("md", "h1")).cast("int").alias("same"))
    return one.groupBy("site").agg(F.count("*").alias("n_pages"), F.round(F.avg("chars"), 3).alias("mean_text_chars"), F.round(F.avg(F.coalesce("same", F.lit(0))), 6).alias("same_heading"))
