"""SQL names for the functions: pandas functions, table functions, and SQL functions that need no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import html, metadata, net, serial, strings, tables, urls

#: Functions of Python kernels by their SQL names.
KERNELS = {
    "abs_link": urls.abs_link,
    "abs_links": html.abs_links,
    "casefold": strings._casefold,
    "charref": html.charref,
    "css_minify": html.css_minify,
    "css_sanitize": html.css_sanitize,
    "css_sanitize_style": html.css_sanitize_style,
    "decode_data_url": urls.decode_data_url,
    "ensure_escaped_amp": html.ensure_escaped_amp,
    "escape_ical": strings.escape_ical,
    "escape_link": html.escape_link,
    "float_digits": strings.float_digits,
    "html_roundtrip": html._roundtrip,
    "html_to_map": html.html_to_map,
    "html_tree": html._tree,
    "ip_to_bytes": net.ip_to_bytes,
    "js_minify": html.js_minify,
    "normalize_text": strings.normalize,
    "os_filename": net.os_filename,
    "sanitize_uri": html.sanitize_uri,
    "sanitize_utf8": strings._sanitize_utf8,
    "svg_sanitize": html.svg_sanitize,
    "ubf_decode": serial.ubf_decode,
    "unaccent": strings._unaccent,
    "unescape_html": html.unescape,
    "url_metadata": metadata._metadata,
}


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Functions that are SQL themselves: parameters, result, body.
EXPRESSIONS = {
    "trim_space": ("c STRING", "STRING", rf"regexp_replace(c, r'\A{strings.SPACE}+|{strings.SPACE}+\z', '')"),
    "nospaces": ("c STRING", "STRING", r"regexp_replace(c, r'[\x00-\x20]', '')"),
    "one_line": ("c STRING", "STRING", r"regexp_replace(c, r'[\x00-\x1F]', ' ')"),
    "nl2br": ("c STRING", "STRING", r"regexp_replace(c, r'\r\n|\r|\n', '<br />')"),
    "escape_html": ("c STRING", "STRING", """replace(replace(replace(replace(replace(replace(c, '&euro;', '€'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&#39;')"""),
    "percent_encode": ("c STRING", "STRING", "replace(replace(replace(url_encode(c), '+', '%20'), '*', '%2A'), '%7E', '~')"),
    "is_email": ("c STRING", "BOOLEAN", f"c rlike {literal(net.EMAIL_WHOLE)}"),
    "long_to_ip": ("n BIGINT", "STRING", "concat_ws('.', cast(shiftrightunsigned(n, 24) & 255 as string), cast(shiftrightunsigned(n, 16) & 255 as string), cast(shiftrightunsigned(n, 8) & 255 as string), cast(n & 255 as string))"),
}


def register(spark: SparkSession) -> None:
    """All names for this session."""
    for name, function in KERNELS.items():
        spark.udf.register(name, function)
    tables.register_tables(spark)
    for name, (parameters, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
