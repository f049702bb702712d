"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import url as K
from .strings import ColumnOrName, _c
from .udf import BOOL, TEXT, kernel, kernel2, struct


def percent_encode(c: ColumnOrName) -> Column:
    """All but letters, digits and -_.~ as %XX."""
    out = F.url_encode(_c(c))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_encode(c: ColumnOrName) -> Column:
    """As percent_encode, the tilde encoded too."""
    return F.replace(percent_encode(c), F.lit("~"), F.lit("%7E"))


def url_decode(c: ColumnOrName) -> Column:
    """Form decoding, a plus is a space; bad escapes give null."""
    return F.try_url_decode(_c(c))


def url_path_encode(c: ColumnOrName) -> Column:
    out = percent_encode(F.regexp_replace(_c(c), "/+", "/"))
    for code, char in (("%2F", "/"), ("%26", "&"), ("%3D", "="), ("%24", "$"), ("%2C", ","), ("%3B", ";")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_unreserved_char(c: ColumnOrName) -> Column:
    return _c(c).rlike(r"\A[A-Za-z0-9_.~-]\z")


def url_reserved_char(c: ColumnOrName) -> Column:
    return _c(c).rlike(r"""\A[!*'();:@&=+$,/?%#\[\]"]\z""")


def url_valid_char(c: ColumnOrName) -> Column:
    return url_reserved_char(c) | url_unreserved_char(c)


def hex_encode(c: ColumnOrName) -> Column:
    return F.hex(_c(c))


def hex_encode_lc(c: ColumnOrName) -> Column:
    return F.lower(F.hex(_c(c)))


def hex_decode(c: ColumnOrName) -> Column:
    """Bytes; an odd number of digits, or other characters, give null."""
    return F.when(F.length(_c(c)) % 2 == 0, F.unhex(_c(c)))


def remove_protocol(c: ColumnOrName) -> Column:
    """What follows the first :// or colon; without one: empty."""
    return F.when(F.contains(_c(c), F.lit(":")), F.regexp_replace(_c(c), r"\A[^:]*:(//)?", "")).otherwise(F.when(_c(c).isNotNull(), ""))


_PARTS = r"\A(?:([^:/?#]+):)?(?://(?:[^/?#@]*@)?([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?\z"


def url_part(c: ColumnOrName, part: str) -> Column:
    """scheme, authority (host and port), path or query; empty if missing."""
    return F.regexp_extract(_c(c), _PARTS, ("scheme", "authority", "path", "query").index(part) + 1)


def split_base_host(c: ColumnOrName) -> Column:
    """struct<host, dir>: scheme://host[:port], and that with the path's folders; the last segment goes."""
    authority, scheme = url_part(c, "authority"), url_part(c, "scheme")
    host = F.concat(F.when(scheme == "", "http").otherwise(scheme), F.lit("://"), authority)
    path = F.filter(F.split(url_part(c, "path"), "/", -1), lambda x: x != "")
    folders = F.when(F.size(path) > 1, F.concat(F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), "/"), F.lit("/"))).otherwise("")
    whole = F.struct(host.alias("host"), F.concat(host, F.lit("/"), folders).alias("dir"))
    return F.when(authority != "", whole).otherwise(F.struct(F.lit("").alias("host"), _c(c).alias("dir")))


def site_name(c: ColumnOrName) -> Column:
    """The host without port and www.; none: null."""
    host = F.regexp_replace(F.regexp_replace(url_part(c, "authority"), r":[0-9]*\z", ""), r"\Awww\.", "")
    return F.nullif(host, F.lit(""))


def is_index_page(c: ColumnOrName) -> Column:
    """A site's front page: no query, and no path or an index file at the top."""
    plain = ~_c(c).rlike(r"\A[^#]*\?")
    return plain & url_part(c, "path").rlike(r"\A(/?|/?index\.(?s:.*)|/?[dD]efault\.htm)\z")


abs_link = kernel2(K.abs_link)

DATA_URL = struct(ok=BOOL, mime=TEXT, charset=TEXT, data=T.BinaryType(), error=TEXT)
decode_data_url = kernel(K.decode_data_url, DATA_URL)


def encode_data_url(data: ColumnOrName, mime: str = "text/plain", charset: str = "") -> Column:
    """data (bytes) as a data URL: percent-encoded for plain text without charset, else base64."""
    if mime == "text/plain" and not charset:
        return F.concat(F.lit("data:,"), percent_encode(F.decode(_c(data), "UTF-8")))
    head = f"data:{mime};charset={charset};base64," if charset else f"data:{mime};base64,"
    return F.concat(F.lit(head), F.replace(F.base64(_c(data)), F.lit("\r\n"), F.lit("")))
