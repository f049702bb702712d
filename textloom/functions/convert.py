"""Conversions.  Text that does not convert gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import ColumnOrName, _c, float_digits, to_lower, trim


def clean_lower(c: ColumnOrName) -> Column:
    return trim(to_lower(c))


def to_text(c: ColumnOrName, kind: str = "string") -> Column:
    """kind: the column's type; timestamps as `Y-m-d H:i:s`, doubles with the fewest digits, null as empty."""
    if kind in ("double", "float"):
        return F.coalesce(float_digits(_c(c).cast("double")), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def to_flatlist(c: ColumnOrName) -> Column:
    """An array of arrays of text as one text."""
    return F.array_join(F.flatten(_c(c)), "")


def translated(c: ColumnOrName, lang: str = "en") -> Column:
    """Of array<struct<lang, text>> the text in lang, else the first one."""
    found = F.get(F.filter(_c(c), lambda x: x["lang"] == lang), F.lit(0))
    return F.coalesce(found["text"], F.get(_c(c), F.lit(0))["text"])


def to_atom(c: ColumnOrName) -> Column:
    return F.nullif(_c(c), F.lit(""))


def to_integer(c: ColumnOrName) -> Column:
    return F.when(_c(c).rlike(r"\A[+-]?[0-9]+\z"), _c(c).try_cast("bigint"))


def round_integer(c: ColumnOrName) -> Column:
    """A number rounded, halves away from zero."""
    return F.round(_c(c)).cast("bigint")


def to_float(c: ColumnOrName) -> Column:
    """Digits with or without a fraction; an exponent only after a fraction."""
    return F.when(_c(c).rlike(r"\A[+-]?[0-9]+(\.[0-9]+([eE][+-]?[0-9]+)?)?\z"), _c(c).try_cast("double"))


def to_bool(c: ColumnOrName) -> Column:
    """False for null, empty, 0 and the usual words for no; true for all else."""
    return ~F.coalesce(_c(c), F.lit("")).isin("", "0", "\x00", "false", "FALSE", "n", "N", "no", "NO", "disabled", "DISABLED")


def to_bool_strict(c: ColumnOrName) -> Column:
    """False for null, empty, and 0 only; "false" is true."""
    return ~F.coalesce(_c(c), F.lit("")).isin("", "0", "\x00")


def number_to_bool(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c) != 0, F.lit(False))


def timestamp_to_bool(c: ColumnOrName) -> Column:
    """False for null and for the year 9999, which stands for no end."""
    return F.coalesce(F.year(_c(c)) != 9999, F.lit(False))


def to_utc(c: ColumnOrName, zone: str) -> Column:
    return F.when(F.year(_c(c)) == 9999, F.lit("9999-08-17 12:00:00").cast("timestamp")).otherwise(F.to_utc_timestamp(_c(c), zone))


def to_localtime(c: ColumnOrName, zone: str) -> Column:
    return F.when(F.year(_c(c)) == 9999, F.lit("9999-08-17 12:00:00").cast("timestamp")).otherwise(F.from_utc_timestamp(_c(c), zone))


_STAMP = r"\A([0-9]{1,4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]+)?)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def to_datetime(c: ColumnOrName) -> Column:
    """Date and optional time with optional offset, as UTC; fractions of a second are dropped."""
    part = lambda i: F.regexp_extract(_c(c), _STAMP, i)
    pad = lambda i, n: F.lpad(F.when(part(i) == "", "0").otherwise(part(i)), n, "0")
    text = F.concat(pad(1, 4), F.lit("-"), pad(2, 2), F.lit("-"), pad(3, 2), F.lit(" "), pad(4, 2), F.lit(":"), pad(5, 2), F.lit(":"), pad(6, 2))
    local = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    zone = F.regexp_replace(part(7), "Z|:", "")
    minutes = F.when(zone == "", 0).otherwise(F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)
    return F.when(_c(c).rlike(_STAMP), F.timestamp_seconds(F.unix_timestamp(local) - minutes * 60))


def to_date(c: ColumnOrName) -> Column:
    """Y-M-D or Y/M/D, or D-M-Y if the last part has four digits."""
    text = F.replace(_c(c), F.lit("/"), F.lit("-"))
    year_last = text.rlike(r"\A[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}\z")
    year_first = text.rlike(r"\A[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\z")
    part = lambda i, n: F.lpad(F.split_part(text, F.lit("-"), F.lit(i)), n, "0")
    iso = F.when(year_last, F.concat(part(3, 4), F.lit("-"), part(2, 2), F.lit("-"), part(1, 2))).when(year_first, F.concat(part(1, 4), F.lit("-"), part(2, 2), F.lit("-"), part(3, 2)))
    return iso.try_cast("date")


def to_time(c: ColumnOrName) -> Column:
    """struct<h, i, s>: H:M[:S] (or with dots), or HHMM."""
    text = F.replace(_c(c), F.lit("."), F.lit(":"))
    shape = r"\A([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?\z"
    short = r"\A([0-9]{2})([0-9]{2})\z"
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    make = lambda h, i, s: F.struct(h.alias("h"), i.alias("i"), s.alias("s"))
    return F.when(text.rlike(shape), make(part(shape, 1), part(shape, 2), F.coalesce(part(shape, 3), F.lit(0)))).when(text.rlike(short), make(part(short, 1), part(short, 2), F.lit(0)))


def to_isotime(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parts_to_isotime(c: ColumnOrName) -> Column:
    """The same of struct<y, m, d, h, i, s>, which also holds years before 1 and after 9999."""
    p = lambda n: F.lpad(_c(c)[n].cast("string"), 2, "0")
    y = _c(c)["y"]
    digits = F.abs(y).cast("string")
    year = F.concat(F.when(y < 0, "-").otherwise(""), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    return F.concat(year, F.lit("-"), p("m"), F.lit("-"), p("d"), F.lit("T"), p("h"), F.lit(":"), p("i"), F.lit(":"), p("s"), F.lit("Z"))


def to_json(*cs: ColumnOrName) -> Column:
    return F.to_json(F.struct(*cs), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss+00:00"})


def convert_json(c: ColumnOrName) -> Column:
    """JSON text as a variant."""
    return F.try_parse_json(_c(c))


def unicode_to_utf8(c: ColumnOrName) -> Column:
    return F.encode(_c(c), "UTF-8")
