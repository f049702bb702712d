"""String functions.  Null gives null unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core import text as K
from .udf import kernel

ColumnOrName = Column | str
SPACE = r"[\x00-\x20\x85\xA0\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: ColumnOrName, char: str | None = None) -> Column:
    """Without white space, or all of one character, at both ends."""
    return F.btrim(_c(c), F.lit(K.SPACES if char is None else char))


def trim_left(c: ColumnOrName, char: str | None = None) -> Column:
    return F.ltrim(_c(c), F.lit(K.SPACES if char is None else char))


def trim_right(c: ColumnOrName, char: str | None = None) -> Column:
    return F.rtrim(_c(c), F.lit(K.SPACES if char is None else char))


def trim_left_class(c: ColumnOrName, char_class: str) -> Column:
    """Without leading characters of a regular-expression class: the predicate form of trim_left."""
    return F.regexp_replace(_c(c), f"\\A{char_class}+", "")


def is_string(c: ColumnOrName) -> Column:
    """Printable: valid UTF-8 without control characters other than tab, newline, form feed and return."""
    return F.is_valid_utf8(_c(c)) & ~_c(c).rlike(r"[\x00-\x08\x0B\x0E-\x1F]")


def is_whitespace(c: ColumnOrName) -> Column:
    return _c(c).rlike(f"\\A{SPACE}\\z")


def first_char(c: ColumnOrName) -> Column:
    """Code point of the first character; empty: null."""
    return F.when(_c(c) != "", F.ascii(_c(c)))


def last_char(c: ColumnOrName) -> Column:
    return F.when(_c(c) != "", F.ascii(F.right(_c(c), F.lit(1))))


def unquote(c: ColumnOrName, quote: str = '"') -> Column:
    """Without the first and last quote if both are there."""
    quoted = (F.length(_c(c)) >= 2) & F.startswith(_c(c), F.lit(quote)) & F.endswith(_c(c), F.lit(quote))
    return F.when(quoted, F.substr(_c(c), F.lit(2), F.length(_c(c)) - 2)).otherwise(_c(c))


def nospaces(c: ColumnOrName) -> Column:
    return F.regexp_replace(_c(c), r"[\x00-\x20]", "")


def line(c: ColumnOrName) -> Column:
    """Every control character becomes a space."""
    return F.regexp_replace(_c(c), r"[\x00-\x1F]", " ")


def len_(c: ColumnOrName) -> Column:
    """Code points; null: 0."""
    return F.coalesce(F.length(_c(c)), F.lit(0))


def to_upper(c: ColumnOrName) -> Column:
    """Null: empty."""
    return F.upper(F.coalesce(_c(c), F.lit("")))


_casefold = kernel(K.casefold)
#: Characters whose case folding is their lower case, but for the sharp s: ASCII, Latin-1 without the micro sign, punctuation.
_FOLDS_AS_LOWER = r"^[\x00-\x7F\x{80}-\x{B4}\x{B6}-\x{FF}\x{2010}-\x{2027}\x{20AC}]*$"


def to_lower(c: ColumnOrName) -> Column:
    """Full case folding; null: empty.  Only texts with letters beyond Latin-1 go to Python."""
    text = F.coalesce(_c(c), F.lit(""))
    plain = text.rlike(_FOLDS_AS_LOWER)
    return F.when(plain, to_lower_latin(text)).otherwise(_casefold(F.when(~plain, text)))


def to_lower_latin(c: ColumnOrName) -> Column:
    """to_lower for Latin text, without Python."""
    return F.replace(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("ß"), F.lit("ss"))


normalize = kernel(K.normalize)
_unaccent = kernel(K.unaccent)
_sanitize_utf8 = kernel(K.sanitize_utf8)
escape_ical = kernel(K.escape_ical)


def unaccent(c: ColumnOrName) -> Column:
    """Text without combining marks (letters with strokes stay); only texts beyond ASCII go to Python."""
    ascii_ = _c(c).rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, _c(c)).otherwise(_unaccent(F.when(~ascii_, _c(c))))


def sanitize_utf8(c: ColumnOrName) -> Column:
    """Text or bytes without NUL, U+FFFE, U+FFFF and whatever is no valid UTF-8; only what is not valid goes to Python."""
    text = _c(c).cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, F.translate(text, "\x00\ufffe\uffff", "")).otherwise(_sanitize_utf8(F.when(~valid, _c(c))))


def to_name(c: ColumnOrName) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(normalize(_c(c)), F.lit("@"), F.lit("_at_")), "[^a-z0-9]", "_"), "_+", "_")
    bare = F.btrim(bare, F.lit("_"))
    return F.when(bare == "", "_").otherwise(bare)


def to_slug(c: ColumnOrName) -> Column:
    return F.translate(to_name(c), "_", "-")


def to_rootname(c: ColumnOrName) -> Column:
    """The slug of a file's name without folder and last extension."""
    base = F.regexp_extract(_c(c), r"([^/]*)/*\z", 1)
    return to_slug(F.regexp_replace(base, r"\.[^.]*\z", ""))


def replace(c: ColumnOrName, old: str, new: str) -> Column:
    return F.replace(_c(c), F.lit(old), F.lit(new))


def truncate(c: ColumnOrName, n: int, append: str = "…") -> Column:
    return kernel(K.truncate, n=n, append=append)(_c(c))


def truncatechars(c: ColumnOrName, n: int, append: str = "") -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n), F.lit(append))).otherwise(_c(c))


def truncatewords(c: ColumnOrName, n: int, append: str = "…") -> Column:
    """n words, each with the separator behind it, then append."""
    gap, word = r"[ \n\r\t,:;]", r"[^ \n\r\t,:;]"
    head = F.regexp_extract(_c(c), rf"\A((?:{gap}*{word}+{gap}){{{n}}})", 1)
    return F.when(head != "", F.regexp_replace(F.concat(head, F.lit(append)), rf"\A{gap}+", "")).otherwise(_c(c))


def split_lines(c: ColumnOrName) -> Column:
    return F.split(_c(c), "\r\n|\r|\n", -1)


def starts_with(needle: str, c: ColumnOrName) -> Column:
    return F.startswith(_c(c), F.lit(needle))


def ends_with(needle: str, c: ColumnOrName) -> Column:
    return F.endswith(_c(c), F.lit(needle))


def contains(needle: str, c: ColumnOrName) -> Column:
    return F.contains(_c(c), F.lit(needle))


def split(c: ColumnOrName, separator: str) -> Column:
    """By a literal separator; an empty one gives single characters."""
    return F.split(_c(c), re.escape(separator) if separator else "(?!\\A)(?!\\z)", -1)


def concat(*cs: ColumnOrName) -> Column:
    """Null: empty."""
    return F.concat(*(F.coalesce(_c(c), F.lit("")) for c in cs))


def distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.levenshtein(_c(a), _c(b))


float_digits = kernel(K.float_digits)


def frexp(c: ColumnOrName) -> Column:
    """struct<mantissa, exponent>: mantissa from 0.5 to below 1 (0, infinite and NaN as they are, with exponent 0)."""
    x = _c(c).cast("double")
    plain = (x != 0) & ~F.isnan(x) & (F.abs(x) != float("inf"))
    near = F.floor(F.log2(F.when(plain, F.abs(x))))
    # Powers of two in two steps, since one alone can be out of range; the logarithm can be off by one.
    scaled = lambda e: x / F.pow(F.lit(2.0), F.floor(e / 2)) / F.pow(F.lit(2.0), e - F.floor(e / 2))
    exponent = near + F.when(F.abs(scaled(near)) >= 1, 1).when(F.abs(scaled(near)) < 0.5, -1).otherwise(0)
    exponent = F.when(plain, exponent).otherwise(0).cast("bigint")
    return F.when(x.isNotNull(), F.struct(F.when(plain, scaled(exponent)).otherwise(x).alias("mantissa"), exponent.alias("exponent")))


def int_pow(base: ColumnOrName, n: int) -> Column:
    return F.pow(_c(base), F.lit(n)).cast("bigint")


def int_ceil(c: ColumnOrName) -> Column:
    return F.ceil(_c(c)).cast("bigint")
