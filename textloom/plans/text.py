"""Queries of the string, conversion, date and number functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import convert as C
from ..functions import dates as D
from ..functions import strings as S
from .base import Book

BOOK = Book()
WS = r"[\x00-\x20\x{85}\x{A0}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PADDED = "chr(8203) || chr(9) || text || chr(12288) || chr(10)"


def _padded():
    return F.concat(F.lit("​\t"), F.col("text"), F.lit("　\n"))


def _doc(name, sql, **made):
    BOOK.columns(name, "documents", "doc_id", sql, **made)


def _part(name, sql, **made):
    BOOK.columns(name, "part", "p_partkey", sql, **made)


_doc("trim", {"t": f"regexp_replace({PADDED}, '^{WS}+|{WS}+$', '', 'g')"}, t=lambda: S.trim(_padded()))
_doc("trim_left", {"t": f"regexp_replace({PADDED}, '^{WS}+', '')", "x": "ltrim(source, 'sweb')"}, t=lambda: S.trim_left(_padded()), x=lambda: F.ltrim("source", F.lit("sweb")))
_doc("trim_right", {"t": f"regexp_replace({PADDED}, '{WS}+$', '')"}, t=lambda: S.trim_right(_padded()))
_part("trim_char", {"t": "trim('..' || p_name || '.', '.')", "l": "ltrim('..' || p_name, '.')", "r": "rtrim(p_name || '..', '.')"}, t=lambda: S.trim(F.concat(F.lit(".."), "p_name", F.lit(".")), "."), l=lambda: S.trim_left(F.concat(F.lit(".."), "p_name"), "."), r=lambda: S.trim_right(F.concat("p_name", F.lit("..")), "."))
_part("trim_left_class", {"t": "regexp_replace(p_name, '^[a-m]+', '')"}, t=lambda: S.trim_left_class("p_name", "[a-m]"))
_doc("is_string", {"yes": r"not regexp_matches(text, '[\x00-\x08\x0B\x0E-\x1F]')", "no": "case when text is not null then false end"}, yes=lambda: S.is_string("text"), no=lambda: S.is_string(F.concat("text", F.lit("\x0b"))))
_doc("is_whitespace", {"first": f"regexp_full_match(left(text, 1), '{WS}')", "space": "true"}, first=lambda: S.is_whitespace(F.left("text", F.lit(1))), space=lambda: S.is_whitespace(F.lit(" ")))
_doc("first_char", {"c": "case when text <> '' then unicode(text) end"}, c=lambda: S.first_char("text"))
_doc("last_char", {"c": "case when text <> '' then unicode(right(text, 1)) end"}, c=lambda: S.last_char("text"))
_doc("unquote", {"both": "text", "one": "'\"' || text"}, both=lambda: S.unquote(F.concat(F.lit('"'), "text", F.lit('"'))), one=lambda: S.unquote(F.concat(F.lit('"'), F.rtrim("text", F.lit('"')))))
BOOK.sql["unquote"] = "select doc_id, text as both, '\"' || rtrim(text, '\"') as one from documents"
_doc("nospaces", {"t": r"regexp_replace(text, '[\x00-\x20]', '', 'g')"}, t=lambda: S.nospaces("text"))
_doc("line", {"t": r"regexp_replace(text, '[\x00-\x1F]', ' ', 'g')"}, t=lambda: S.line("text"))
_doc("len", {"n": "coalesce(length(text), 0)::int"}, n=lambda: S.len_("text"))
_doc("to_lower", {"t": "replace(lower(coalesce(text, '')), 'ß', 'ss')", "native": "replace(lower(coalesce(text, '')), 'ß', 'ss')"}, t=lambda: S.to_lower("text"), native=lambda: S.to_lower_latin("text"))
_doc("to_upper", {"t": "upper(replace(coalesce(text, ''), 'ß', 'SS'))"}, t=lambda: S.to_upper("text"))
_doc("unaccent", {"t": "strip_accents(text)"}, t=lambda: S.unaccent("text"))
_doc("normalize", {"t": "strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss'))"}, t=lambda: S.normalize("text"))
NAME = "case when {0} = '' then '_' else {0} end"
SLUG = "trim(regexp_replace(regexp_replace(replace(strip_accents(replace(lower(coalesce({0}, '')), 'ß', 'ss')), '@', '_at_'), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_')"
_doc("to_name", {"t": NAME.format(SLUG.format("text"))}, t=lambda: S.to_name("text"))
_doc("to_slug", {"t": f"replace({NAME.format(SLUG.format('text'))}, '_', '-')"}, t=lambda: S.to_slug("text"))
_part("to_rootname", {"t": f"replace({NAME.format(SLUG.format('p_name'))}, '_', '-')"}, t=lambda: S.to_rootname(F.concat(F.lit("/a/b.c/"), "p_name", F.lit(".tar"))))
_doc("replace", {"t": "replace(text, 'en', '--')"}, t=lambda: S.replace("text", "en", "--"))
_doc("sanitize_utf8", {"t": "replace(text, chr(65534), '')"}, t=lambda: S.sanitize_utf8("text"))
_doc("truncate", None, t=lambda: S.truncate("text", 60))
_doc("truncatechars", {"t": "case when length(text) > 40 then left(text, 40) || '..' else text end"}, t=lambda: S.truncatechars("text", 40, ".."))
HEAD = r"regexp_extract(text, '^((?:[ \n\r\t,:;]*[^ \n\r\t,:;]+[ \n\r\t,:;]){7})', 1)"
_doc("truncatewords", {"t": rf"case when {HEAD} <> '' then regexp_replace({HEAD} || '…', '^[ \n\r\t,:;]+', '') else text end"}, t=lambda: S.truncatewords("text", 7))
_doc("split_lines", {"t": r"regexp_split_to_array(text, '\r\n|\r|\n')"}, t=lambda: S.split_lines("text"))
_doc("escape_ical", None, t=lambda: S.escape_ical("text"))
_doc("starts_with", {"t": "starts_with(text, 'D')"}, t=lambda: S.starts_with("D", "text"))
_doc("ends_with", {"t": "ends_with(text, '.')"}, t=lambda: S.ends_with(".", "text"))
_doc("contains", {"t": "contains(text, 'der')", "none": "contains(text, '')"}, t=lambda: S.contains("der", "text"), none=lambda: S.contains("", "text"))
_doc("split", {"t": "string_split(text, '. ')"}, t=lambda: S.split("text", ". "))
_part("split_chars", {"t": "string_split(p_name, '')"}, t=lambda: S.split("p_name", ""))
_doc("concat", {"t": "coalesce(lang, '') || '/' || coalesce(source, '')"}, t=lambda: S.concat("lang", F.lit("/"), "source"))
_part("distance", {"n": "levenshtein(p_name, p_type)::int"}, n=lambda: S.distance("p_name", "p_type"))

_doc("clean_lower", {"t": f"regexp_replace(replace(lower({PADDED}), 'ß', 'ss'), '^{WS}+|{WS}+$', '', 'g')"}, t=lambda: C.clean_lower(_padded()))
_part("to_text", {"size": "coalesce(p_size::varchar, '')"}, size=lambda: C.to_text("p_size"))
BOOK.columns("datetime_to_text", "orders", "o_orderkey", {"t": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"}, t=lambda: C.to_text("o_orderdate", "timestamp"))
_part("double_to_text", {"t": "p_retailprice::varchar"}, t=lambda: C.to_text("p_retailprice", "double"))
_part("to_flatlist", {"t": "p_name || p_brand || p_type"}, t=lambda: C.to_flatlist(F.array(F.array("p_name", "p_brand"), F.array("p_type"))))
_doc("translated", {"t": "coalesce(case when lang = 'en' then text end, source)"}, t=lambda: C.translated(F.array(F.struct(F.lit("xx").alias("lang"), F.col("source").alias("text")), F.struct("lang", "text"))))
_doc("to_atom", {"t": "nullif(trim(source), '')"}, t=lambda: C.to_atom(F.trim("source")))
NUMBERS = ["12", "-3", "+7", "0042", " 12", "1.5", "2.5e3", "1e5", "", "x", None, "9223372036854775807", "9223372036854775808", "1_0", "-"]
BOOK.cases("to_integer_cases", NUMBERS, {"n": "case when regexp_full_match(c, '[+-]?[0-9]+') then try_cast(c as bigint) end"}, n=lambda: C.to_integer("c"))
BOOK.cases("to_float_cases", NUMBERS, {"x": r"case when regexp_full_match(c, '[+-]?[0-9]+(\.[0-9]+([eE][+-]?[0-9]+)?)?') then try_cast(c as double) end"}, x=lambda: C.to_float("c"))
BOOK.columns("to_integer", "lineitem", "l_orderkey", {"l_linenumber": "l_linenumber", "n": "l_linenumber::bigint", "none": "null::bigint", "rounded": "round(l_discount * 100 + 0.5)::bigint"}, l_linenumber=lambda: F.col("l_linenumber"), n=lambda: C.to_integer(F.col("l_linenumber").cast("string")), none=lambda: C.to_integer(F.concat("l_returnflag", F.lit("1"))), rounded=lambda: C.round_integer(F.col("l_discount") * 100 + 0.5))
BOOK.columns("to_float", "lineitem", "l_orderkey", {"l_linenumber": "l_linenumber", "x": "l_quantity"}, l_linenumber=lambda: F.col("l_linenumber"), x=lambda: C.to_float(F.col("l_quantity").cast("string")))
WORDS = ["yes", "NO", "no", "false", "FALSE", "False", "true", "", "0", "1", "n", "N", "disabled", "DISABLED", "off", None, "\x00"]
FALSE = "coalesce(c, '') in ('', '0', chr(0)"
BOOK.cases("to_bool", WORDS, {"b": f"not ({FALSE}, 'false', 'FALSE', 'n', 'N', 'no', 'NO', 'disabled', 'DISABLED'))", "strict": f"not ({FALSE}))"}, b=lambda: C.to_bool("c"), strict=lambda: C.to_bool_strict("c"))
BOOK.columns("value_to_bool", "lineitem", "l_orderkey", {"l_linenumber": "l_linenumber", "n": "coalesce(l_discount <> 0, false)", "t": "coalesce(year(l_shipdate) <> 9999, false)"}, l_linenumber=lambda: F.col("l_linenumber"), n=lambda: C.number_to_bool("l_discount"), t=lambda: C.timestamp_to_bool("l_shipdate"))
BOOK.columns("to_utc", "orders", "o_orderkey", {"t": "o_orderdate - interval 5 hour - interval 30 minute"}, t=lambda: C.to_utc("o_orderdate", "Asia/Kolkata"))
BOOK.columns("to_localtime", "orders", "o_orderkey", {"t": "o_orderdate + interval 5 hour + interval 30 minute"}, t=lambda: C.to_localtime("o_orderdate", "Asia/Kolkata"))
STAMPS = ["2010-01-01T18:29:39+01:00", "2010-01-01T18:29:39-02:00", "2011-10-06T16:44:00+0200", "2010-12-12", "2010/12/12 01:02", "2010-02-30T00:00:00Z", "2010-01-01T18:29:39.75Z", "x", "", None, "2010-01-01T25:00:00"]
_ZONE = "case when right(c, 1) = 'Z' or not regexp_matches(c, '[+-][0-9]{2}:?[0-9]{2}$') or length(c) < 17 then 0 else (case when regexp_extract(c, '([+-])[0-9]{2}:?[0-9]{2}$', 1) = '-' then -1 else 1 end) * (regexp_extract(c, '([0-9]{2}):?[0-9]{2}$', 1)::int * 60 + right(c, 2)::int) end"
_LOCAL = r"coalesce(try_strptime(regexp_replace(replace(replace(c, '/', '-'), 'T', ' '), '(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$', ''), '%Y-%m-%d %H:%M:%S'), try_strptime(replace(c, '/', '-'), '%Y-%m-%d %H:%M'), try_strptime(replace(c, '/', '-'), '%Y-%m-%d'))"
BOOK.cases("to_datetime_cases", STAMPS, {"t": f"{_LOCAL} - to_minutes(({_ZONE}))"}, t=lambda: C.to_datetime("c"))
BOOK.columns("to_datetime", "orders", "o_orderkey", {"t": "date_trunc('second', o_orderdate) - interval 1 hour"}, t=lambda: C.to_datetime(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+01:00'")))
DAYS = ["2010-12-12", "2010/12/12", "31-1-2020", "1/2/1999", "2010-13-01", "99-1-1", "Fri Jan 1", "", None]
BOOK.cases("to_date", DAYS, {"d": "case when regexp_full_match(c, '[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}') then try_strptime(replace(c, '/', '-'), '%-d-%-m-%Y')::date when regexp_full_match(c, '[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,2}') then try_strptime(lpad(replace(c, '/', '-'), (length(c) + 4 - length(split_part(replace(c, '/', '-'), '-', 1)))::int, '0'), '%Y-%-m-%-d')::date end"}, d=lambda: C.to_date("c"))
TIMES = ["01:23", "1:2:3", "12.34", "1234", "99", "", None]
BOOK.cases("to_time", TIMES, {"h": "case when c like '%:%' or c like '%.%' then split_part(replace(c, '.', ':'), ':', 1)::int when length(c) = 4 then left(c, 2)::int end", "i": "case when c like '%:%' or c like '%.%' then split_part(replace(c, '.', ':'), ':', 2)::int when length(c) = 4 then right(c, 2)::int end", "s": "case when c like '%:%' or c like '%.%' then coalesce(try_cast(split_part(replace(c, '.', ':'), ':', 3) as int), 0) when length(c) = 4 then 0 end"}, h=lambda: C.to_time("c")["h"], i=lambda: C.to_time("c")["i"], s=lambda: C.to_time("c")["s"])
BOOK.columns("to_isotime", "orders", "o_orderkey", {"t": "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "p": "strftime(o_orderdate, '-%Y-%m-%dT%H:%M:%SZ')"}, t=lambda: C.to_isotime("o_orderdate"), p=lambda: C.parts_to_isotime(F.struct((-F.year("o_orderdate")).alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.hour("o_orderdate").alias("h"), F.minute("o_orderdate").alias("i"), F.second("o_orderdate").alias("s"))))
BOOK.columns("to_json", "nation", "n_nationkey", {"t": "'{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}'"}, t=lambda: C.to_json("n_nationkey", "n_name"))
BOOK.columns("convert_json", "events", "event_id", {"k": "(props::json->>'$.k')::bigint"}, k=lambda: F.try_variant_get(C.convert_json("props"), "$.k", "bigint"))
_doc("unicode_to_utf8", {"t": "lower(hex(encode(text)))"}, t=lambda: F.lower(F.hex(C.unicode_to_utf8("text"))))

_EVENT = "events", "event_id"
BOOK.columns("dateformat_day", *_EVENT, {"d": "strftime(ts, '%d')", "j": "day(ts)::varchar", "short": "strftime(ts, '%a')", "long": "strftime(ts, '%A')", "w": "dayofweek(ts)::varchar", "z": "dayofyear(ts)::varchar", "days": "day(last_day(ts))::varchar", "ordinal": "case when day(ts) in (1, 21, 31) then 'st' when day(ts) in (2, 22) then 'nd' when day(ts) in (3, 23) then 'rd' else 'th' end", "week": "weekofyear(ts)::varchar"}, **{k: (lambda p=p: D.format_date("ts", p)) for k, p in {"d": "d", "j": "j", "short": "D", "long": "l", "w": "w", "z": "z", "days": "t", "ordinal": "S", "week": "W"}.items()})
BOOK.columns("dateformat_month", "orders", "o_orderkey", {"mm": "strftime(o_orderdate, '%m')", "n": "month(o_orderdate)::varchar", "short": "strftime(o_orderdate, '%b')", "long": "strftime(o_orderdate, '%B')", "low": "lower(strftime(o_orderdate, '%b'))", "ap": "(['Jan.', 'Feb.', 'March', 'April', 'May', 'June', 'July', 'Aug.', 'Sept.', 'Oct.', 'Nov.', 'Dec.'])[month(o_orderdate)]"}, **{k: (lambda p=p: D.format_date("o_orderdate", p)) for k, p in {"mm": "m", "n": "n", "short": "M", "long": "F", "low": "b", "ap": "N"}.items()})
BOOK.columns("dateformat_year", "orders", "o_orderkey", {"yyyy": "year(o_orderdate)::varchar", "yy": "strftime(o_orderdate, '%y')", "signed": "lpad(year(o_orderdate)::varchar, 4, '0')", "leap": "case when year(o_orderdate) % 4 = 0 and (year(o_orderdate) % 100 <> 0 or year(o_orderdate) % 400 = 0) then 'True' else 'False' end", "era": "' CE'", "bce": "''"}, **{k: (lambda p=p: D.format_date("o_orderdate", p)) for k, p in {"yyyy": "Y", "yy": "y", "signed": "x", "leap": "L", "era": "E", "bce": "e"}.items()})
H12 = "((hour(ts) + 11) % 12 + 1)"
F12 = f"{H12}::varchar || case when minute(ts) = 0 then '' else ':' || lpad(minute(ts)::varchar, 2, '0') end"
BOOK.columns("dateformat_time", *_EVENT, {"a": "case when hour(ts) > 11 then 'p.m.' else 'a.m.' end", "up": "case when hour(ts) > 11 then 'PM' else 'AM' end", "g": f"{H12}::varchar", "h": f"lpad({H12}::varchar, 2, '0')", "g24": "hour(ts)::varchar", "h24": "strftime(ts, '%H')", "i": "strftime(ts, '%M')", "s": "strftime(ts, '%S')", "f": F12, "p": f"case when minute(ts) = 0 and hour(ts) = 0 then 'midnight' when minute(ts) = 0 and hour(ts) = 12 then 'noon' else {F12} || case when hour(ts) > 11 then ' p.m.' else ' a.m.' end end", "b": "''"}, **{k: (lambda p=p: D.format_date("ts", p)) for k, p in {"a": "a", "up": "A", "g": "g", "h": "h", "g24": "G", "h24": "H", "i": "i", "s": "s", "f": "f", "p": "P", "b": "B"}.items()})
BOOK.columns("dateformat_zone", *_EVENT, {"c": "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')", "o": "'+0000'", "z": "'0'", "u": "floor(epoch(ts))::bigint::varchar", "dst": "'0'", "r": "strftime(ts, '%a, %-d %b %Y %H:%M:%S +0000')", "kolkata": "'+0530'", "quirk": "'+0550'"}, **{k: (lambda p=p, z=z, q=q: D.format_date("ts", p, z, q)) for k, (p, z, q) in {"c": ("c", "UTC", False), "o": ("O", "UTC", False), "z": ("Z", "UTC", False), "u": ("U", "UTC", False), "dst": ("I", "UTC", False), "r": ("r", "UTC", False), "kolkata": ("O", "Asia/Kolkata", False), "quirk": ("O", "Asia/Kolkata", True)}.items()})
BOOK.columns("dateformat_pattern", *_EVENT, {"t": "strftime(ts, '%A d %-d/%-m %Y') || ', ' || strftime(ts, '%H:%M')"}, t=lambda: D.format_date("ts", r"l \d j/n Y, H:i"))
_SUNDAY = "(make_date(year(ts), {0}, 31) - dayofweek(make_date(year(ts), {0}, 31))::int)::timestamp"
BOOK.columns("tz_name", *_EVENT, {"t": f"case when ts >= {_SUNDAY.format(3)} + interval 3 hour and ts < {_SUNDAY.format(10)} + interval 3 hour then 'CEST' else 'CET' end"}, t=lambda: D.tz_name("ts", "Europe/Amsterdam"))
BOOK.columns("dateformat_now", "region", "r_regionkey", None, year=lambda: D.format_now("Y"))

_part("float_digits", {"t": "(p_retailprice / 7)::varchar"}, t=lambda: S.float_digits(F.col("p_retailprice") / 7))
BOOK.columns("frexp", "part", "p_partkey", {"mantissa": "p_size / pow(2, floor(log2(p_size)) + 1)", "exponent": "(floor(log2(p_size)) + 1)::bigint"}, mantissa=lambda: S.frexp("p_size")["mantissa"], exponent=lambda: S.frexp("p_size")["exponent"])
_part("int_pow", {"n": "pow(p_size, 5)::bigint"}, n=lambda: S.int_pow("p_size", 5))
_part("int_ceil", {"n": "ceil(p_retailprice / 7)::bigint"}, n=lambda: S.int_ceil(F.col("p_retailprice") / 7))
