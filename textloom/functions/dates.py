"""Dates by format letters, compiled to plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import ColumnOrName, _c

_AP_MONTHS = "Jan. Feb. March April May June July Aug. Sept. Oct. Nov. Dec.".split()


def _offset_seconds(ts: Column, zone: str) -> Column:
    return F.unix_timestamp(ts) - F.unix_timestamp(F.to_utc_timestamp(ts, zone))


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _hour12(ts: Column) -> Column:
    return (F.hour(ts) + 11) % 12 + 1


def _simple(pattern: str) -> Callable[..., Column]:
    return lambda ts, *_: F.date_format(ts, pattern)


def _meridian(am: str, pm: str) -> Callable[..., Column]:
    return lambda ts, *_: F.when(F.hour(ts) > 11, pm).otherwise(am)


def _time12(ts: Column) -> Column:
    return F.concat(_hour12(ts).cast("string"), F.when(F.minute(ts) == 0, "").otherwise(F.concat(F.lit(":"), _pad(F.minute(ts), 2))))


def _spoken(ts: Column) -> Column:
    noon, midnight = (F.minute(ts) == 0) & (F.hour(ts) == 12), (F.minute(ts) == 0) & (F.hour(ts) == 0)
    return F.when(midnight, "midnight").when(noon, "noon").otherwise(F.concat(_time12(ts), F.lit(" "), _meridian("a.m.", "p.m.")(ts)))


def _ordinal(ts: Column) -> Column:
    d = F.dayofmonth(ts)
    return F.when(d.isin(1, 21, 31), "st").when(d.isin(2, 22), "nd").when(d.isin(3, 23), "rd").otherwise("th")


def _offset(ts: Column, zone: str, minutes: bool, compat: bool) -> Column:
    """+hhmm, or +hh:mm; compat: hours times 100, so half an hour is 50."""
    s = _offset_seconds(ts, zone)
    a, sign = F.abs(s), F.when(s < 0, "-").otherwise("+")
    if compat and not minutes:
        return F.concat(sign, _pad(F.floor(a / 36), 4))
    return F.concat(sign, _pad(F.floor(a / 3600), 2), F.lit(":" if minutes else ""), _pad(F.floor(a / 60) % 60, 2))


def _leap(ts: Column) -> Column:
    y = F.year(ts)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _day_of_year(ts: Column, compat: bool) -> Column:
    if not compat:
        return F.dayofyear(ts)
    # With the lengths of months 2 to the current one, instead of 1 to the one before.
    first = F.trunc(ts, "year")
    return F.dayofmonth(ts) + F.when(F.month(ts) == 1, 0).otherwise(F.datediff(F.add_months(F.trunc(ts, "month"), 1), F.add_months(first, 1)))


def _week(ts: Column, compat: bool) -> Column:
    week = F.weekofyear(ts)
    return F.when((F.month(ts) == 1) & (F.dayofmonth(ts) == 1) & (F.dayofweek(ts) == 1), 1).otherwise(week) if compat else week


def tz_name(c: ColumnOrName, zone: str) -> Column:
    """The zone's abbreviation at a local time."""
    return F.date_format(F.to_utc_timestamp(_c(c), zone), "z") if zone == "UTC" else _zone_text(_c(c), zone)


def _zone_text(ts: Column, zone: str) -> Column:
    import zoneinfo
    from datetime import UTC, datetime

    tz = zoneinfo.ZoneInfo(zone)
    names = {dst: None for dst in (False, True)}
    for month in range(1, 13):
        at = datetime(2024, month, 15, tzinfo=UTC).astimezone(tz)
        names[bool(at.dst())] = at.tzname()
    return F.when(_is_dst(ts, zone), names[True] or names[False]).otherwise(names[False] or names[True])


def _is_dst(ts: Column, zone: str) -> Column:
    year = F.year(ts).cast("string")
    winter = _offset_seconds(F.concat(year, F.lit("-01-01 12:00:00")).cast("timestamp"), zone)
    summer = _offset_seconds(F.concat(year, F.lit("-07-01 12:00:00")).cast("timestamp"), zone)
    return (winter != summer) & (_offset_seconds(ts, zone) == F.greatest(winter, summer))


_TAGS: dict[str, Callable[[Column, str, bool], Column]] = {
    "a": _meridian("a.m.", "p.m."),
    "A": _meridian("AM", "PM"),
    "B": lambda ts, z, q: F.lit(""),
    "b": lambda ts, z, q: F.lower(F.date_format(ts, "MMM")),
    "c": lambda ts, z, q: F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), _offset(ts, z, True, q)),
    "d": _simple("dd"),
    "D": _simple("EEE"),
    "e": lambda ts, z, q: F.when(F.year(ts) < 1, " BCE").otherwise(""),
    "E": lambda ts, z, q: F.when(F.year(ts) < 1, " BCE").otherwise(" CE"),
    "f": lambda ts, z, q: _time12(ts),
    "F": _simple("MMMM"),
    "g": lambda ts, z, q: _hour12(ts).cast("string"),
    "G": lambda ts, z, q: F.hour(ts).cast("string"),
    "h": lambda ts, z, q: _pad(_hour12(ts), 2),
    "H": _simple("HH"),
    "i": _simple("mm"),
    "I": lambda ts, z, q: F.when(_is_dst(ts, z), "1").otherwise("0"),
    "j": lambda ts, z, q: F.dayofmonth(ts).cast("string"),
    "l": _simple("EEEE"),
    "L": lambda ts, z, q: F.when(_leap(ts), "True").otherwise("False"),
    "m": _simple("MM"),
    "M": _simple("MMM"),
    "n": lambda ts, z, q: F.month(ts).cast("string"),
    "N": lambda ts, z, q: F.element_at(F.array(*map(F.lit, _AP_MONTHS)), F.month(ts)),
    "O": lambda ts, z, q: _offset(ts, z, False, q),
    "P": lambda ts, z, q: _spoken(ts),
    "r": lambda ts, z, q: F.concat(F.date_format(ts, "EEE, "), F.dayofmonth(ts).cast("string"), F.date_format(ts, " MMM yyyy HH:mm:ss "), _offset(ts, z, False, q)),
    "s": _simple("ss"),
    "S": lambda ts, z, q: _ordinal(ts),
    "t": lambda ts, z, q: F.dayofmonth(F.last_day(ts)).cast("string"),
    "T": lambda ts, z, q: tz_name(ts, z),
    "U": lambda ts, z, q: (F.unix_timestamp(ts) + _offset_seconds(ts, z) * (1 if q else -1)).cast("string"),
    "w": lambda ts, z, q: (F.dayofweek(ts) - 1).cast("string"),
    "W": lambda ts, z, q: _week(ts, q).cast("string"),
    "x": lambda ts, z, q: _pad(F.year(ts), 4),
    "y": lambda ts, z, q: F.substring(_pad(F.year(ts), 4), 3, 2),
    "Y": lambda ts, z, q: F.year(ts).cast("string"),
    "z": lambda ts, z, q: _day_of_year(ts, q).cast("string"),
    "Z": lambda ts, z, q: _offset_seconds(ts, z).cast("string"),
}
TAGS = "".join(_TAGS)


def format_date(c: ColumnOrName, pattern: str, zone: str = "UTC", compat: bool = False, translate: Callable[[Column], Column] | None = None) -> Column:
    """A local date or timestamp by format letters; other characters, and any after a backslash, stand for themselves.

    The year 9999 (no end) gives null.  zone: where the time is local.  compat: O as hours times
    100, U with the offset's sign turned, z and W off on some days.  translate: applied to names of
    days and months.
    """
    ts, parts, i = _c(c).cast("timestamp"), [], 0
    while i < len(pattern):
        letter = pattern[i]
        if letter == "\\" and i + 1 < len(pattern):
            i += 1
            parts.append(F.lit(pattern[i]))
        elif letter in _TAGS:
            part = _TAGS[letter](ts, zone, compat)
            parts.append(translate(part) if translate and letter in "bDFlMN" else part)
        else:
            parts.append(F.lit(letter))
        i += 1
    return F.when(F.year(ts) != 9999, F.concat(*parts) if parts else F.lit(""))


def format_now(pattern: str, zone: str = "UTC") -> Column:
    return format_date(F.from_utc_timestamp(F.current_timestamp(), zone), pattern, zone)
