"""Timestamp parsing with the reference's accept/reject rules, as Spark
expressions.

Export headers carry ``M/D/YY, H:MM:SS``.  Python's ``strptime`` with
``%m/%d/%y %H:%M:%S`` decides what is valid; each field below repeats the
alternatives that format accepts (month is ASCII only; the second digit of
day, hour, minute and second and both year digits may be any Unicode
decimal digit), then the calendar check is ``try_make_timestamp_ntz``.
Two-digit years pivot POSIX style: 69-99 -> 19xx, 00-68 -> 20xx (Spark's
``yy`` pattern would map 69 to 2069).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"

_FIELD_RULES = {
    "month": r"^(?:1[0-2]|0[1-9]|[1-9])$",
    "day": r"^(?:3[01]|[12]\p{Nd}|0[1-9]|[1-9])$",
    "year": r"^\p{Nd}\p{Nd}$",
    "hour": r"^(?:2[0-3]|[01]\p{Nd}|\p{Nd})$",
    "minute": r"^(?:[0-5]\p{Nd}|\p{Nd})$",
    # 60 and 61 pass the pattern but are rejected by the datetime check.
    "second": r"^(?:[0-5]\p{Nd}|\p{Nd})$",
}


def _num(c: Column) -> Column:
    return ascii_digits(c).cast("int")


def export_timestamp(month: Column, day: Column, year2: Column,
                     hour: Column, minute: Column, second: Column) -> Column:
    """TIMESTAMP_NTZ for the header fields, NULL when the reference would
    raise.

    Fast path for ASCII digits: with at most two digits per field the
    format's alternatives reduce to the calendar ranges, which
    ``try_make_timestamp_ntz`` checks (second 60 is rejected explicitly:
    Spark rolls it over).  Other decimal digits take the per-field rules.
    """
    fields = [month, day, year2, hour, minute, second]
    ints = [f.try_cast("int") for f in fields]
    ascii_ok = ints[0].isNotNull()
    for i in ints[1:]:
        ascii_ok = ascii_ok & i.isNotNull()
    m, d, yy, hh, mi, ss = ints
    fast = F.when(ss <= 59, F.try_make_timestamp_ntz(
        yy + F.when(yy >= 69, F.lit(1900)).otherwise(F.lit(2000)), m, d, hh, mi, ss))
    ok = (F.regexp_like(month, F.lit(_FIELD_RULES["month"]))
          & F.regexp_like(day, F.lit(_FIELD_RULES["day"]))
          & F.regexp_like(year2, F.lit(_FIELD_RULES["year"]))
          & F.regexp_like(hour, F.lit(_FIELD_RULES["hour"]))
          & F.regexp_like(minute, F.lit(_FIELD_RULES["minute"]))
          & F.regexp_like(second, F.lit(_FIELD_RULES["second"])))
    uyy = _num(year2)
    year = uyy + F.when(uyy >= 69, F.lit(1900)).otherwise(F.lit(2000))
    slow = F.try_make_timestamp_ntz(year, _num(month), _num(day), _num(hour), _num(minute), _num(second))
    return F.when(ascii_ok, fast).otherwise(F.when(ok, slow))


def iso_string(ts: Column) -> Column:
    """``datetime.isoformat()``: seconds, plus ``.ffffff`` when the
    microseconds are not zero."""
    return F.when(F.date_format(ts, "SSSSSS") == F.lit("000000"), F.date_format(ts, ISO_FORMAT)).otherwise(
        F.date_format(ts, ISO_FORMAT + ".SSSSSS"))


# datetime.fromisoformat: a date (calendar or week, with or without hyphens),
# then any one character and a time (with or without colons, all digits of a
# fraction) with an optional offset.  ``(?s)``: that character may be a line feed.
_DATE = r"([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2})|-W([0-9]{2})(?:-([0-9]))?|W([0-9]{2})([0-9])?)"
_FRACTION = r"(?:[.,]([0-9]+))?"
_CLOCK = (r"([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})" + _FRACTION + r")?|([0-9]{2})(?:([0-9]{2})" + _FRACTION + r")?)?")
_OFFSET = r"(Z|([+-])([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})" + _FRACTION + r")?|([0-9]{2})(?:([0-9]{2})" + _FRACTION + r")?)?)?"
ISO_REGEX = "(?s)^" + _DATE + "(?:." + _CLOCK + _OFFSET + ")?$"
_PARTS = 25


def _week_date(year: Column, week: Column, day: Column) -> Column:
    """The date of an ISO week's day, NULL for a week the year does not have:
    week 1 holds January 4, and a week belongs to the year of its Thursday."""
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    thursday = F.date_add(monday, (week - 1) * 7 + 3)
    return F.when(week.between(1, 53) & day.between(1, 7) & (F.year(thursday) == year) & (F.year(found) <= 9999), found)


def iso_sort_key(timestamp: Column) -> Column:
    """``datetime.fromisoformat`` as a sort key (NULL where it raises).

    Takes the whole grammar: calendar dates ``YYYY-MM-DD`` and ``YYYYMMDD``,
    week dates ``YYYY-Www[-D]`` and ``YYYYWww[D]``, any one character before
    the time, ``HH[:MM[:SS[.f]]]`` and ``HHMM[SS[.f]]`` with a fraction of any
    length (cut to microseconds), and ``Z`` or an offset in the same forms;
    not ``YYYY-MM``.  A time with an offset is ordered by its instant; whether
    a timeline mixes such times with times without one, which have no common
    order, is checked by ``is_aware``.
    """
    # one pass of the pattern: the groups, joined by a character that no group holds
    groups = F.split(F.regexp_replace(timestamp, F.lit(ISO_REGEX), F.lit(";".join(f"${i}" for i in range(1, _PARTS + 1)))), ";")
    return F.when(F.regexp_like(timestamp, F.lit(ISO_REGEX)), F.transform(F.array(groups), _instant)[0])


def _instant(g: Column) -> Column:
    """TIMESTAMP_NTZ of the pattern's groups, NULL if a field is out of range."""
    field = lambda i: F.nullif(F.get(g, i - 1), F.lit(""))
    number = lambda *at: F.coalesce(*[field(i).try_cast("int") for i in at], F.lit(0))
    micros = lambda *at: F.rpad(F.substring(F.coalesce(*[field(i) for i in at], F.lit("")), 1, 6), 6, "0").cast("int")
    year, week = number(1), F.coalesce(field(6), field(8))
    day = F.when(week.isNotNull(), _week_date(F.when(year >= 1, year), number(6, 8), F.coalesce(field(7), field(9), F.lit("1")).cast("int"))) \
        .otherwise(F.try_make_timestamp_ntz(F.when(year >= 1, year), number(2, 4), number(3, 5), F.lit(0), F.lit(0), F.lit(0)).cast("date"))
    hour, minute, second = number(10), number(11, 14), number(12, 15)
    off_hour, off_minute, off_second = number(19), number(20, 23), number(21, 24)
    span = lambda h, m, s, f: (h.cast("long") * 3600 + m * 60 + s) * 1_000_000 + f
    local = span(hour, minute, second, micros(13, 16))
    ahead = span(off_hour, off_minute, off_second, micros(22, 25)) * F.when(field(18) == "-", -1).otherwise(1)
    # only the whole offset has a bound, of a day
    ok = (hour < 24) & (minute < 60) & (second < 60) & (F.abs(ahead) < 86_400_000_000)
    return F.when(ok, F.timestamp_add("MICROSECOND", local - ahead, day.cast("timestamp_ntz")))


def is_aware(timestamp: Column) -> Column:
    """Whether an ISO time has a zone offset."""
    return F.length(F.regexp_extract(timestamp, ISO_REGEX, 17)) > 0
