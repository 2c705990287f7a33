"""Date, duration and date-id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Prefixes of month names, in the order in which they are tried (fixed values).
MONTHS = (("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("ма", 5), ("июн", 6), ("июл", 7), ("август", 8), ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12))
SUFFIX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SIX_YEARS = 6 * 365


def dotted(iso: Column) -> Column:
    """ISO dates as DD.MM.YYYY; anything else as it is."""
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.regexp_replace(F.left(iso, F.lit(10)), r"^(\d{4})-(\d{2})-(\d{2})$", "$3.$2.$1")).otherwise(F.coalesce(iso, F.lit("")))


def month_of(word: Column) -> Column:
    out = F.lit(None).cast("int")
    for prefix, n in reversed(MONTHS):
        out = F.when(F.startswith(F.lower(word), F.lit(prefix)), n).otherwise(out)
    return out


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where it isn't in the calendar or outside 1990 to 2100."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(1990, 2100) & month.between(1, 12) & day.between(1, 31), F.try_to_date(text, "yyyy-MM-dd"))


def _first(found: Column) -> Column:
    return F.try_element_at(F.filter(found, lambda d: d.isNotNull()), F.lit(1))


#: Forms of dates in text: numeric, day and month's word, month's word (fixed patterns).
_NUMERIC = r"(?U)\b([0-3]?\d)[.\-/]([01]?\d)[.\-/](\d{2,4})\b"
_NAMED = r"(?U)\b([0-3]?\d)\s+([а-яА-ЯёЁ]+)\s+(\d{4})\b"
_MONTHLY = r"(?U)\b([А-ЯЁ][а-яё]+)\s+(\d{4})\b"


def first_date(text: Column) -> Column:
    """The first date of a text: numeric, then day month-word year, then Month year (its first day)."""
    number = lambda x, pattern, k: F.regexp_extract(x, pattern, k).cast("int")
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    year = lambda y: F.when(y < 100, y + 2000).otherwise(y)
    a = _first(F.transform(every(_NUMERIC), lambda x: _day(year(number(x, _NUMERIC, 3)), number(x, _NUMERIC, 2), number(x, _NUMERIC, 1))))
    b = _first(F.transform(every(_NAMED), lambda x: _day(number(x, _NAMED, 3), month_of(F.regexp_extract(x, _NAMED, 2)), number(x, _NAMED, 1))))
    c = _first(F.transform(every(_MONTHLY), lambda x: _day(number(x, _MONTHLY, 2), month_of(F.regexp_extract(x, _MONTHLY, 1)), F.lit(1))))
    return F.coalesce(a, b, c)


def url_date(url: Column) -> Column:
    """The date of /YYYY/MM/DD/N in a URL, or null."""
    return F.try_to_date(F.regexp_replace(F.regexp_extract(url, r"/(\d{4}/\d{2}/\d{2})/\d+", 1), "/", "-"), "yyyy-MM-dd")


def url_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/\d{4}/\d{2}/\d{2}/(\d+)", 1), F.lit("")).cast("int")


def chosen_date(text_date: Column, from_url: Column) -> Column:
    """The text's date if it lies within six years of the URL's, else the URL's."""
    return F.when(F.abs(F.datediff(text_date, from_url)) < SIX_YEARS, text_date).otherwise(from_url)


def date_source(text_date: Column, from_url: Column) -> Column:
    return F.when(F.abs(F.datediff(text_date, from_url)) < SIX_YEARS, "text").otherwise("url")


def suffix(n: Column) -> Column:
    """Bijective base 52: nothing for 0, then A to Z, a to z, AA and so on (up to three letters)."""
    letter = lambda k: F.substring(F.lit(SUFFIX), (F.pmod(k - 1, F.lit(52)) + 1).cast("int"), F.lit(1))
    up = lambda k: F.floor((k - 1) / 52)
    one, two, three = n, up(n), up(up(n))
    part = lambda k: F.when(k > 0, letter(k)).otherwise("")
    return F.concat(part(F.when(two > 0, three).otherwise(0)), part(F.when(one > 0, two).otherwise(0)), part(one))


def date_id(day: Column, position: Column) -> Column:
    """The date as year, month and day characters, then the suffix of its place in the day."""
    y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
    year = (
        F.when(y.between(2020, 2029), (y - 2020).cast("string"))
        .when(y.between(1994, 2019), F.char(y - 2019 + 90))
        .when(y.between(2030, 2055), F.char(y - 2030 + 97))
        .otherwise(F.concat(F.lit("Y"), y.cast("string")))
    )
    digit = lambda k: F.when(k <= 9, k.cast("string")).otherwise(F.char(k - 10 + 65))
    return F.concat(year, digit(m), digit(d), suffix(position))


def seconds(duration: Column) -> Column:
    """``[h:]m:ss`` as seconds; null for anything else."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d\d)$"
    part = lambda k: F.nullif(F.regexp_extract(duration, pattern, k), F.lit("")).cast("long")
    return F.when(duration.rlike(pattern), (F.coalesce(part(1), F.lit(0)) * 60 + part(2)) * 60 + part(3))


def duration(s: Column) -> Column:
    """Seconds as ``m:ss``, from an hour on ``h:mm:ss``."""
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def is_date_line(s: Column) -> Column:
    """Whether hardly anything (one character at most) is left of a line without its date."""
    rest = F.regexp_replace(s, r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}", "")
    return (F.length(F.regexp_replace(rest, r"[\s.,г]+", "")) <= 1) & (rest != s)


def expired(expires: Column, now: Column, margin: int = 0) -> Column:
    return expires < now + margin


def reset_time(text: Column, now: Column) -> Column:
    """When a limit ends, from its message: ``in N hours``, or ``resets H[:MM]am/pm`` today or, if past, tomorrow."""
    hours = F.nullif(F.regexp_extract(text, r"(?i)in (\d+) hours?", 1), F.lit("")).cast("int")
    clock = r"(?i)resets? (?:at )?(\d{1,2})(?::(\d{2}))?\s*(am|pm)"
    h = F.nullif(F.regexp_extract(text, clock, 1), F.lit("")).cast("int")
    m = F.coalesce(F.nullif(F.regexp_extract(text, clock, 2), F.lit("")).cast("int"), F.lit(0))
    at = F.pmod(h, F.lit(12)) + F.when(F.lower(F.regexp_extract(text, clock, 3)) == "pm", 12).otherwise(0)
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), at, m)
    return F.coalesce(now + F.make_dt_interval(F.lit(0), hours), F.when(today <= now, today + F.make_dt_interval(F.lit(1))).otherwise(today))
