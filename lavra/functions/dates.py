"""Dates held as text: strict and lenient readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = (2019, 2026)
PLAUSIBLE = (1800, 2100)


def parse_iso_strict(text: Column) -> Column:
    """The date of `YYYY-MM-DD`, alone or before `T` or a space; null for anything else.

    Blanks around it are ignored. Year 0 is no date.
    """
    t = F.trim(text)
    day = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)") & (F.substring(t, 1, 4) != "0000"), day)


def is_plausible(date: Column) -> Column:
    """Whether the year lies in [1800, 2100]; false without a date."""
    return F.coalesce(F.year(date).between(*PLAUSIBLE), F.lit(False))


def _checked(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists, else null. Year 0 is no date."""
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when((year != "0000") & (year != ""), date.cast("string"))


def normalize_iso(text: Column) -> Column:
    """ISO text of a date at the beginning, `YYYY-MM-DD` or `d/m/YYYY`, whatever follows; else empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    iso, local = r"^(\d{4})-(\d{2})-(\d{2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    found = F.when(t.rlike(iso), _checked(part(iso, 1), part(iso, 2), part(iso, 3))).when(
        t.rlike(local), _checked(part(local, 3), part(local, 2), part(local, 1))
    )
    return F.coalesce(found, F.lit(""))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CLOCK = r"([01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])"
_ZONE = r"(?:[+-]\d{2}:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|Z)"
#: Formats of feeds, each for the whole text: pattern, and the groups of year, month and day.
_FEED = (
    (rf"(?i)^(?:mon|tue|wed|thu|fri|sat|sun),\s+(\d{{1,2}})\s+({'|'.join(_MONTHS)})\s+(\d{{4}})\s+{_CLOCK}(?:\s+(?:{_ZONE}|utc|gmt))?$", (3, 2, 1)),
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})T{_CLOCK}(?:\.\d{{1,6}})?{_ZONE}$", (1, 2, 3)),
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:\s+{_CLOCK})?$", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+([01]?\d|2[0-3]):[0-5]?\d(?::(?:[0-5]?\d|6[01]))?)?$", (3, 2, 1)),
)


def parse_pubdate(text: Column) -> Column:
    """ISO text of a feed's date, as its own clock has it; null where nothing fits.

    RFC 822 with English names, ISO with a time and zone, or `d/m/YYYY` with or without a time. Failing
    these, a leading `YYYY-MM-DD` is taken as it stands, and a leading `dd/mm/YYYY` if it exists.
    """
    t = F.trim(F.coalesce(text, F.lit("")))

    def branch(pattern: str, groups: tuple[int, int, int]) -> Column:
        year, month, day = (F.regexp_extract(t, pattern, g) for g in groups)
        number = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(month))
        return F.when(t.rlike(pattern), _checked(year, F.when(number > 0, number.cast("string")).otherwise(month), day))

    iso, local = r"^(\d{4}-\d{2}-\d{2})", r"^(\d{2})/(\d{2})/(\d{4})"
    loose = F.when(t.rlike(iso), F.regexp_extract(t, iso, 1)).when(
        t.rlike(local), _checked(F.regexp_extract(t, local, 3), F.regexp_extract(t, local, 2), F.regexp_extract(t, local, 1))
    )
    return F.coalesce(*(branch(*f) for f in _FEED), loose)


def year_in_window(iso: Column, window: tuple[int, int] = WINDOW) -> Column:
    """Whether the year of an ISO date lies in the window; false without a date."""
    return F.coalesce(F.year(F.try_to_date(iso, "yyyy-MM-dd")).between(*window), F.lit(False))
