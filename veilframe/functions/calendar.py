"""Dates as they are written, which a calendar has to know: there is no 31 February."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Months by their first letters in English and Danish, and the days of the week.
MONTH_OF = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "maj": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12}
MONTHS = "jan(?:uary|uar)?|feb(?:ruary|ruar)?|mar(?:ch|ts)?|apr(?:il)?|may|maj|june?|juni|july?|juli|aug(?:ust)?|sept?(?:ember)?|o[ck]t(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday|mandag|tirsdag|onsdag|torsdag|fredag|lørdag|søndag"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th|\.)?"
WRITTEN = rf"(?<![\w.])(?:(?:the |den )?{_DAY} (?:of )?(?:{MONTHS})\b\.?(?:,? \d{{4}}\b)?|(?:{MONTHS})\.? (?:the )?{_DAY}(?!\w)(?:,? \d{{4}}\b)?)"
ISO = r"(?<![\w-])\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])"
RELATIVE = rf"(?<!\w)(?:yesterday|today|tomorrow|i går|i dag|i morgen|(?:last|next|this) (?:week|month|year|{DAYS})|(?:\d{{1,3}}|a|an|one|two|three|four|five|six|seven|eight|nine|ten) (?:day|week|month|year)s? (?:ago|from now))(?!\w)"


def in_calendar(year: Column, month: Column, day: Column) -> Column:
    """Whether a month of a year has a day; without a year any leap year does."""
    month, year = month.cast("int"), F.coalesce(year.cast("int"), F.lit(2000))
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    most = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.coalesce(day.cast("int").between(F.lit(1), most), F.lit(False))


def valid_written(date: Column) -> Column:
    months = F.create_map(*[F.lit(x) for pair in MONTH_OF.items() for x in pair])

    def of(text: Column) -> Column:
        part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        month = F.element_at(months, part(rf"(?U)(?:^|[^\p{{L}}])({'|'.join(MONTH_OF)})"))
        return in_calendar(part(r"(?:^|[^0-9])(\d{4})$"), month, part(r"(?:^|[^0-9])(\d{1,2})(?:[^0-9]|$)"))

    return let(F.lower(date), of)


def valid_iso(date: Column) -> Column:
    return in_calendar(date.substr(1, 4), date.substr(6, 2), date.substr(9, 2))
