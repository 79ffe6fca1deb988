"""Dates: lenient parsing, fixed-width intervals, year repair."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """The first ten characters as a date; an unknown month or day (``-00``) means January 1st; else null."""
    head = F.substring(text, 1, 10)
    whole = F.when(F.contains(head, F.lit("-00")), F.concat(F.substring(text, 1, 4), F.lit("-01-01"))).otherwise(head)
    return F.try_to_date(whole, "yyyy-MM-dd")


def interval_index(date: Column, start: Column, days: int) -> Column:
    """The number of the half-open interval of ``days`` days, from ``start``, that holds the date."""
    return F.floor(F.datediff(date, start) / days).cast("int")


def interval_start(index: Column, start: Column, days: int) -> Column:
    return F.date_add(start, index * days)


def interval_name(begin: Column, days: int) -> Column:
    """``YYYY/MM/DD-YYYY/MM/DD``."""
    return F.concat(F.date_format(begin, "yyyy/MM/dd"), F.lit("-"), F.date_format(F.date_add(begin, days), "yyyy/MM/dd"))


def repair_year(year: Column) -> Column:
    """Two- and three-digit years: below 100 of the 1900s, below 200 of the 1800s plus; not a number: null."""
    number = F.when(year.rlike("^[0-9]+$"), year.cast("int"))
    return F.when(number < 100, number + 1900).when(number < 200, number + 1800).otherwise(number)


def decade(year: Column) -> Column:
    """The nearest ten, halves up; no decade for the year 0 or a year that's not a number."""
    number = F.when(year.rlike("^[0-9]+$"), year.cast("int"))
    return F.when(number != 0, F.round(number, -1))


#: Strptime directives as patterns of this engine.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "z": "xx", "j": "DDD"}


def strptime_format(fmt: str) -> str:
    """A strptime format in this engine's pattern letters, runs of other letters quoted."""
    out = []
    for directive, letters, other in re.findall(r"%(.)|([A-Za-z]+|')|(.)", fmt, re.DOTALL):
        out.append("%" if directive == "%" else DIRECTIVES[directive] if directive else "''" if letters == "'" else f"'{letters}'" if letters else other)
    return "".join(out)


#: Names of days, which tell nothing beside a date and aren't read.
_DAY_NAMES = r"(?i)\b(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\b"


def strptime(text: Column, fmt: str) -> Column:
    """The time that a text in a strptime format tells; two-digit years lie from 1969 to 2068."""
    if "%a" in fmt.lower().replace("%%", ""):
        text, fmt = F.regexp_replace(text, _DAY_NAMES, ""), fmt.replace("%a", "").replace("%A", "")
    found = F.try_to_timestamp(text, F.lit(strptime_format(fmt)))
    if "%y" in fmt.replace("%%", ""):
        found = F.when(F.year(found) >= 2069, F.timestamp_add("YEAR", F.lit(-100), found)).otherwise(found)
    return found
