"""Scalar expressions for statistics and for reading numbers and dates out of text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text forms accepted as numbers, and the date formats that single_format chooses from.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
                    "MM/dd/yyyy"]


def rounded(c: Column, digits: int) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal literal becomes NULL."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(F.regexp_replace(c, r"\s", "")).try_cast("double"))


def _shape(fmt: str) -> str | None:
    """Regular expression of the texts a purely numeric date format can match."""
    parts = re.findall(r"([yMdHmsS])(\1*)|'([^']*)'|(.)", fmt)
    if any(other.isalpha() for *_, other in parts):
        return None
    return "^" + "".join(r"\d{%d}" % (1 + len(more)) if letter else re.escape(quoted or other)
                         for letter, more, quoted, other in parts) + "$"


# A time of day after a date, and a zone.
_TIME = r"(?:(?:[T ]|,? +)(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?) *(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?)?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +)?"
# Shapes of dates with the groups that hold year, month and day.
_SHAPES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})" + _TIME + "$", (3, 1, 2)),
    (r"(?i)^" + _WEEKDAY + _MONTH + r" +(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})" + _TIME + "$", (3, 1, 2)),
    (r"(?i)^" + _WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th)?[- ]+" + _MONTH + r"[-, ]+(\d{4})" + _TIME + "$", (3, 2, 1)),
]


def _free_timestamp(text: Column) -> Column:
    """Dates of the usual shapes: ISO, year first, month first, names of months; a time and a zone may follow.

    A time in a zone is turned into UTC.
    """
    found = F.lit(None).cast("timestamp_ntz")
    for shape, (year, month, day) in reversed(_SHAPES):
        part = lambda i: F.regexp_extract(text, shape, i)  # noqa: B023, E731
        number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(part(month), 1, 3))).cast("string")
        number = number if "jan" in shape else part(month)
        clock, zone = F.regexp_replace(part(4), ",", "."), F.upper(part(5))
        clock = F.when(clock == "", "00:00:00").when(clock.rlike(r"^\d+:\d+$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
        local = F.concat_ws(" ", F.concat_ws("-", part(year), number, part(day)), clock).try_cast("timestamp_ntz")
        offset = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.lpad(F.regexp_replace(F.substring(zone, 4, 3), ":", ""), 2, "0")))
        value = F.when(offset.isNull(), local).otherwise(F.convert_timezone(offset, F.lit("UTC"), local))
        found = F.when(text.rlike(shape), value).otherwise(found)
    return found


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """Text to timestamp, without a time zone; no match becomes NULL.

    Without ``formats`` dates of all usual shapes are read, else the first format that fits is
    used. A text is only parsed if it has the shape of the format: a failing parse costs far
    more than the test.
    """
    text = F.trim(c)
    if formats is None:
        return _free_timestamp(text)
    found = []
    for fmt in formats:
        parsed, shape = F.try_to_timestamp(text, F.lit(fmt)), _shape(fmt)
        found.append(F.when(text.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*found).cast("timestamp_ntz")


def adjusted_skew(v: str) -> str:
    """SQL text of the sample-adjusted skewness (n >= 3); 0 for a constant column."""
    n = f"cast(count({v}) as double)"
    return (f"if(count({v}) >= 3, if(max({v}) = min({v}), 0D, skewness({v})) * sqrt({n} * ({n} - 1))"
            f" / nullif({n} - 2, 0D), null)")


def percent(c: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)
