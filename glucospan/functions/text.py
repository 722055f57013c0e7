"""Cleaning of text columns: numbers, timestamps, ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, of which the first three letters count, and days of the week.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
WEEKDAYS = "mon|tue|wed|thu|fri|sat|sun"
_MONTH = rf"({MONTHS})[a-z]*\.?"
_NTH = "(?:st|nd|rd|th)?"
# Dates as year-month-day, month-day-year, day-month name-year, month name-day-year and eight digits.
_DATE = "|".join([
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})",
    r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})",
    rf"(\d{{1,2}}){_NTH}[-\s]+{_MONTH}[-\s,]+(\d{{4}})",
    rf"{_MONTH}[-\s]*(\d{{1,2}}){_NTH}(?:\s*,\s*|[-\s]+)(\d{{4}})",
    r"(\d{4})(\d{2})(\d{2})",
])
# Times with colons, a fraction and a half of the day, or as six digits; an offset is read over.
_TIME = (
    r"(?:(?:\s*T\s*|\s*,\s*|\s+)(?:(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,](\d{1,9}))?)?\s*([ap]m)?|(\d{2})(\d{2})(\d{2}))"
    r"(?:\s*(?:Z|UTC|[-+]\d{2}:?\d{2}))?)?"
)
TIMESTAMP = rf"(?i)^\s*(?:(?:{WEEKDAYS})[a-z]*\.?\s*,?\s+)?(?:{_DATE}){_TIME}\s*$"
_FIELDS = 23


def numeric_clean(text: Column) -> Column:
    """Drop every character that cannot be part of a number, then parse; bad text gives NULL.

    A literal NaN cannot survive (its letters are removed), so the result is never NaN.
    """
    return F.regexp_replace(text.cast("string"), r"[^0-9eE+\-.]", "").try_cast("double")


def numeric_or_null(text: Column) -> Column:
    """Parse a plain number; blank or malformed text gives NULL."""
    value = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value), value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def parse_timestamp(text: Column) -> Column:
    """Mixed-format timestamp without zone; text of no known shape, or no real time, gives NULL.

    One pattern reads all shapes at once and lays their fields out side by side; the fields of the shape that
    fitted are not blank. Where the month of a month-day-year date exceeds 12, day and month change places. Years of
    two digits are of this century. Fractions count to the microsecond.
    """
    fields = "|".join(f"${i}" for i in range(1, _FIELDS + 1))
    laid = F.regexp_replace(text.cast("string"), TIMESTAMP, fields)

    def first(f: Column, *places: int) -> Column:
        """The field that is not blank among some, counted from 1."""
        return F.concat(*(f[i - 1] for i in places)) if len(places) > 1 else f[places[0] - 1]

    def number(value: Column) -> Column:
        return F.nullif(value, F.lit("")).cast("int")

    def made(f: Column) -> Column:
        year = number(first(f, 1, 6, 9, 12, 13))
        year = F.when(F.length(f[5]) == 2, year + 2000).otherwise(year)
        name = F.lower(first(f, 8, 10))
        month = F.when(name != "", (F.instr(F.lit(MONTHS.replace("|", "")), name) + 2) / 3).otherwise(number(first(f, 2, 4, 14)))
        day = number(first(f, 3, 5, 7, 11, 15))
        turned = (f[3] != "") & (month > 12)
        half, hour = F.lower(f[19]), F.coalesce(number(first(f, 16, 21)), F.lit(0))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        second = F.concat(F.lpad(first(f, 18, 23), 2, "0"), F.lit("."), F.rpad(f[18], 6, "0"))
        return F.try_make_timestamp_ntz(
            year,
            F.when(turned, day).otherwise(month).cast("int"),
            F.when(turned, month).otherwise(day).cast("int"),
            hour,
            F.coalesce(number(first(f, 17, 22)), F.lit(0)),
            second.cast("decimal(8,6)"),
        )

    # Text that does not fit stays as it is, in one field. The fields are worked out once for all their uses.
    parts = F.transform(F.array(F.split(laid, r"\|", -1)), lambda f: F.when(F.size(f) == _FIELDS, made(f)))
    return F.element_at(parts, 1)


def pad_id(value: Column, width: int = 3) -> Column:
    """Left-pad with zeros to ``width``; longer ids stay whole (a bare lpad would cut them).

    A leading sign stays in front of the zeros.
    """
    text = value.cast("string")
    signed = text.rlike(r"^[+-]")
    padded = F.when(
        signed,
        F.concat(F.substring(text, 1, 1), F.lpad(F.substring(text, 2, 2147483647), width - 1, "0")),
    ).otherwise(F.lpad(text, width, "0"))
    return F.when(F.length(text) < width, padded).otherwise(text)


def label(value: Column) -> Column:
    """``type2_diabetes`` -> ``Type2 Diabetes``; a letter after any non-letter is a capital."""
    spaced = F.replace(value, F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def is_event(kind: Column, amount: Column) -> Column:
    """A row records an event when it names a kind or carries a numeric amount."""
    return F.coalesce(kind.rlike(r"\S"), F.lit(False)) | amount.isNotNull()
