"""Dates in text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of months; fixed values.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7,
    "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12,
    "december": 12,
}

_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
ISO = _START + r"(\d{4}-\d{2}-\d{2})" + _END


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _formed(year: Column, month: Column, day: Column) -> Column:
    """A date string without a look at the calendar: day 31 of any month passes, day 32 doesn't."""
    return F.when(month.between(1, 12) & day.between(1, 31), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def publish_date(text: Column, today: Column) -> Column:
    """The first ISO date, else a date with a month's name, else one so many days, weeks, months or years before today."""
    month = lambda name: F.element_at(F.create_map(*[F.lit(x) for p in MONTHS.items() for x in p]), F.lower(name))
    iso = F.nullif(F.regexp_extract(text, ISO, 1), F.lit(""))
    first = _START + r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})" + _END
    second = _START + r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})" + _END
    get = lambda pattern, i: F.regexp_extract(text, pattern, i)
    month_first = F.when(month(get(first, 1)).isNotNull(), _formed(get(first, 3), month(get(first, 1)), _number(get(first, 2))))
    day_first = F.when(month(get(second, 2)).isNotNull(), _formed(get(second, 3), month(get(second, 2)), _number(get(second, 1))))
    # Once a month's name is known in the first form, an impossible day there does not open the second.
    named = F.when(month(get(first, 1)).isNotNull(), month_first).otherwise(day_first)
    ago = r"(?i)" + _START + r"(\d+)\s+(day|week|month|year)s?\s+ago" + _END
    amount, unit = _number(get(ago, 1)), F.lower(get(ago, 2))
    back = (
        F.when(unit == "day", F.date_sub(today, amount))
        .when(unit == "week", F.date_sub(today, amount * 7))
        .when(unit == "month", F.add_months(today, -amount))
        .when(unit == "year", F.add_months(today, -12 * amount))
    )
    return F.coalesce(iso, named, F.date_format(back, "yyyy-MM-dd"))


def within(date: Column, since: str | None, until: str | None, keep_undated: bool = True) -> Column:
    """Whether the string lies in the range, ends included, compared as text."""
    good = F.lit(True)
    if since:
        good = good & (date >= since)
    if until:
        good = good & (date <= until)
    return F.when(date.isNull(), F.lit(keep_undated or not (since or until))).otherwise(good)


def authoritative(published: Column, text: Column, today: Column) -> Column:
    """A provider's date where it has an ISO date, else what the text tells."""
    return F.when(published.rlike(ISO), published).otherwise(publish_date(text, today))


def normalize_published(raw: Column) -> Column:
    """A document's date as yyyy-MM-dd: the PDF form D:yyyyMMdd with defaults, or one of the usual forms; else null."""
    value = F.trim(raw)
    pdf = r"^D:(\d{4})(\d{2})?(\d{2})?"
    piece = lambda i: F.coalesce(F.nullif(F.regexp_extract(value, pdf, i), F.lit("")), F.lit("01"))
    from_pdf = F.try_to_date(F.concat_ws("-", F.regexp_extract(value, pdf, 1), piece(2), piece(3)), "yyyy-MM-dd")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy"]
    usual = F.coalesce(F.to_date(value.try_cast("timestamp")), *[F.try_to_date(value, f) for f in forms])
    return F.date_format(F.when(value.rlike(pdf), from_pdf).when(value.rlike(r"\d{4}"), usual), "yyyy-MM-dd")


def stale(date: Column, today: Column, months: int = 24) -> Column:
    day = F.try_to_date(date, "yyyy-MM-dd")
    age = (F.year(today) - F.year(day)) * 12 + F.month(today) - F.month(day)
    return F.coalesce(age > months, F.lit(False))


def iso_timestamp(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
