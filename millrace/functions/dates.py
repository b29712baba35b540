"""Calendar functions as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in turn where none is given.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "d/M/yyyy HH:mm:ss",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy/MM/dd",
    "d-M-yyyy",
    "d.M.yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
)
_PERIOD = re.compile(r"(\d+)\s*([hdwmy])")


def parse_datetime(c: Column, fmt: str | None = None) -> Column:
    """The given format, then the known ones; null where none takes the text."""
    formats = ((fmt,) if fmt else ()) + DATETIME_FORMATS
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


# The months by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = rf"\b({'|'.join(MONTHS)})[a-z]*\.?"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_YEAR = r"(\d{4})\b"
#: Ways to write a date, and which group is its year, month and day; a month or day of 0 isn't written.
WRITTEN = (
    (r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", (1, 2, 3)),
    (rf"\b{_DAY}[\s-]+(?:of\s+)?{_MONTH},?[\s-]+{_YEAR}", (3, 2, 1)),
    (rf"{_MONTH}[\s-]+{_DAY},?[\s-]+{_YEAR}", (3, 1, 2)),
    (rf"\b(\d{{1,2}})[-/.](\d{{1,2}})[-/.]{_YEAR}", (3, 1, 2)),
    (rf"{_MONTH},?\s+{_YEAR}", (2, 1, 0)),
)
_TIME = r"(?<![\d:.])(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*([ap]\.?m\b)?"


def find_datetime(c: Column) -> Column:
    """The date, with the time if there is one, that stands anywhere in a text; null without one.

    The first way of writing it that occurs, in the order of WRITTEN, tells the date. Of two numbers before a year the
    first is the month, or else, if it is above 12, the day. A month without a day is its first. Days that don't exist give null.
    """
    low = F.lower(c)
    number = lambda text: text.try_cast("int")
    dates = []
    for pattern, (y, m, d) in WRITTEN:
        part = lambda g, p=pattern: F.regexp_extract(low, p, g)
        named = F.array_position(F.array(*map(F.lit, MONTHS)), part(m)).cast("int")
        month = F.when(named > 0, named).otherwise(number(part(m)))
        day = number(part(d)) if d else F.lit(1)
        turned = month > 12
        date = F.struct(number(part(y)).alias("y"), F.when(turned, day).otherwise(month).alias("m"), F.when(turned, month).otherwise(day).alias("d"))
        dates.append(F.when(low.rlike(pattern), date))
    date = F.coalesce(*dates)
    clock = lambda g: F.regexp_extract(low, _TIME, g)
    hour, half = F.coalesce(number(clock(1)), F.lit(0)), F.left(clock(4), F.lit(1))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    shown = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", date["y"], date["m"], date["d"], hour, F.coalesce(number(clock(2)), F.lit(0)), F.coalesce(number(clock(3)), F.lit(0)))
    return F.when(date.isNotNull(), F.try_to_timestamp(shown, F.lit("yyyy-MM-dd HH:mm:ss")))


def format_datetime(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(c, fmt)


def now() -> Column:
    """The time at which a query starts, the same for all its rows."""
    return F.current_timestamp()


def convert_timezone(c: Column, source: str, target: str) -> Column:
    return F.from_utc_timestamp(F.to_utc_timestamp(c, source), target)


def date_range(start: Column, end: Column, days: int = 1) -> Column:
    """Dates from start to end, both included."""
    return F.sequence(start, end, F.make_dt_interval(F.lit(days)))


def duration_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def format_duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, those of which there are none left out."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(F.pmod(s, F.lit(86400)) / 3600), "h"), (F.floor(F.pmod(s, F.lit(3600)) / 60), "m"), (F.pmod(s, F.lit(60)), "s")]
    shown = F.concat_ws(" ", *(F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts))
    return F.when(s == 0, "0s").otherwise(shown)


def week_bounds(d: Column) -> tuple[Column, Column]:
    """Monday and Sunday."""
    first = F.to_date(F.date_trunc("week", d))
    return first, F.date_add(first, 6)


def month_bounds(d: Column) -> tuple[Column, Column]:
    return F.to_date(F.date_trunc("month", d)), F.last_day(d)


def quarter_bounds(d: Column) -> tuple[Column, Column]:
    first = F.to_date(F.date_trunc("quarter", d))
    return first, F.last_day(F.add_months(first, 2))


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def count_business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays from start to end, both included, in closed form."""
    days = F.datediff(end, start) + 1
    rest = F.pmod(days, F.lit(7))
    first = F.weekday(start)
    last = first + rest - 1
    # of the days beyond whole weeks, those that fall on day 5 or 6, or on 12 or 13
    weekend = F.greatest(F.lit(0), F.least(last, F.lit(6)) - F.greatest(first, F.lit(5)) + 1) + F.greatest(F.lit(0), F.least(last, F.lit(13)) - 12 + 1)
    return F.when(days <= 0, F.lit(0)).otherwise(F.floor(days / 7) * 5 + rest - F.when(rest > 0, weekend).otherwise(0)).cast("long")


def add_business_days(d: Column, n: int) -> Column:
    """The n-th Monday to Friday after d (before it, for negative n)."""
    if n == 0:
        return d
    day = F.weekday(d)
    if n > 0:
        from_friday = F.when(day >= 5, F.date_sub(d, day - 4)).otherwise(d)
        at = F.when(day >= 5, 4).otherwise(day)
        return F.date_add(from_friday, F.lit(n) + F.floor((at + n) / 5).cast("int") * 2)
    from_monday = F.when(day >= 5, F.date_add(d, 7 - day)).otherwise(d)
    at = F.when(day >= 5, 0).otherwise(day)
    return F.date_sub(from_monday, F.lit(-n) + F.floor((4 - at - n) / 5).cast("int") * 2)


def relative_date(d: Column, years: int = 0, months: int = 0, weeks: int = 0, days: int = 0) -> Column:
    return F.date_add(F.add_months(d, years * 12 + months), weeks * 7 + days)


def age_years(born: Column, on: Column) -> Column:
    """Whole years, months in twelfths and days in 365.25ths, to two digits."""
    months = F.floor(F.months_between(on, born))
    rest = F.datediff(on, F.add_months(born, months.cast("int")))
    return F.bround(F.floor(months / 12) + F.pmod(months, F.lit(12)) / 12 + rest / 365.25, 2)


def is_recent(c: Column, now: Column, hours: int) -> Column:
    return c >= now - F.make_dt_interval(hours=F.lit(hours))


def last_periods(on: Column, unit: str, n: int) -> Column:
    """Starts of the last n months, quarters or years up to the one of `on`."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    first = F.to_date(F.date_trunc(unit, on))
    return F.transform(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), lambda i: F.add_months(first, -(i * months)))


def period_days(period: str) -> float:
    """Days in a period such as 24h, 30d, 2w, 3m or 1y."""
    found = _PERIOD.fullmatch(period.strip().lower())
    if not found:
        raise ValueError(f"no period: {period}")
    return int(found[1]) * {"h": 1 / 24, "d": 1, "w": 7, "m": 30, "y": 365}[found[2]]
