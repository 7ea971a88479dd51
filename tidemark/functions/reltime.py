"""Time relative to a launch date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def launch_date(launch: dt.date | str) -> Column:
    return F.lit(str(launch)).cast("date")


def wall_clock(c: Column) -> Column:
    """ISO text with an offset -> TIMESTAMP_NTZ of the local wall clock; the offset is dropped, not applied. Unparsable: null."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", ""), "T", " ")).cast("timestamp_ntz")


def to_local(c: Column, timezone: str = "Asia/Jakarta") -> Column:
    """A UTC time as local wall clock."""
    return F.from_utc_timestamp(c, timezone)


def relative_month(day: Column, launch: dt.date | str) -> Column:
    """1 + whole calendar months since launch, truncated toward zero: the month before launch is also 1."""
    d, at = F.to_date(day), launch_date(launch)
    m = ((F.year(d) - F.year(at)) * 12 + F.month(d) - F.month(at)).cast("int")
    whole = F.add_months(at, m)
    return m + F.when((d >= at) & (d < whole), -1).when((d < at) & (d > whole), 1).otherwise(0) + 1


def relative_week_uncapped(day: Column, launch: dt.date | str) -> Column:
    return (F.floor(F.datediff(F.to_date(day), launch_date(launch)) / 7) + 1).cast("int")


def relative_week(day: Column, launch: dt.date | str, n_weeks: int = 52) -> Column:
    """The last week also takes the days after it."""
    return F.least(F.lit(n_weeks), relative_week_uncapped(day, launch))


def month_period(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def iso_utc(c: Column) -> Column:
    """A UTC time as ISO text with its offset."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
