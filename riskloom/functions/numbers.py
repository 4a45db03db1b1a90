"""Dates, distances and small numeric expressions."""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value[:10])


def minus_months(day: dt.date, months: int) -> dt.date:
    """Same day `months` earlier, clipped to the end of a shorter month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    return dt.date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class DayWindow:
    """Half-open range of days: `start` is the first day in it, `end` the first day after it."""

    start: dt.date
    end: dt.date

    @property
    def days(self) -> int:
        return (self.end - self.start).days

    @property
    def last_day(self) -> dt.date:
        return self.end - dt.timedelta(days=1)

    @property
    def months_touched(self) -> int:
        last = self.last_day
        return (last.year - self.start.year) * 12 + last.month - self.start.month + 1

    def contains(self, moment: Column) -> Column:
        return (moment >= F.lit(self.start)) & (moment < F.lit(self.end))


def recent_and_baseline(as_of: dt.date | str, baseline_months: int = 12, recent_days: int = 30
                        ) -> tuple[DayWindow, DayWindow]:
    """(baseline, recent): the last days including `as_of`, and the months right before them."""
    end = as_date(as_of) + dt.timedelta(days=1)
    start = end - dt.timedelta(days=recent_days)
    return DayWindow(minus_months(start, baseline_months), start), DayWindow(start, end)


def history_window(as_of: dt.date | str, months: int = 12) -> DayWindow:
    """The months that end on `as_of`, that day included."""
    end = as_date(as_of) + dt.timedelta(days=1)
    return DayWindow(minus_months(end, months), end)


def age_at(birth: Column, as_of: dt.date | str) -> Column:
    """Whole years on `as_of`; the birthday counts by month and day."""
    day = as_date(as_of)
    not_yet = ((F.month(birth) > day.month)
               | ((F.month(birth) == day.month) & (F.dayofmonth(birth) > day.day)))
    return F.lit(day.year) - F.year(birth) - not_yet.cast("int")


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of the wall-clock time, whatever the session time zone."""
    day = F.datediff(moment.cast("date"), F.lit(dt.date(1970, 1, 1))).cast("bigint")
    second = (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")
    return ((day * 86_400 + F.hour(moment) * 3_600 + F.minute(moment) * 60) * 1_000_000 + second)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = (F.pow(F.sin((p2 - p1) / 2), F.lit(2.0))
            + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0)))
    return F.asin(F.sqrt(half)) * 2 * EARTH_RADIUS_KM


def exact_parts(value: Column) -> tuple[Column, Column]:
    """A number as a multiple of 1/1024 and the rest. Sums of the first are exact, those of the second tiny, so the
    two together give the sum that is nearest to the true one, whatever the order."""
    whole = F.rint(value * 1024) / 1024
    return whole, F.nanvl(value - whole, F.lit(0.0))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
