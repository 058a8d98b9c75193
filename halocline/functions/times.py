"""Epochs, file times and windows, as column expressions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .steps import let

#: Epochs of the source formats.
EPOCHS = {"altimeter": "1950-01-01", "geostationary": "1981-01-01", "avhrr": "1978-01-01", "ascii_altimeter": "1985-01-01", "salinity": "2015-01-01"}


def from_epoch_seconds(seconds: Column, epoch: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("long"), F.lit(epoch).cast("timestamp_ntz"))


def from_epoch_days(days: Column, epoch: str) -> Column:
    return from_epoch_seconds(days * 86400.0, epoch)


def hour_of_day(days: Column) -> Column:
    """Hours in the fraction of a day count."""
    return (days - F.floor(days)) * 24.0


def from_ymdh(text: Column) -> Column:
    return F.to_timestamp_ntz(F.rpad(text, 10, "0"), F.lit("yyyyMMddHH"))


def to_ymdh(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHH")


def add_hours(time: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("long"), time)


def hours_between(a: Column, b: Column) -> Column:
    """Hours from b to a."""
    return F.timestamp_diff("MICROSECOND", b, a) / 3.6e9


def in_window(time: Column, centre: Column, seconds: float) -> Column:
    return F.abs(F.timestamp_diff("MICROSECOND", centre, time)) <= F.lit(int(seconds * 1_000_000))


def julian_day(date: Column) -> Column:
    """Julian day number of a calendar date."""
    # Fixed value: the Julian day number of 1970-01-01.
    return F.unix_date(date) + 2440588


def from_julian_day(number: Column) -> Column:
    return F.date_from_unix_date((number - 2440588).cast("int"))


#: Dates from which another leap second counts, after 1972-01-01.
LEAP_DATES = "1972-07-01 1973-01-01 1974-01-01 1975-01-01 1976-01-01 1977-01-01 1978-01-01 1979-01-01 1980-01-01 1981-07-01 1982-07-01 1983-07-01 1985-07-01 1988-01-01 1990-01-01 1991-01-01 1992-07-01 1993-07-01 1994-07-01 1996-01-01 1997-07-01 1999-01-01 2006-01-01 2009-01-01 2012-07-01 2015-07-01 2017-01-01".split()
#: The epoch of atomic seconds.
TAI_EPOCH = "1993-01-01"


def tai_minus_utc(time: Column) -> Column:
    """Seconds that atomic time is ahead; 10 from 1972."""
    dates = F.lit([datetime.fromisoformat(s) for s in LEAP_DATES]).cast("array<timestamp_ntz>")
    return F.when(time.isNotNull(), F.size(F.filter(dates, lambda d: time >= d)) + 10)


def _since_epoch(day: str) -> int:
    return (date.fromisoformat(day) - date.fromisoformat(TAI_EPOCH)).days * 86400


def leap_starts() -> list[int]:
    """Atomic seconds since 1993 at which each inserted second begins; it is 23:59:60 of the day before the date."""
    before = sum(d <= TAI_EPOCH for d in LEAP_DATES)
    return [_since_epoch(d) + n - before for n, d in enumerate(LEAP_DATES)]


def utc_to_tai93(minute: Column, second: Column) -> Column:
    """Atomic seconds since 1993 of a second (0 up to 61) of a minute; 23:59:60 is the inserted second where there is one, elsewhere the next minute's first."""
    start = minute.cast("timestamp_ntz")
    ahead = tai_minus_utc(start) - (10 + sum(d <= TAI_EPOCH for d in LEAP_DATES))
    return F.timestamp_diff("SECOND", F.lit(TAI_EPOCH).cast("timestamp_ntz"), start) + ahead + second.cast("double")


def tai93_to_utc(seconds: Column) -> Column:
    """struct(minute, second) of atomic seconds since 1993: in an inserted second that is 60 and its part, in the minute that it ends."""
    starts = F.lit(leap_starts()).cast("array<long>")
    before = sum(d <= TAI_EPOCH for d in LEAP_DATES)

    def utc(tai: Column) -> Column:
        begun, over = F.size(F.filter(starts, lambda s: tai >= s)), F.size(F.filter(starts, lambda s: tai >= s + 1))
        # An inserted second that has begun and isn't over belongs to the minute before: count from the second before it.
        return let(F.struct((tai - begun + before).alias("plain"), (begun - over).alias("inserted")), clock)

    def clock(x: Column) -> Column:
        minutes = F.floor(x["plain"] / 60).cast("long")
        minute = F.timestamp_add("MINUTE", minutes, F.lit(TAI_EPOCH).cast("timestamp_ntz"))
        return F.struct(minute.alias("minute"), (x["plain"] - minutes * 60 + x["inserted"]).alias("second"))

    return F.when(seconds.isNotNull(), let(seconds, utc))


def month_weights(date: Column) -> tuple[Column, Column, Column, Column]:
    """Month and next month, with their weights: linear through the month from its first day."""
    month = F.month(date)
    after = (F.dayofmonth(date) - 1) / F.dayofmonth(F.last_day(date))
    return month, F.pmod(month, F.lit(12)) + 1, 1.0 - after, after


def obs_file_name(slot: Column, member: Column) -> Column:
    return F.concat(F.lit("obs"), F.lpad(slot.cast("string"), 2, "0"), F.lpad(member.cast("string"), 3, "0"), F.lit(".dat"))
