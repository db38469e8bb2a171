"""Scalars of local calendars: dates, boundaries, labels and slugs of epoch seconds, all built-in functions."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions import flow_columns as C

#: Forms of a local time in a configuration (fixed values).
TIME_FORMS = ("%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S")
_DATE = r"^\d{4}-\d{2}-\d{2}$"


def local(seconds: Column, tz: str = C.TIMEZONE) -> Column:
    """The local wall clock of epoch seconds."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), C.clock(seconds))


def day_start(day: Column, tz: str = C.TIMEZONE) -> Column:
    """Epoch seconds of a date's local midnight."""
    return C.epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), day.cast("timestamp_ntz")))


def day_starts(day: Column, tz: str = C.TIMEZONE) -> Column:
    """The starts of all 5-minute buckets of a local day: 288, on days that change the clock 276 or 300."""
    return F.sequence(day_start(day, tz), day_start(F.date_add(day, 1), tz) - 300, F.lit(300).cast("long"))


def date_range(text: Column, is_end: bool = False, tz: str = C.TIMEZONE) -> Column:
    """Epoch seconds of a YYYY-MM-DD, of the next day's start if it is an end; 0 for other texts."""
    day = F.when(text.rlike(_DATE), text).try_cast("date")
    return F.coalesce(day_start(F.date_add(day, 1) if is_end else day, tz), F.lit(0).cast("long"))


def boundary(text: Column, tz: str = C.TIMEZONE) -> Column:
    """Epoch seconds of digits, of an ISO time with an offset, or of a local date or time; null for other texts."""
    clean = F.trim(text)
    zoned = clean.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?(Z|[+-]\d{2}:\d{2})$")
    plain = clean.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$")
    wall = F.when(plain, F.regexp_replace(clean, "T", " ")).try_cast("timestamp_ntz")
    return (
        F.when(clean.rlike(r"^-?\d+$"), clean.try_cast("long"))
        .when(zoned, F.unix_seconds(F.when(zoned, F.regexp_replace(clean, r"([T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")).try_cast("timestamp")))
        .otherwise(C.epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)))
    )


def components(seconds: Column, tz: str = C.TIMEZONE) -> Column:
    """year, month, day, hours, minutes, seconds and day_of_week (0 is Sunday) of the local clock."""
    at = local(seconds, tz)
    parts = (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hours", F.hour), ("minutes", F.minute), ("seconds", F.second))
    return F.struct(*[f(at).cast("int").alias(n) for n, f in parts], (F.dayofweek(at) - 1).alias("day_of_week"))


def label(seconds: Column, granularity: str, tz: str = C.TIMEZONE) -> Column:
    """A chart label: the date, and the time below a day."""
    return F.date_format(local(seconds, tz), "yyyy-MM-dd" if granularity == "1d" else "yyyy-MM-dd HH:mm")


def tick(seconds: Column, granularity: str, tz: str = C.TIMEZONE) -> Column:
    """A day axis names Mondays only; finer ones have the label's time."""
    at = local(seconds, tz)
    if granularity != "1d":
        return F.date_format(at, "MM/dd HH:mm")
    return F.when(F.dayofweek(at) == 2, F.concat(F.lit("Mon "), F.date_format(at, "MM/dd"))).otherwise("")


def slug(seconds: Column, tz: str = C.TIMEZONE) -> Column:
    """The local time as YYYYMMDDHHmm, as in a capture's name."""
    return F.date_format(local(seconds, tz), "yyyyMMddHHmm")


def slug_start(text: Column, tz: str = C.TIMEZONE) -> Column:
    """Epoch seconds of a slug (of a repeated hour the first), null for other texts."""
    form = F.when(text.rlike(r"^\d{12}$"), F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:00"))
    return C.epoch_of(F.convert_timezone(F.lit(tz), F.lit("UTC"), form.try_cast("timestamp_ntz")))


def parse_time(text: str | None, tz: str = C.TIMEZONE) -> int | None:
    """Epoch seconds of a configuration's local time; none for a blank, an error for other texts."""
    if text in (None, ""):
        return None
    for form in TIME_FORMS:
        try:
            return int(dt.datetime.strptime(text, form).replace(tzinfo=ZoneInfo(tz)).timestamp())
        except ValueError:
            continue
    raise ValueError(f"invalid time {text!r}")


def midnight(day: dt.date, tz: str = C.TIMEZONE) -> int:
    return int(dt.datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(tz)).timestamp())


def whole_window(first: dt.date, last: dt.date, start: int | None = None, end: int | None = None, tz: str = C.TIMEZONE) -> tuple[int, int]:
    """The half-open window of the dates, cut to start and end, which have to stand on 30-minute, hour and day boundaries
    inside it: coarse buckets are whole or absent."""
    low, high = midnight(first, tz), midnight(last + dt.timedelta(days=1), tz)
    for name, value in (("start", start), ("end", end)):
        if value is not None and value != midnight(dt.datetime.fromtimestamp(value, ZoneInfo(tz)).date(), tz):
            raise ValueError(f"{name} must stand on a 30m, 1h and 1d boundary")
    out = (low if start is None else start, high if end is None else end)
    if out[0] < low or out[1] > high or out[0] >= out[1]:
        raise ValueError("the window must be inside the dates and not empty")
    return out


#: Days before and after a clicked point, and the finer granularity, by the granularity clicked (fixed values).
DRILL = {"1d": (15, 16, "1h"), "1h": (3, 4, "30m"), "30m": (0, 1, "5m")}


def drill_down(granularity: str, seconds: Column, tz: str = C.TIMEZONE) -> tuple[str, Column, Column]:
    """The finer granularity with the first and last date of the window around a point."""
    before, after, finer = DRILL[granularity]
    day = lambda s: F.date_format(local(s, tz), "yyyy-MM-dd")
    return finer, day(seconds - before * 86_400), day(seconds + after * 86_400)
