"""Cron schedules of six fields: second, minute, hour, day, month, weekday (0 and 7 are Sunday)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.scalars import day_in_month, next_weekday

#: Least and greatest value of each field, and the names of months and days (fixed values).
RANGES = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()


def _field(text: str, low: int, high: int, names: list[str], base: int) -> set[int]:
    def number(x: str) -> int:
        x = x.lower()
        n = names.index(x[:3]) + base if x[:3] in names else int(x)
        if not low <= n <= high:
            raise ValueError(f"{x} is out of range")
        return n

    found: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = (number(x) for x in span.split("-", 1))
        else:
            a = number(span)
            b = high if step else a
        found.update(range(a, b + 1, int(step) if step else 1))
    return found


def parse(text: str) -> list[set[int]]:
    """Values of each field; raises ValueError if the text is no schedule."""
    fields = text.split()
    if len(fields) == 5:
        fields = ["0", *fields]
    if len(fields) != 6:
        raise ValueError(f"a schedule has six fields: {text!r}")
    sets = [_field(f, *RANGES[i], MONTHS if i == 4 else DAYS if i == 5 else [], 1 if i == 4 else 0) for i, f in enumerate(fields)]
    sets[5] = {d % 7 for d in sets[5]}
    return sets


def occurrences(text: str, after: dt.datetime, before: dt.datetime) -> list[dt.datetime]:
    """Times of the schedule in (after, before]."""
    seconds, minutes, hours, days, months, weekdays = parse(text)
    out, day = [], after.replace(hour=0, minute=0, second=0, microsecond=0)
    while day <= before:
        if day.month in months and day.day in days and (day.weekday() + 1) % 7 in weekdays:
            out += [t for h in sorted(hours) for m in sorted(minutes) for s in sorted(seconds) if after < (t := day.replace(hour=h, minute=m, second=s)) <= before]
        day += dt.timedelta(days=1)
    return out


#: Schedule of a task started by hand: a time far off, in seven fields (fixed value).
NEVER = "0 0 0 1 1 ? 2099"


def schedule_cron(schedule_type: Column | str, minute: Column, hour: Column, weekday: Column, day_of_month: Column, today: Column | None = None, zone: str = "UTC") -> Column:
    """Schedule in UTC of a task's settings, which are in local time of ``zone``.

    The local time of the first day from ``today`` on that the settings name is brought into UTC, and
    its minute, hour, weekday or day of the month make the schedule, so all of them may shift. ``weekday``
    counts from Monday as 0; a day beyond the month is its last. Other kinds give null.
    """
    kind = F.col(schedule_type) if isinstance(schedule_type, str) else schedule_type
    day = F.lit(dt.date(2024, 1, 1)) if today is None else today
    day = F.when(kind == "Weekly", next_weekday(day, weekday)).when(kind == "Monthly", day_in_month(day, day_of_month)).otherwise(day)
    local = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    shifted = kind.isin("Daily", "Weekly", "Monthly")
    minute, hour = F.when(shifted, F.minute(utc)).otherwise(minute), F.hour(utc)
    weekday, day_of_month = F.dayofweek(utc) - 1, F.day(utc)

    def text(*parts: Column | str) -> Column:
        return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    return (
        F.when(kind == "Hourly", text("0", minute, "* * * *"))
        .when(kind == "Daily", text("0", minute, hour, "* * *"))
        .when(kind == "Weekly", text("0", minute, hour, "* *", weekday))
        .when(kind == "Monthly", text("0", minute, hour, day_of_month, "* *"))
        .when(kind == "Manual", NEVER)
    )


def expand(schedules: DataFrame, after: dt.datetime, before: dt.datetime) -> DataFrame:
    """(name, slot) of each time in (after, before] of (name, cron); unreadable schedules give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, text in zip(pdf["name"], pdf["cron"], strict=True):
                try:
                    rows += [(name, t) for t in occurrences(text, after, before)]
                except (ValueError, AttributeError):
                    continue
            yield pd.DataFrame(rows, columns=["name", "slot"]).astype({"slot": "datetime64[us]"})

    return schedules.select("name", "cron").mapInPandas(run, "name string, slot timestamp_ntz")
