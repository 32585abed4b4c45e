"""One frequency table: code -> calendar unit, bucket start, next periods, inference."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency letters and the calendar unit each stands for.
UNITS = {
    "S": "second",
    "SEC": "second",
    "T": "minute",
    "MIN": "minute",
    "H": "hour",
    "D": "day",
    "W": "week",
    "M": "month",
    "MS": "month",
    "MO": "month",
    "Q": "quarter",
    "Y": "year",
}

# Length of the units that have one, in seconds.
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}

# Months per calendar unit without a fixed length.
MONTHS = {"month": 1, "quarter": 3, "year": 12}


@dataclass(frozen=True)
class Frequency:
    n: int
    unit: str

    @property
    def is_fixed(self) -> bool:
        return self.unit in SECONDS

    @property
    def seconds(self) -> int:
        return self.n * SECONDS[self.unit]

    @property
    def months(self) -> int:
        return self.n * MONTHS[self.unit]

    @property
    def periods_per_day(self) -> int:
        if self.is_fixed and self.seconds < SECONDS["day"]:
            return max(1, SECONDS["day"] // self.seconds)
        return 1


def parse_frequency(code: str | None, strict: bool = False) -> Frequency:
    """``D``, ``h``, ``15min``, ``30s``, ``2H``, ``MS``; unknown codes mean one day.

    A lower-case ``m`` after a number is minutes, an upper-case ``M`` months.
    """
    text = (code or "D").strip()
    match = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", text)
    if match:
        count = int(match.group(1) or 1)
        letters = match.group(2)
        if letters == "m" and match.group(1):
            return Frequency(max(1, count), "minute")
        unit = UNITS.get(letters.upper())
        if unit:
            return Frequency(max(1, count), unit)
    if strict:
        raise ValueError(f"unsupported frequency {code!r}; use one of {sorted(UNITS)}")
    return Frequency(1, "day")


def bucket_start(ts: Column, frequency: str | Frequency) -> Column:
    """Start of the left-closed bucket that holds ``ts``, weeks from Monday.

    Only row-level arithmetic, so it works on batch and streaming input alike.
    """
    freq = frequency if isinstance(frequency, Frequency) else parse_frequency(frequency)
    stamp = ts.cast("timestamp_ntz")
    if freq.n == 1:
        return F.date_trunc(freq.unit, stamp).cast("timestamp_ntz")
    if freq.is_fixed:
        # 1970-01-05 is the first Monday after the epoch.
        origin = "1970-01-05 00:00:00" if freq.unit == "week" else "1970-01-01 00:00:00"
        zero = F.lit(origin).cast("timestamp_ntz")
        elapsed = F.timestamp_diff("SECOND", zero, F.date_trunc("second", stamp).cast("timestamp_ntz"))
        whole = F.floor(elapsed / F.lit(freq.seconds)).cast("long") * F.lit(freq.seconds)
        return F.timestamp_add("SECOND", whole, zero)
    index = (F.year(stamp) - F.lit(1970)) * F.lit(12) + F.month(stamp) - F.lit(1)
    first = F.floor(index / F.lit(freq.months)).cast("int") * F.lit(freq.months)
    return F.timestamp_add("MONTH", first, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def shift_periods(start: Column, steps: Column, frequency: str | Frequency) -> Column:
    """The time ``steps`` periods after ``start``.

    Months keep the start itself at step 0 and then use the first of each
    following month at the same time of day.
    """
    freq = frequency if isinstance(frequency, Frequency) else parse_frequency(frequency)
    stamp = start.cast("timestamp_ntz")
    if freq.is_fixed:
        return F.timestamp_add("SECOND", (steps * F.lit(freq.seconds)).cast("long"), stamp)
    first = F.timestamp_add("DAY", F.lit(1) - F.dayofmonth(stamp), stamp)
    later = F.timestamp_add("MONTH", (steps * F.lit(freq.months)).cast("int"), first)
    return F.when(steps == 0, stamp).otherwise(later)


def frequency_code(median_seconds: Column) -> Column:
    """Frequency label from the median gap in seconds; null when it is missing or not positive."""
    day, hour, minute = 86400.0, 3600.0, 60.0
    med = median_seconds.cast("double")
    return (
        F.when(med.isNull() | (med <= 0), F.lit(None).cast("string"))
        .when(F.abs(med - minute) < 5, "T")
        .when(F.abs(med - hour) < 120, "H")
        .when(F.abs(med - day) < 1800, "D")
        .when(F.abs(med - 7 * day) < 12 * hour, "W")
        .when(med.between(25 * day, 35 * day), "M")
        .otherwise(F.concat(F.floor(med).cast("string"), F.lit("s")))
    )
