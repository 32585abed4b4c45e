"""Calendar parts of a timestamp as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekdays count Monday = 1 to Sunday = 7; the weekend is Saturday and Sunday.
DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "day_of_week": lambda t: (F.weekday(t) + 1).cast("int"),
    "is_weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    "day_of_month": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "week_of_year": F.weekofyear,
    "month": F.month,
    "quarter": F.quarter,
    "year": F.year,
    "hour": F.hour,
    "minute": F.minute,
    "second": lambda t: F.second(t).cast("int"),
}

# Other accepted spellings of the same parts.
ALIASES = {
    "dayofweek": "day_of_week",
    "weekday": "day_of_week",
    "day": "day_of_month",
    "dayofmonth": "day_of_month",
    "dayofyear": "day_of_year",
    "week": "week_of_year",
    "weekofyear": "week_of_year",
}


def canonical_part(name: str) -> str:
    part = ALIASES.get(name, name)
    if part not in DATE_PARTS:
        raise ValueError(f"unknown date part {name!r}; use one of {sorted(DATE_PARTS)}")
    return part


def date_part(ts: Column, name: str) -> Column:
    return DATE_PARTS[canonical_part(name)](ts)
