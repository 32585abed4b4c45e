"""Column roles, identifiers and typed literals (driver-side, no Spark job)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain identifiers accepted in table and column names of a JDBC read.
IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")

# Name fragments that mark a non-negative measure.
NON_NEGATIVE_NAMES = ("count", "quantity", "volume", "sales", "revenue", "price", "amount")


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_temporal(f.dataType)]


def is_non_negative_name(name: str, words: Sequence[str] = NON_NEGATIVE_NAMES) -> bool:
    return any(word in name.lower() for word in words)


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return name


def quoted_table(name: str) -> str:
    """``table`` or ``schema.table`` as a quoted SQL identifier."""
    parts = name.strip().split(".", 1)
    return ".".join(f'"{check_identifier(p)}"' for p in parts)


def unique_id(columns: Sequence[str]) -> Column:
    """Readable series label; null when any part is null. Never used as a grouping key."""
    parts: list[Column] = []
    for i, name in enumerate(columns):
        if i:
            parts.append(F.lit("_"))
        parts.append(col(name).cast("string"))
    return F.concat(*parts)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def parse_bound(value: str | date | datetime) -> datetime:
    """ISO text (``Z`` allowed), date or datetime to a naive UTC datetime."""
    if isinstance(value, str):
        text = value.strip()
        value = datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    if not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return value


def typed_literal(df: DataFrame, column: str, value: object) -> Column:
    """A literal of the column's own type, so that a comparison reaches the scan."""
    data_type = df.schema[column].dataType
    if value is None:
        return F.lit(None).cast(data_type)
    if is_numeric(data_type):
        if isinstance(value, str):
            number = float(value)
            value = int(number) if number.is_integer() and "." not in value else number
        if isinstance(data_type, T.IntegralType) and isinstance(value, float):
            return F.lit(value)
        return F.lit(value).cast(data_type)
    if isinstance(data_type, T.DateType) and not isinstance(value, bool):
        bound = parse_bound(value)  # type: ignore[arg-type]
        if bound.time() != datetime.min.time():
            return F.lit(str(bound)).cast("timestamp_ntz")
        return F.lit(str(bound.date())).cast("date")
    if is_temporal(data_type):
        return F.lit(str(parse_bound(value))).cast(data_type)  # type: ignore[arg-type]
    if isinstance(data_type, T.BooleanType):
        return F.lit(str(value).lower() == "true")
    return F.lit(str(value)).cast(data_type)
