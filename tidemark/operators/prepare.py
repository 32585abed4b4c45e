"""Applying preparation steps and named operations to a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.columns import col, is_non_negative_name
from tidemark.operators import aggregate as agg
from tidemark.operators import fill, project
from tidemark.operators.profile import PreparationStep

Operation = Callable[..., DataFrame]


def apply_preparation(
    df: DataFrame,
    steps: Sequence[PreparationStep],
    datetime_column: str,
    target: str,
    frequency: str | None = None,
    keys: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    strategy: str = "banded",
) -> DataFrame:
    """Fold the enabled steps into one plan, in the given order.

    Filling by position needs a total order: name tiebreak columns when times repeat.
    """
    deduplicated = False
    for step in steps:
        if not step.enabled or step.choice in ("skip", "keep", "continue"):
            continue
        if step.id == "fill_missing":
            method = {"forward_fill": "ffill"}.get(step.choice, step.choice)
            df = fill.fill_missing(df, target, method, [datetime_column, *tiebreak], keys, strategy=strategy)
        elif step.id == "handle_outliers":
            df = project.handle_outliers(df, target, step.choice, keys, strategy=strategy)
        elif step.id == "handle_duplicates":
            if step.choice == "aggregate_mean":
                df = agg.dedup_mean(df, datetime_column, keys)
            else:
                df = agg.keep_last(df, datetime_column, tiebreak[0], keys)
            deduplicated = True
        elif step.id == "fix_frequency":
            if not frequency:
                raise ValueError("fix_frequency needs a frequency")
            if not deduplicated:
                df = agg.dedup_mean(df, datetime_column, keys)
            df = fill.fix_frequency(df, datetime_column, frequency, keys, step.choice, strategy)
        else:
            raise ValueError(f"unknown preparation step {step.id!r}")
    return df


def auto_clip(df: DataFrame, target: str) -> DataFrame:
    """Negative values of a measure that cannot be negative by its name become 0."""
    return project.clip_negative(df, target) if is_non_negative_name(target) else df


def observed(df: DataFrame, name: str, target: str) -> tuple[DataFrame, Observation]:
    """Count rows and nulls of ``df`` while some later action reads it; no extra job."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(col(target).isNull()).alias("missing")), seen


OPERATIONS: dict[str, Operation] = {
    "combine_datetime": project.combine_datetime,
    "add_column": project.add_column,
    "normalize": project.normalize,
    "aggregate": agg.aggregate,
    "resample": agg.resample,
    "pre_aggregate": agg.pre_aggregate,
    "drop_column": lambda df, column: project.drop_columns(df, column),
    "drop_columns": project.drop_columns,
    "rename_column": lambda df, old_name, new_name: project.rename_columns(df, {old_name: new_name}),
    "rename_columns": project.rename_columns,
    "cast_types": project.cast_types,
    "filter": project.filter_rows,
    "sort": project.sort_rows,
    "fill_missing": fill.fill_missing,
    "drop_missing": project.drop_missing,
    "filter_date_range": project.filter_date_range,
    "clip_negative": project.clip_negative,
}

# Parameters that name a new column rather than an existing one.
OUTPUT_PARAMETERS = ("output_column", "column_name", "new_name")


@dataclass(frozen=True)
class OperationResult:
    success: bool
    message: str
    df: DataFrame


def register_operation(name: str, operation: Operation) -> None:
    """Make a ``DataFrame -> DataFrame`` function available by name."""
    OPERATIONS[name] = operation


def input_columns(params: Mapping[str, object]) -> list[str]:
    names = [
        v
        for k, v in params.items()
        if "column" in k and k not in OUTPUT_PARAMETERS and isinstance(v, str) and v != "__all__"
    ]
    if isinstance(params.get("old_name"), str):
        names.append(params["old_name"])  # type: ignore[arg-type]
    return names


def execute_operation(df: DataFrame, name: str, params: Mapping[str, object]) -> OperationResult:
    """Run one named operation; failures come back as a message with the table unchanged."""
    if name not in OPERATIONS:
        return OperationResult(False, f"unknown operation {name!r}; available: {sorted(OPERATIONS)}", df)
    missing = [c for c in input_columns(params) if c not in df.columns]
    if missing:
        return OperationResult(False, f"columns not found: {missing}", df)
    try:
        out = OPERATIONS[name](df, **params)
        out.schema  # resolve the plan now, so that a bad expression is reported here
    except Exception as error:
        return OperationResult(False, f"{name} failed: {error}", df)
    return OperationResult(True, f"{name} applied", out)


def apply_operations(df: DataFrame, operations: Sequence[tuple[str, Mapping[str, object]]]) -> DataFrame:
    """A list of operations as one plan; the first failure raises."""
    for name, params in operations:
        result = execute_operation(df, name, params)
        if not result.success:
            raise ValueError(result.message)
        df = result.df
    return df


def apply_linked(
    name: str, params: Mapping[str, object], df: DataFrame, linked: Mapping[str, DataFrame]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The same operation on a table and on every linked table that has its input columns."""
    main = apply_operations(df, [(name, params)])
    needed = set(input_columns(params))
    changed = {
        key: apply_operations(table, [(name, params)]) if needed <= set(table.columns) else table
        for key, table in linked.items()
    }
    return main, changed
