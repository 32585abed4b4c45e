"""Database sources through Spark's JDBC reader."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import check_identifier, quoted_table
from tidemark.operators.aggregate import pre_aggregate

# The schemas a table listing leaves out.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


@dataclass(frozen=True)
class JdbcSource:
    """A table or query, with an optional column to read it in parallel slices."""

    url: str
    table: str | None = None
    query: str | None = None
    row_limit: int | None = None
    partition_column: str | None = None
    lower_bound: str | int | None = None
    upper_bound: str | int | None = None
    num_partitions: int | None = None
    pre_aggregate: Mapping[str, object] | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def relation(self) -> str:
        """What goes in ``dbtable``: the quoted table, or the query as a sub-select."""
        if self.query and self.query.strip():
            return f"({self.query.strip().rstrip(';')}) AS source"
        if not self.table:
            raise ValueError("give a table or a query")
        return quoted_table(self.table)

    def reader_options(self) -> dict[str, str]:
        out = {"url": self.url, "dbtable": self.relation(), **self.options}
        if self.partition_column:
            if None in (self.lower_bound, self.upper_bound, self.num_partitions):
                raise ValueError("a parallel read needs lower_bound, upper_bound and num_partitions")
            out.update(
                partitionColumn=check_identifier(self.partition_column),
                lowerBound=str(self.lower_bound),
                upperBound=str(self.upper_bound),
                numPartitions=str(self.num_partitions),
            )
        return out


def read_jdbc(spark: SparkSession, source: JdbcSource) -> DataFrame:
    """Scan, then the calendar roll-up if any, then the row limit if one is given.

    Filters, column pruning and the limit are pushed to the database by Spark.
    """
    return shape(spark.read.format("jdbc").options(**source.reader_options()).load(), source)


def shape(df: DataFrame, source: JdbcSource) -> DataFrame:
    """The roll-up and row limit of a source, apart from where its rows come from."""
    if source.pre_aggregate:
        df = pre_aggregate(df, **source.pre_aggregate)  # type: ignore[arg-type]
    return df.limit(source.row_limit) if source.row_limit and source.row_limit > 0 else df


def list_tables(tables: DataFrame, system_schemas: Sequence[str] = SYSTEM_SCHEMAS) -> DataFrame:
    """``schema.table`` of the base tables in an ``information_schema.tables`` frame, ordered."""
    kept = tables.where((F.col("table_type") == "BASE TABLE") & ~F.col("table_schema").isin(*system_schemas))
    name = F.concat("table_schema", F.lit("."), "table_name").alias("table")
    return kept.orderBy("table_schema", "table_name").select(name)


def read_table_list(spark: SparkSession, url: str, options: Mapping[str, str] | None = None) -> DataFrame:
    source = JdbcSource(
        url, query="SELECT table_schema, table_name, table_type FROM information_schema.tables",
        row_limit=None, options=options or {},
    )
    return list_tables(read_jdbc(spark, source))
