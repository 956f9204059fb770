"""Relational source tables over JDBC."""

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class JdbcTable:
    """Where a table lives and how to split its read.

    A read is split by ``num_partitions`` ranges of ``partition_column`` or by a list of ``predicates``. Bounds only place the
    splits, rows outside them are read too; bounds not given are asked of the database. A table that one task may read says
    so by ``one_task``.
    """

    url: str
    table: str
    fetch_size: int = 10_000
    partition_column: str | None = None
    lower_bound: str | None = None
    upper_bound: str | None = None
    num_partitions: int = 32
    predicates: tuple[str, ...] = ()
    one_task: bool = False
    custom_schema: str | None = None
    properties: dict = field(default_factory=dict)

    def connection(self) -> dict[str, str]:
        opts = {"url": self.url, "fetchsize": str(self.fetch_size), **self.properties}
        return opts | ({"customSchema": self.custom_schema} if self.custom_schema else {})

    def bounds_query(self) -> str:
        """One row with the least and the greatest value of the partition column."""
        return f"SELECT MIN({self.partition_column}) AS lo, MAX({self.partition_column}) AS hi FROM {self.table}"

    def with_bounds(self, low: object, high: object) -> "JdbcTable":
        """The same read with bounds; a table without values is left to one task, as it has nothing to split."""
        if low is None or high is None:
            return replace(self, partition_column=None, one_task=True)
        return replace(self, lower_bound=str(low), upper_bound=str(high))

    def options(self) -> dict[str, str]:
        if self.partition_column and self.predicates:
            raise ValueError("a read is split by a partition column or by predicates, not by both")
        if not (self.partition_column or self.predicates or self.one_task):
            raise ValueError(f"{self.table} would be read by one task: name a partition_column or predicates, or set one_task")
        opts = self.connection() | {"dbtable": self.table}
        if self.partition_column:
            if self.lower_bound is None or self.upper_bound is None:
                raise ValueError("partition_column needs lower_bound and upper_bound")
            opts.update(
                partitionColumn=self.partition_column,
                lowerBound=str(self.lower_bound),
                upperBound=str(self.upper_bound),
                numPartitions=str(self.num_partitions),
            )
        return opts


def quantile_predicates(column: str, cuts: list) -> tuple[str, ...]:
    """Predicates of the ranges between cut values; together they take every row once, also rows without a value.

    Cuts at quantiles of a skewed column give tasks of like size, which equal ranges would not.
    """
    values = sorted(set(cuts))
    if not values:
        return ("1 = 1",)
    quoted = [f"'{str(v).replace(chr(39), chr(39) * 2)}'" if isinstance(v, (str, dt.date)) else str(v) for v in values]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return (f"{column} < {quoted[0]} OR {column} IS NULL", *between, f"{column} >= {quoted[-1]}")


def read_jdbc(spark: SparkSession, source: JdbcTable) -> DataFrame:
    """Filters and column choices made on the frame are pushed into the database query."""
    if source.partition_column and source.lower_bound is None and source.upper_bound is None:
        row = spark.read.format("jdbc").options(**source.connection()).option("query", source.bounds_query()).load().first()
        source = source.with_bounds(row[0], row[1])
    options = source.options()
    if source.predicates:
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(source.url, source.table, predicates=list(source.predicates), properties=properties)
    return spark.read.format("jdbc").options(**options).load()
