"""The adaptive window from counts per day that a stream keeps up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.sources.manifest import CommittedTable


def day_schema(reviews: T.StructType, keys: list[str]) -> T.StructType:
    return T.StructType([*[reviews[k] for k in keys], T.StructField("date", T.DateType()), T.StructField("n", T.LongType())])


def day_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Reviews per group and day; counts of several batches add up."""
    return df.groupBy(*keys, "date").agg(F.count("*").alias("n"))


def count_days(table: CommittedTable, keys: list[str], writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that commits the counts of each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.commit(day_counts(batch, keys), writer, batch_id)

    return write


def merged_days(table: CommittedTable, keys: list[str], version: int | None = None) -> DataFrame:
    return table.read(version).groupBy(*keys, "date").agg(F.sum("n").alias("n"))
