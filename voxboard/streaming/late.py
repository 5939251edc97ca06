"""Rows behind the watermark, kept and told apart instead of dropped."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.sources.manifest import CommittedTable

NOTE = "newest"


def with_lateness(schema: T.StructType) -> T.StructType:
    """``late`` says whether a row is on the wrong side, ``behind`` by how many days."""
    return T.StructType([*schema.fields, T.StructField("late", T.BooleanType()), T.StructField("behind", T.IntegerType())])


def routed(table: CommittedTable, days: int, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: all rows go to ``table``, with ``late`` and ``behind``.

    The watermark of a batch is the newest ``date`` of the batches before, less ``days``;
    it is part of their commit, so that a batch which is replayed is judged by the same
    one, and only counted once. A row is late if the last day of its ISO week is not after
    the watermark: its week has been closed. Without earlier batches nothing is late, and
    neither is a row without a date.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = table.manifest().notes.get(NOTE)
        mark = F.date_sub(F.lit(before).cast("date"), days)
        last_day = F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 6)
        behind = F.datediff(mark, last_day)
        rows = batch.withColumn("late", F.coalesce(behind >= 0, F.lit(False)))
        rows = rows.withColumn("behind", F.when(F.col("late"), behind))
        newest = batch.agg(F.max("date")).first()[0]
        known = max([dt.date.fromisoformat(before)] if before else [], default=None)
        newest = max((d for d in (known, newest) if d), default=None)
        table.commit(rows, writer, batch_id, {NOTE: str(newest)} if newest else None)

    return write


def late_table(spark: SparkSession, path: str, schema: T.StructType) -> CommittedTable:
    return CommittedTable(spark, path, with_lateness(schema))
