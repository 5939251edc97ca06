"""Where a plan keeps a table that several later steps read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from voxboard.session import ensure_checkpoint_dir

Stage = Callable[[DataFrame, str], DataFrame]


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Keep on the executors; lost blocks are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def written_to(folder: str) -> Stage:
    """Write each table to a shared folder and read it back: no lineage, no loss."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)

    return stage


def shared(spark: SparkSession) -> Stage:
    """A folder of its own under the session's checkpoint folder.

    Later steps read back only the columns they need, a lost executor costs
    nothing that was written, and plans start from a scan again.
    """
    return written_to(f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}")


def inline(df: DataFrame, name: str) -> DataFrame:
    """Keep nothing; every reader computes the table itself."""
    return df
