"""Report artifacts: theme and gate tables, and the append-only run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.model import RUN_SCHEMA
from voxboard.sources.manifest import CommittedTable


def write_partitioned(df: DataFrame, path: str, keys: list[str], fmt: str = "json", mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*keys).format(fmt).save(path)


def write_gates(df: DataFrame, path: str, keys: list[str] = ("week_key",)) -> None:
    write_partitioned(df, path, list(keys))


def write_themes_report(df: DataFrame, path: str, keys: list[str] = ("week_key",)) -> None:
    write_partitioned(df, path, list(keys))


def run_rows(df: DataFrame) -> DataFrame:
    """Rows as the ledger keeps them; columns that are not there are null."""
    columns = []
    for field in RUN_SCHEMA.fields:
        c = F.col(field.name) if field.name in df.columns else F.lit(None)
        columns.append(c.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def run_ledger(spark: SparkSession, path: str) -> CommittedTable:
    """The run ledger: batches are seen whole or not at all, and any earlier state can be read."""
    return CommittedTable(spark, path, T.StructType(RUN_SCHEMA.fields))


def append_run(df: DataFrame, path: str, writer: str = "job", batch: int | None = None) -> bool:
    """Add run rows to the ledger; earlier rows are never rewritten.

    With a ``batch`` number the rows are added once, however often they are sent.
    """
    ledger = run_ledger(df.sparkSession, path)
    number = ledger.manifest().batches.get(writer, -1) + 1 if batch is None else batch
    return ledger.commit(run_rows(df), writer, number)


def read_runs(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The ledger, now or as of a version; an empty one if none was written yet."""
    return run_ledger(spark, path).read(version)


def write_snapshot(spark: SparkSession, path: str, folder: str) -> str:
    """Copy the ledger's last state as JSON lines, under the name of its version."""
    ledger = run_ledger(spark, path)
    now = ledger.manifest()
    name = f"version={now.version:012d}"
    ledger.read(now.version).write.mode("overwrite").json(f"{folder}/{name}")
    return name


def read_snapshot(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A snapshot by name, or the latest one that was written to its end."""
    if name is None:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [str(s.getPath().getName()) for s in fs.listStatus(hpath)]
        ended = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        name = max(ended)
    return spark.read.schema(T.StructType(RUN_SCHEMA.fields)).json(f"{folder}/{name}")
