"""What several operators over documents share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.session import ensure_checkpoint_dir

BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_list(text: Column) -> Column:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def keyed(docs: DataFrame) -> DataFrame:
    """Each document under names of our own: ``in_0``, ``in_1``..., ``id``, ``text``, ``body``.

    ``text`` is never null. ``body`` is a hash of the text: with ``id`` it names a
    document by its content, so that repeated ids with different texts stay apart and
    a task that runs again makes the same keys. No column of the input can clash with
    working columns; ``with_columns`` gives the names back.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)],
        F.col("doc_id").alias("id"),
        text.alias("text"),
        F.xxhash64(text).alias("body"),
    )


def with_columns(df: DataFrame, docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` and then ``columns``, which replace those of their name."""
    taken = {c.lower() for c in columns}
    kept = [
        F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken
    ]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


def same_document(left: str = "l", right: str = "r") -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (
        F.col(f"{left}.body") == F.col(f"{right}.body")
    )


def hash_unit(*columns: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / F.lit(float(1 << 31))


def hash_share(rows: Column | int, wanted: int) -> Column:
    """Below this share of ``hash_unit`` lie ``wanted`` of so many rows, and some to spare.

    The rows with the smallest hashes are then found among these, so that no task
    sends or sorts more than its part of them.
    """
    spare = wanted + 10 * wanted**0.5
    return F.lit(spare) / F.greatest(F.lit(rows) if isinstance(rows, int) else rows, F.lit(1))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What is read later depends on files every executor can reach, so a lost
    executor costs at most the tasks it was running.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end.

    Whatever is needed of them must be staged once more outside before, or be at hand.
    """
    before = _SCRATCH.set([])
    try:
        yield
        paths = _SCRATCH.get()
    finally:
        _SCRATCH.reset(before)
    for path in paths:
        delete_table(spark, path)


def delete_table(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def append_batches(docs: DataFrame, fields: str, compute) -> DataFrame:
    """Rows of ``docs`` with the columns ``fields``, worked out batch by batch.

    ``compute`` gets the texts of a batch as bytes (null: None) and returns one Arrow
    array per field. Rows stay where they are; columns of the new names are replaced.
    """
    taken = {f.name.lower() for f in _fields(fields)}
    kept = [c for c in docs.columns if c.lower() not in taken]
    # Names of our own on the way, so that no column of the input can clash.
    given = docs.select(
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)],
        F.col("text").cast("string").cast("binary").alias("text_bytes"),
    )
    made = T.StructType([*given.drop("text_bytes").schema.fields, *_fields(fields)])
    n = len(kept)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:n] + compute([t.as_py() for t in batch.column(n)])
            yield pa.RecordBatch.from_arrays(columns, names=made.names)

    out = given.mapInArrow(run, made)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], *made.names[n:])


def _fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields
