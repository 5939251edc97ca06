"""Exports as they land: normalised, without copies, without late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.model import MAX_WEEKS
from voxboard.operators.intake import normalise
from voxboard.operators.sampling import fingerprint

LATENESS = f"{MAX_WEEKS * 7} days"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Twelve weeks of fingerprints do not belong on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_raw(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    max_files: int | None = None,
    fmt: str = "json",
    sep: str = ",",
) -> DataFrame:
    """Exports landing in a folder: JSON lines, or ``csv`` files with a header line.

    A stream reads a file in splits at its lines, so texts of landed CSV files have no
    line breaks; exports that have them go through ``scan_csv``. Lines that are no row of
    ``schema`` come with all of them in ``_corrupt_record``, if the schema has that column.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        return reader.option("header", "true").option("sep", sep).option("escape", '"').csv(folder)
    return reader.json(folder)


def stream_reviews(raw: DataFrame, product_id: str | None = None) -> DataFrame:
    """Usable reviews with the event time the watermark runs on."""
    rows = normalise(raw, product_id)
    return rows.withColumn("ts", F.col("date").cast("timestamp"))


def with_lateness(reviews: DataFrame, delay: str = LATENESS) -> DataFrame:
    return reviews.withWatermark("ts", delay)


def fingerprinted(reviews: DataFrame, delay: str) -> DataFrame:
    return with_lateness(reviews, delay).withColumn(
        "fp", F.unhex(fingerprint(F.col("date"), F.col("rating"), F.col("text")))
    )


def content_id() -> Column:
    return F.concat(F.lit("play-"), F.lower(F.substring(F.hex("fp"), 1, 16)))


def stream_dedupe(reviews: DataFrame, delay: str = LATENESS) -> DataFrame:
    """One copy of each review within the widest window, whichever comes first in time.

    The state holds 32-byte fingerprints, not texts. Where the copy that stands first in
    the files must win, ``stream_first_copies`` keeps it.
    """
    kept = fingerprinted(reviews, delay).dropDuplicatesWithinWatermark(["product_id", "fp"])
    return kept.withColumn("id", content_id()).drop("fp")


def stream_first_copies(
    reviews: DataFrame, order: list[str], keep: list[str], delay: str = LATENESS
) -> DataFrame:
    """Of each review's copies the one that stands first in the files, batch after batch.

    Copies differ in title and language only, so the state of a fingerprint is the least
    (``order``, ``keep``) struct so far. In update mode a row goes out when a review is new
    and again when an earlier copy turns up; ``first_copies`` reads the last word. Copies
    share their date, hence their event time, and the state goes when the watermark
    passes it. A hot fingerprint is a minimum, combined before rows meet.
    """
    best = F.min(F.struct(*[F.col(c) for c in [*order, *keep]]))
    found = fingerprinted(reviews, delay).groupBy("product_id", "ts", "fp").agg(best.alias("first"))
    return found.select("product_id", F.col("ts").cast("date").alias("date"), content_id().alias("id"), "first.*")


def first_copies(updates: DataFrame, order: list[str]) -> DataFrame:
    """One row per review out of all updates: a later update only ever has an earlier copy."""
    names = [c for c in updates.columns if c not in ("product_id", "id")]
    rows = F.struct(*order, *[c for c in names if c not in order])
    best = updates.groupBy("product_id", "id").agg(F.min(rows).alias("first"))
    return best.select("product_id", "id", *[F.col(f"first.{c}") for c in names])
