"""The cleaned corpus: read it back, write it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.functions.dates import iso_week_key
from voxboard.model import PII_COLUMNS, REVIEW_COLUMNS, REVIEW_SCHEMA
from voxboard.sources.raw import scan_json


def assert_no_pii_columns(df: DataFrame) -> DataFrame:
    leaked = sorted(set(df.columns) & set(PII_COLUMNS))
    if leaked:
        raise ValueError(f"cleaned table retains personal columns: {leaked}")
    return df


def keep_columns(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Only the review columns, and named keys, in fixed order."""
    wanted = [c for c in [*extra, *REVIEW_COLUMNS] if c in df.columns and c not in PII_COLUMNS]
    return df.select(*wanted)


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).alias(name)


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def table_format(spark: SparkSession, path: str) -> str:
    """Format of a file or table folder, by the suffixes of the files in it."""
    files = [f.lower() for f in spark.read.format("binaryFile").load(path).inputFiles()]
    kinds = {k for k in ("parquet", "csv", "json") for f in files if f.endswith(f".{k}") or f".{k}." in f}
    if len(kinds) != 1:
        raise ValueError(f"format of {path} is unclear ({sorted(kinds)}); name it")
    return kinds.pop()


def scan_clean(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = False) -> DataFrame:
    """Cleaned reviews from parquet, CSV or JSON lines; malformed input is an error.

    ``fmt`` names the format, else the files tell. ``multiline`` is for JSON written as
    one document, and for CSV texts with line breaks.
    """
    fmt = fmt or table_format(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in REVIEW_COLUMNS])
    many = str(multiline).lower()
    if fmt == "csv":
        raw = (
            spark.read.schema(text)
            .option("header", "true")
            .option("escape", '"')
            .option("mode", "FAILFAST")
            .option("multiLine", many)
            .csv(path)
        )
        return raw.select(
            _blank_to_null("id"),
            F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("play")).alias("source"),
            F.nullif(F.col("rating"), F.lit("")).try_cast("double").alias("rating"),
            _blank_to_null("title"),
            _blank_to_null("text"),
            F.try_to_date("date", "yyyy-MM-dd").alias("date"),
            _blank_to_null("language"),
        )
    reader = spark.read.schema(REVIEW_SCHEMA).option("mode", "FAILFAST").option("multiLine", many)
    return reader.json(path).withColumn("source", F.coalesce("source", F.lit("play")))


def scan_clean_preferred(spark: SparkSession, json_path: str | None, csv_path: str | None) -> DataFrame:
    """The JSON corpus, a document or lines, if it is there, else the CSV mirror."""
    if json_path is not None and _exists(spark, json_path):
        files = list(spark.read.format("binaryFile").load(json_path).inputFiles())
        found = scan_json(spark, files, schema=REVIEW_SCHEMA, mode="FAILFAST")
        return found.select(*REVIEW_COLUMNS).withColumn("source", F.coalesce("source", F.lit("play")))
    if csv_path is not None and _exists(spark, csv_path):
        return scan_clean(spark, csv_path, "csv", multiline=True)
    raise FileNotFoundError(f"no cleaned corpus at {json_path} or {csv_path}")


def write_clean(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Partitioned by product and week; the rebalance hint evens out hot weeks.

    Overwriting replaces the weeks that are written and leaves all others as they are.
    """
    assert_no_pii_columns(df)
    keys = [k for k in ("product_id", "week_key") if k in df.columns]
    if "product_id" in keys and "week_key" not in keys:
        df = df.withColumn("week_key", iso_week_key(F.col("date")))
        keys.append("week_key")
    out = keep_columns(df, keys)
    if keys:
        out.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*keys).format(fmt).save(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV mirror in fixed column order, nulls as blanks."""
    (
        keep_columns(df)
        .write.mode(mode)
        .option("header", "true")
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )
