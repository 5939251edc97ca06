"""Scans of text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table that is one file no larger than a split.

    Such a file is mostly one row group, hence one task, and the expressions on
    review texts cost far more than moving the rows. No more than one split is ever
    moved; tables of several files, or larger ones, come back as they are, however
    many cores there are.
    """
    files = [] if df.isStreaming else df.inputFiles()
    if len(files) != 1:
        return df
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.getLen() > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
