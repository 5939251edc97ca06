"""Documents to packed training windows, stage by stage.

Each stage gets the documents that the one before kept, in the columns of
``documents``, and hands on what it keeps in the same columns; the last one returns
the pieces of documents with the windows they are packed into.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxboard.llm.common import delete_table, documents
from voxboard.llm.decontaminate import decontaminate
from voxboard.llm.language_id import fit_language_models, labelled_documents, language_id
from voxboard.llm.line_dedup import line_dedup
from voxboard.llm.near_copies import without_near_copies
from voxboard.llm.packing import pack
from voxboard.session import ensure_checkpoint_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those that the operator rejects go."""
    models = fit_language_models(labelled_documents(docs))
    return language_id(docs, models).filter(~F.col("rejected")).select(*docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of many documents stay in one of them; ``n_chars`` follows the text."""
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that share 0.8 of their five-word shingles, that of the smallest id.

    Candidates come from SimHash components and, as bits miss many, from MinHash bands.
    """
    return without_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the window (``bin``) that each lies in."""
    return pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_shared_lines),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The first stage fits a model and the last one searches bins, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again.

    What a stage has read is deleted when it is written, but for the documents themselves.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if place:
            delete_table(spark, f"{folder}/{place - 1}-{STAGES[place - 1][0]}")
        docs = spark.read.parquet(path)
    return docs
