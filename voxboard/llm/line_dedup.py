"""Drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import BLANKS, keyed, lowered, same_document, stage, with_columns
from voxboard.operators.barrier import compute_once

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 16


def long_lines(base: DataFrame, min_chars: int) -> DataFrame:
    """Hashed key (128 bits), document and position of every line that may go."""
    lines = base.select("id", "body", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    bare = lines.withColumn("line", F.btrim("line", F.lit(BLANKS)))
    key = lowered(F.col("line"))
    return bare.filter(F.length("line") >= min_chars).select(
        "id", "body", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")
    )


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in enough documents, with the largest id among them.

    A key is counted once per document before its documents meet, and both steps
    combine in the tasks that read the lines, so a line that a third of all
    documents hold sends one row per task.
    """
    once = lines.select("h1", "h2", "id").distinct()
    found = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    return found.filter(F.col("n") >= min_docs).drop("n")


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """The documents with shared lines taken out of ``text``.

    Lines end at ``\\n``. A line's key is the line without blanks at both ends, with
    A-Z in lower case. Keys of at least ``min_chars`` code points that occur in at
    least ``min_docs`` documents lose all their lines, but for those in the largest
    doc_id that holds the key. Adds ``n_lines`` (before dropping), ``n_dropped`` and
    ``dropped`` (positions from 0). Columns of these names are replaced.

    A null text is one empty line and becomes an empty text. Rows of one doc_id count
    as one document; all of them keep the lines of the keeper. Null ids count as one
    document, smaller than all others. Empty tables give empty results.
    """
    base = keyed(docs)
    lines = stage(long_lines(base, min_chars), "lines")
    # Documents that hold a common line are dealt to SALTS tasks, each with the key.
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = (
        salted.join(shared_lines(lines, min_docs).select("*", salts), ["h1", "h2", "salt"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "body")
        .agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    )
    joined = base.alias("l").join(hits.alias("r"), same_document(), "left").select("l.*", "r.dropped")
    parts = compute_once(joined, {"parts": F.split("text", "\n", -1)})
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped"))
    kept = F.when(
        F.col("dropped").isNotNull(),
        F.array_join(F.transform(places, lambda i: F.col("parts")[i]), "\n"),
    ).otherwise(F.col("text"))
    gone = F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    return with_columns(
        parts,
        docs,
        {
            "text": kept,
            "n_lines": F.size("parts").cast("long"),
            "n_dropped": F.size(gone).cast("long"),
            "dropped": gone,
        },
    )
