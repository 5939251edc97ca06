"""Streaming queries, run to the end over the tables as they are."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.catalogue.adapters import (
    AS_OF,
    DOCS,
    EV,
    document_reviews,
    event_reviews,
    stream_table,
    table,
)
from voxboard.catalogue.intake import RAW, raw_documents
from voxboard.catalogue.registry import query
from voxboard.catalogue.windows import WINDOW
from voxboard.operators.windows import resolve_window
from voxboard.session import ensure_checkpoint_dir
from voxboard.sources.artifacts import append_run, read_runs, read_snapshot, run_rows, write_snapshot
from voxboard.sources.manifest import CommittedTable
from voxboard.streaming.intake import first_copies, stream_dedupe, stream_first_copies, stream_raw, stream_reviews
from voxboard.streaming.late import late_table, routed
from voxboard.streaming.upsert import ledger_upsert, runs_from_counts
from voxboard.streaming.weekly import weekly_theme_counts
from voxboard.streaming.windows import count_days, day_schema, merged_days

KEYS = ["product_id"]


def run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def week_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("date").cast("timestamp"))


@query(
    "weekly_theme_counts",
    f"""WITH {EV} SELECT product_id, week_key, CAST(date_trunc('week', date) AS DATE) AS week_start, theme_id,
       count(*) AS review_count, sum(rating) AS rating_sum, count(rating) AS rated,
       count(*) FILTER (rating <= 2) AS low_star_count FROM ev GROUP BY ALL""",
)
def weekly_counts(spark, sf):
    """Counts of a stream, kept complete in a table per micro-batch."""
    folder = run_folder(spark)
    counts = weekly_theme_counts(week_rows(event_reviews(spark, sf, stream_table(spark, sf, "events"))), delay=None)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    finish(
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(keep)
    )
    return spark.read.parquet(f"{folder}/out")


@query(
    "weekly_theme_counts_batch",
    f"""WITH {EV} SELECT product_id, week_key, CAST(date_trunc('week', date) AS DATE) AS week_start, theme_id,
       count(*) AS review_count, sum(rating) AS rating_sum, count(rating) AS rated,
       count(*) FILTER (rating <= 2) AS low_star_count FROM ev GROUP BY ALL""",
)
def weekly_counts_batch(spark, sf):
    return weekly_theme_counts(week_rows(event_reviews(spark, sf)))


@query(
    "stream_dedupe",
    f"""WITH {DOCS} SELECT DISTINCT product_id, 'play-' || substr(sha256(concat_ws('|', strftime(date, '%Y-%m-%d'),
       coalesce(CAST(rating AS VARCHAR), ''), text)), 1, 16) AS id FROM docs""",
)
def streamed_dedupe(spark, sf):
    folder = run_folder(spark)
    kept = stream_dedupe(week_rows(document_reviews(spark, sf, stream_table(spark, sf, "documents"))))
    finish(
        kept.select("product_id", "id")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .option("path", f"{folder}/out")
    )
    return spark.read.parquet(f"{folder}/out")


# Copies of a text come with the titles and languages of the documents they stand in.
@query(
    "stream_first_copies",
    f"""WITH {DOCS}, placed AS (
  SELECT *, 'title ' || (doc_id % 7) AS title, row_number() OVER (
    PARTITION BY product_id, date, rating, text ORDER BY doc_id) AS rn FROM docs)
SELECT product_id, 'play-' || substr(sha256(concat_ws('|', strftime(date, '%Y-%m-%d'),
       coalesce(CAST(rating AS VARCHAR), ''), text)), 1, 16) AS id, date, doc_id AS src_pos, title, language
FROM placed WHERE rn = 1""",
)
def first_of_copies(spark, sf):
    """The first copy in file order wins, although later ones land before it."""
    folder = run_folder(spark)
    rows = week_rows(document_reviews(spark, sf)).select(
        "product_id", "text", "rating", "date", "ts", F.col("doc_id").alias("src_pos"),
        F.concat(F.lit("title "), (F.col("doc_id") % 7).cast("string")).alias("title"), "language",
    )
    for k in (2, 1, 0):
        # The stream goes on from its checkpoint with what has landed since.
        rows.filter(F.col("src_pos") % 3 == k).write.mode("append").parquet(f"{folder}/landing")
        landed = spark.readStream.schema(rows.schema).parquet(f"{folder}/landing")
        found = stream_first_copies(landed, ["src_pos"], ["title", "language"], delay="200 days")
        run_to_end(folder, found, "update")
    return first_copies(spark.read.parquet(f"{folder}/out"), ["src_pos"])


@query(
    "stream_ledger",
    f"""WITH {EV}, c AS (
  SELECT product_id, week_key, theme_id, count(*) AS n, count(*) FILTER (rating <= 2) AS low,
         CAST(printf('%.3f', avg(rating)) AS DOUBLE) AS a, max(CAST(date_trunc('week', date) AS DATE)) AS start
  FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id, week_key
        ORDER BY low DESC, n DESC, coalesce(a, 5.0), theme_id) AS rank FROM c)
SELECT product_id, week_key, max(start) + 6 AS week_ending, CAST(sum(n) AS BIGINT) AS review_count,
       string_agg(theme_id, ',' ORDER BY rank) FILTER (rank <= 3) AS top_3
FROM r GROUP BY product_id, week_key""",
)
def stream_ledger(spark, sf):
    """Weekly runs written to a ledger by a stream.

    Every batch is sent twice, and before it one that fails after its rows are written
    and before they are committed: neither adds anything.
    """
    folder = run_folder(spark)
    upsert = ledger_upsert(f"{folder}/ledger")
    counts = weekly_theme_counts(week_rows(event_reviews(spark, sf, stream_table(spark, sf, "events"))), delay=None)

    def faulty(batch: DataFrame, batch_id: int) -> None:
        half_written(batch, batch_id)
        upsert(batch, batch_id)
        upsert(batch, batch_id)

    def half_written(batch: DataFrame, batch_id: int) -> None:
        rows = run_rows(runs_from_counts(batch).withColumn("review_count", F.col("review_count") * 2))
        rows.write.parquet(f"{folder}/ledger/data/stream-{batch_id}-{uuid.uuid4().hex}")

    finish(
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(faulty)
    )
    write_snapshot(spark, f"{folder}/ledger", f"{folder}/snapshots")
    runs = read_snapshot(spark, f"{folder}/snapshots")
    return runs.select(
        "product_id", "week_key", "week_ending", "review_count", F.array_join("top_3", ",").alias("top_3")
    )


# Runs of a week are patched by later ones; the ledger as of each commit is read again.
@query(
    "ledger_versions",
    f"""WITH {EV}, v(version) AS (VALUES (0), (1), (2))
SELECT CAST(version AS INTEGER) AS version, week_key, count(*) AS runs, CAST(sum(event_id) AS BIGINT) AS words
FROM ev, v WHERE event_id % 3 <= version GROUP BY ALL""",
)
def ledger_versions(spark, sf):
    """Every state of a ledger of one run per event, by the versions that its commits made."""
    path = f"{run_folder(spark)}/ledger"
    rows = event_reviews(spark, sf).select(
        "product_id", "week_key", F.col("event_id").alias("review_count"), F.col("id").alias("run_id")
    )
    for batch in (0, 1, 1, 0, 2):  # two batches come again
        append_run(rows.filter(F.col("review_count") % 3 == batch), path, "job", batch)
    states = [read_runs(spark, path, v).withColumn("version", F.lit(v)) for v in range(3)]
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("version", "week_key").agg(F.count("*").alias("runs"), F.sum("review_count").alias("words"))


def run_to_end(folder: str, found: DataFrame, mode: str, sink=None) -> None:
    """Run a stream over what there is; without a sink its rows are added to ``out``."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out")

    finish(
        found.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(sink or keep)
    )


# Four thirteenths land a batch late, after the watermark has passed most weeks.
@query(
    "late_rows",
    f"""WITH {EV}, parts AS (SELECT *, CASE WHEN event_id % 13 < 9 THEN 0 WHEN event_id % 13 < 11 THEN 1 ELSE 2 END AS part FROM ev),
marks AS (SELECT a.part, max(b.date) - 7 AS mark FROM (VALUES (1), (2)) a(part) JOIN parts b ON b.part < a.part GROUP BY 1),
judged AS (SELECT p.*, CAST(date_trunc('week', date) AS DATE) + 6 AS last_day, mark FROM parts p LEFT JOIN marks USING (part))
SELECT product_id, week_key, theme_id, coalesce(last_day <= mark, false) AS late,
       max(CASE WHEN last_day <= mark THEN CAST(mark - last_day AS INTEGER) END) AS most_behind, count(*) AS review_count,
       count(*) FILTER (rating <= 2) AS low_star_count
FROM judged GROUP BY ALL""",
)
def late_rows(spark, sf):
    """Weekly counts of rows in time, and of rows of weeks already closed, told apart."""
    folder = run_folder(spark)
    rows = event_reviews(spark, sf)
    routes = late_table(spark, f"{folder}/rows", rows.schema)
    write, turn = routed(routes, days=7), F.col("event_id") % 13
    for k, part in enumerate((turn < 9, turn.between(9, 10), turn > 10)):
        rows.filter(part).write.parquet(f"{folder}/landing/{k}")
        landed = spark.readStream.schema(rows.schema).parquet(f"{folder}/landing/{k}")
        # Each landing is one run that takes all its files; a run of its own numbers its batch anew.
        sink = lambda batch, _, k=k: (write(batch, k), write(batch, k))
        finish(landed.writeStream.option("checkpointLocation", f"{folder}/state-{k}").foreachBatch(sink))
    return routes.read().groupBy("product_id", "week_key", "theme_id", "late").agg(
        F.max("behind").alias("most_behind"),
        F.count("*").alias("review_count"),
        F.count_if(F.col("rating") <= 2).alias("low_star_count"),
    )


# The window after each third of the documents has landed.
@query(
    "stream_window",
    " UNION ALL ".join(
        f"""(WITH docs AS (SELECT source AS product_id, DATE '2024-03-31' - CAST(n_chars * 7 % 100 AS INTEGER) AS date
  FROM documents WHERE doc_id % 3 <= {k}), {WINDOW}
SELECT {k} AS batch, product_id, weeks_used, in_window, DATE '2024-03-31' - 7 * weeks_used AS window_start,
       weeks_used > 8 AS window_widened, in_window < 30 AS insufficient_signal FROM win)"""
        for k in range(3)
    ),
)
def stream_window(spark, sf):
    """The adaptive window of every product after each batch, from counts per day alone."""
    folder = run_folder(spark)
    rows = document_reviews(spark, sf).select("product_id", "date", "doc_id")
    counts = CommittedTable(spark, f"{folder}/days", day_schema(rows.schema, KEYS))
    write, found = count_days(counts, KEYS), []
    for k in range(3):
        rows.filter(F.col("doc_id") % 3 == k).write.parquet(f"{folder}/landing/{k}")
        landed = spark.readStream.schema(rows.schema).parquet(f"{folder}/landing/{k}")
        sink = lambda batch, _, k=k: (write(batch, k), write(batch, k))
        finish(landed.writeStream.option("checkpointLocation", f"{folder}/state-{k}").foreachBatch(sink))
        days = merged_days(counts, KEYS, version=k)
        found.append(resolve_window(days, 8, AS_OF, KEYS, count="n").withColumn("batch", F.lit(k)))
    return reduce(DataFrame.unionByName, found).drop("as_of")


@query(
    "landed_files",
    f"""WITH {RAW} SELECT doc_id AS src_pos, product_id, text, date, rating FROM cls WHERE reason IS NULL""",
)
def landed_files(spark, sf):
    """Raw exports that land as JSON lines, normalised as they come."""
    folder = run_folder(spark)
    raw = raw_documents(spark, sf)
    raw.write.json(f"{folder}/landing")
    rows = stream_reviews(stream_raw(spark, f"{folder}/landing", raw.schema, max_files=4))
    finish(
        rows.select("src_pos", "product_id", "text", "date", "rating")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{folder}/state")
        .option("path", f"{folder}/out")
    )
    return spark.read.parquet(f"{folder}/out")


@query(
    "landed_csv",
    """SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events""",
)
def landed_csv(spark, sf):
    """CSV files that land, among them lines that are no rows: those are kept apart, not counted as rows."""
    folder = run_folder(spark)
    rows = table(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"))
    rows.write.option("header", "true").csv(f"{folder}/landing")
    broken = rows.select(F.concat(F.lit("no number,"), "event_type")).limit(3)
    broken.withColumnRenamed(broken.columns[0], "event_id").write.mode("append").option("header", "true").option("quote", "").csv(f"{folder}/landing")
    schema = T.StructType([*rows.schema.fields, T.StructField("_corrupt_record", T.StringType())])
    landed = stream_raw(spark, f"{folder}/landing", schema, fmt="csv")

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("bad", F.col("_corrupt_record").isNotNull()).write.mode("append").partitionBy("bad").parquet(f"{folder}/out")

    run_to_end(folder, landed, "append", split)
    out = spark.read.parquet(f"{folder}/out")
    return out.filter("not bad").select("event_id", "event_type", "user_id")
