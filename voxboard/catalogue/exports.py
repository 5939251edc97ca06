"""Exports, cleaned tables and artifacts, written from the tables and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxboard.catalogue.adapters import DOCS, EV, document_reviews, event_reviews, table
from voxboard.catalogue.registry import query
from voxboard.functions.dates import iso_week_key
from voxboard.model import PII_COLUMNS
from voxboard.operators import gates
from voxboard.session import ensure_checkpoint_dir
from voxboard.sources import artifacts, clean, raw

KEYS = ["product_id"]


def folder_for(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_csv(rows: DataFrame, path: str, **options: str) -> str:
    """CSV as exports have it: quotes doubled, line breaks and outer blanks as they are."""
    writer = rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true")
    writer = writer.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    writer.options(**options).csv(path)
    return path


@query("csv_line_breaks", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_line_breaks(spark, sf):
    """Texts with line breaks in quotes, through CSV files that are cut by byte ranges."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("Doc_ID "), "text", "lang")
    path = written_csv(rows, folder_for(spark, "export"))
    return raw.scan_csv(spark, raw.discover_raw(spark, path)).select("doc_id", "text", "lang")


@query("csv_utf16", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def csv_utf16(spark, sf):
    """The same in UTF-16, with tabs between the fields."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    path = written_csv(rows, folder_for(spark, "export"), sep="\t", encoding="UTF-16LE")
    return raw.scan_csv(spark, raw.discover_raw(spark, path)).select("doc_id", "text")


def json_documents(rows: DataFrame, path: str, before: str, after: str, between: str) -> list[str]:
    """One JSON document per task: its rows as a list, in what stands around it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = before
        for batch in batches:
            lines = [(mark if i == 0 else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
            if lines:
                mark = ","
                yield pa.RecordBatch.from_pydict({"value": lines})
        if mark != before:
            yield pa.RecordBatch.from_pydict({"value": [after]})

    objects = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    objects.mapInArrow(run, "value string").write.option("lineSep", between).text(path)
    files = rows.sparkSession.read.format("binaryFile").load(path).select("path", "length")
    return sorted(r.path for r in files.collect() if r.length)


@query("json_lists", "SELECT doc_id, text, lang FROM documents")
def json_lists(spark, sf):
    """JSON documents that are a list, over many lines or on one, and lists inside an object."""
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    part = F.col("doc_id") % 3
    wrapped = '{"meta": {"reviews": [{"doc_id": -1}]}, "items": [{"doc_id": -2}], "reviews": ['
    files = [
        *json_documents(rows.filter(part == 0), folder_for(spark, "export"), "[", "]", "\n"),
        *json_documents(rows.filter(part == 1), folder_for(spark, "export"), "[", "]", " "),
        *json_documents(rows.filter(part == 2), folder_for(spark, "export"), wrapped, '], "next": {"doc_id": -3}}', " "),
    ]
    return raw.scan_json(spark, files).select("doc_id", "text", "lang")


@query("json_objects", "SELECT n_nationkey AS nation, n_name AS name, n_regionkey AS region FROM nation")
def json_objects(spark, sf):
    """Files of one object each, and files of one object per line."""
    rows = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )
    path = folder_for(spark, "export")
    single = rows.filter("region < 2").withColumn("own", F.col("nation"))
    single.write.partitionBy("own").json(f"{path}/single")
    rows.filter("region >= 2").write.json(f"{path}/lines")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    return raw.scan_json(spark, list(files)).select("nation", "name", "region")


@query(
    "scan_folder",
    """SELECT origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT lang AS origin, text FROM documents UNION ALL SELECT role, text FROM conversations) GROUP BY origin""",
)
def scan_folder(spark, sf):
    """A folder of CSV, JSON and other files: exports are found, dispatched and united, others passed over."""
    path = folder_for(spark, "export")
    docs = table(spark, sf, "documents").select(F.col("lang").alias("origin"), "text")
    written_csv(docs, path)
    turns = table(spark, sf, "conversations").select(F.col("role").alias("origin"), "text")
    turns.write.mode("append").json(path)
    docs.select("text").write.mode("append").text(path)
    rows = raw.require_nonempty(raw.scan_raw(spark, path))
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


CLEAN_SQL = f"""WITH {DOCS} SELECT id, source, rating, CAST(NULL AS VARCHAR) AS title, text, date, language,
       product_id, strftime(date, '%G-W%V') AS week_key FROM docs"""


def cleaned(spark, sf) -> DataFrame:
    reviews = document_reviews(spark, sf).withColumn("title", F.lit(None).cast("string"))
    return reviews.withColumn("week_key", iso_week_key(F.col("date")))


@query("write_clean_table", CLEAN_SQL)
def write_clean_table(spark, sf):
    """The cleaned table by product and week; other columns, personal ones first, are left behind."""
    path = folder_for(spark, "clean")
    extra = cleaned(spark, sf).withColumn("thumbs_up", F.lit(1))
    clean.write_clean(extra, path)
    names = ["id", "source", "rating", "title", "text", "date", "language", *KEYS, "week_key"]
    return clean.scan_clean(spark, path).select(*names)


@query("write_clean_json", CLEAN_SQL.replace(", strftime(date, '%G-W%V') AS week_key", "").replace(",\n       product_id", ""))
def write_clean_json(spark, sf):
    path = folder_for(spark, "clean")
    clean.write_clean(cleaned(spark, sf).drop("product_id", "week_key"), path, fmt="json")
    return clean.scan_clean_preferred(spark, path, None).select("id", "source", "rating", "title", "text", "date", "language")


@query(
    "csv_mirror",
    f"""WITH {DOCS} SELECT id, source, rating, CAST(NULL AS VARCHAR) AS title,
       replace(text, chr(10), ' ') AS text, date, language FROM docs""",
)
def csv_mirror(spark, sf):
    """The CSV mirror in its fixed column order, nulls as blanks; here with one line per review."""
    path = folder_for(spark, "mirror")
    clean.write_csv(cleaned(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))), path)
    header = spark.read.text(path).first()[0]
    if header != "id,source,rating,title,text,date,language":
        raise ValueError(f"columns of the mirror are {header}")
    return clean.scan_clean(spark, path)


@query(
    "refused_tables",
    f"""WITH {DOCS} SELECT language, count(*) AS n_rows,
       '{' '.join(PII_COLUMNS)}' AS refused FROM docs GROUP BY language""",
)
def refused_tables(spark, sf):
    """Personal columns with which a table is not written, and its rows once they are off."""
    reviews, refused = cleaned(spark, sf), []
    for name in PII_COLUMNS:
        try:
            clean.write_clean(reviews.withColumn(name, F.lit("x")), folder_for(spark, "refused"))
        except ValueError as exc:
            if f"['{name}']" in str(exc):
                refused.append(name)
    path = folder_for(spark, "clean")
    distinct = {n.lower(): F.lit("x") for n in PII_COLUMNS}
    clean.write_clean(clean.keep_columns(reviews.withColumns(distinct), KEYS), path)
    back = clean.assert_no_pii_columns(clean.scan_clean(spark, path))
    return back.groupBy("language").agg(F.count("*").alias("n_rows")).withColumn("refused", F.lit(" ".join(refused)))


@query(
    "personal_keys",
    f"""SELECT event_id, list_sort(list_filter(k, lambda x: x IN ({', '.join(f"'{c}'" for c in PII_COLUMNS)}))) AS leaked FROM (
  SELECT event_id, ['{PII_COLUMNS[0]}', 'event_type', CASE WHEN event_id % 2 = 0 THEN '{PII_COLUMNS[1]}' ELSE 'value' END] AS k FROM events)""",
)
def personal_keys(spark, sf):
    """Personal names among the keys of a map column, row by row."""
    keys = F.map_from_arrays(
        F.array(
            F.lit(PII_COLUMNS[0]), F.lit("event_type"),
            F.when(F.col("event_id") % 2 == 0, PII_COLUMNS[1]).otherwise("value"),
        ),
        F.array(F.lit("a"), "event_type", F.col("value").cast("string")),
    )
    found = F.array_intersect(F.map_keys("payload"), F.array(*[F.lit(c) for c in PII_COLUMNS]))
    return table(spark, sf, "events").select("event_id", keys.alias("payload")).select(
        "event_id", F.array_sort(found).alias("leaked")
    )


@query(
    "gates_artifact",
    f"""WITH {EV}, p AS (SELECT product_id, week_key, count(*) AS n, min(date) AS lo, max(date) AS hi FROM ev GROUP BY 1, 2)
SELECT product_id, week_key, 'window' AS name, hi - lo <= 86 AS ok,
       strftime(lo, '%Y-%m-%d') || ' -> ' || strftime(hi, '%Y-%m-%d') || ' (' || n || ' reviews)' AS detail FROM p""",
)
def gates_artifact(spark, sf):
    """Gate checks of every week, written by week and read back."""
    keys = ["product_id", "week_key"]
    reviews = event_reviews(spark, sf).withColumn("language", F.lit("en"))
    profile = gates.review_profile(reviews, keys)
    path = folder_for(spark, "gates")
    artifacts.write_gates(profile.select(*keys, F.inline(F.array(gates.window_gate()))), path)
    return spark.read.json(path).select(*keys, "name", "ok", "detail")


@query("empty_exports", "SELECT 'no rows to work on' AS message, count(*) AS n_rows FROM documents")
def empty_exports(spark, sf):
    """An export without a row is refused, one with rows passes."""
    docs = table(spark, sf, "documents").select("text")
    path = written_csv(docs.filter("text is null and text is not null"), folder_for(spark, "export"))
    try:
        files = raw.discover_raw(spark, path)
        message = str(raw.require_nonempty(raw.scan_csv(spark, files)).count())
    except ValueError as exc:
        message = str(exc)
    passed = raw.require_nonempty(docs)
    return passed.groupBy().agg(F.count("*").alias("n_rows")).withColumn("message", F.lit(message))
