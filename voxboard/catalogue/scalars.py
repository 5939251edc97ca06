"""Scalar functions, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    sql_needle,
    sql_signal,
    sql_truncate,
    sql_unwrap,
    sql_word_count,
    table,
)
from voxboard.catalogue.registry import query
from voxboard.functions import dates, ids, numbers, text


@query(
    "word_counts",
    f"""SELECT doc_id, {sql_word_count('text')} AS word_count,
       CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')) AS INTEGER) AS ascii_words FROM documents""",
)
def word_counts(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        text.word_count(F.col("text")).alias("word_count"),
        text.count_words(F.col("text")).alias("ascii_words"),
    )


@query("english_signal", f"SELECT doc_id, {sql_signal('text')} AS signal FROM documents")
def english_signal(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.english_signal(F.col("text")).alias("signal"))


@query("truncate_quote", f"SELECT doc_id, {sql_truncate('text')} AS quote FROM documents")
def truncate_quote(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_words(F.col("text")).alias("quote"))


QUOTED = """(SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN '  “' || text || '…”'
  WHEN 1 THEN '"' || text || '"...' WHEN 2 THEN text || '... ' ELSE '''' || text || '’ ' END AS q FROM documents)"""


def quoted(spark, sf):
    form, t = F.col("n_chars") % 4, F.col("text")
    wrapped = (
        F.when(form == 0, F.concat(F.lit("  “"), t, F.lit("…”")))
        .when(form == 1, F.concat(F.lit('"'), t, F.lit('"...')))
        .when(form == 2, F.concat(t, F.lit("... ")))
        .otherwise(F.concat(F.lit("'"), t, F.lit("’ ")))
    )
    return table(spark, sf, "documents").select("doc_id", wrapped.alias("q"))


@query("normalise_needle", f"SELECT doc_id, {sql_needle('q')} AS needle FROM {QUOTED}")
def normalise_needle(spark, sf):
    return quoted(spark, sf).select("doc_id", text.normalise_needle(F.col("q")).alias("needle"))


@query("display_quote", f"SELECT doc_id, {sql_unwrap('q')} AS quote FROM {QUOTED}")
def display_quote(spark, sf):
    return quoted(spark, sf).select("doc_id", text.unwrap_quotes(F.col("q")).alias("quote"))


@query(
    "iso_week_titles",
    """SELECT event_id, strftime(d, '%G-W%V') AS week_key, event_type || ' Weekly Review - ' ||
       strftime(d, '%G-W%V') || ' (week ending ' || strftime(d, '%Y-%m-%d') || ')' AS title
FROM (SELECT *, CAST(ts AS DATE) - CAST(event_id % 2000 AS INTEGER) AS d FROM events)""",
)
def iso_week_titles(spark, sf):
    """Dates over six years, so that all kinds of year ends are met."""
    day = F.date_sub(F.to_date("ts"), (F.col("event_id") % 2000).cast("int"))
    events = table(spark, sf, "events").select("event_id", "event_type", day.alias("d"))
    week = dates.iso_week_key(F.col("d"))
    return events.select(
        "event_id",
        week.alias("week_key"),
        dates.report_title(F.col("event_type"), week, F.col("d")).alias("title"),
    )


@query(
    "slugs",
    r"""SELECT doc_id, substr(coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-zA-Z0-9]+', '-', 'g'),
       '^-+|-+$', '', 'g'), ''), 'report'), 1, 80) AS slug FROM documents""",
)
def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(
    "content_ids",
    """SELECT doc_id, 'doc_' || substr(sha256(source), 1, 12) AS document,
       'draft_' || substr(sha256(source || '|' || lang || '|' || substr(text, 1, 200)), 1, 12) AS draft,
       'msg_' || substr(sha256('send|' || source || '|' || lang || '|' || substr(text, 1, 200)), 1, 12) AS message
FROM documents""",
)
def content_ids(spark, sf):
    to, subject, body = F.col("source"), F.col("lang"), F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        ids.doc_id(to).alias("document"),
        ids.draft_id(to, subject, body).alias("draft"),
        ids.message_id(to, subject, body).alias("message"),
    )


@query(
    "document_ids",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(u, '(?:docs\.google\.com/document/d/|/d/)([a-zA-Z0-9_-]+)', 1), ''), u) AS id
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN trim(url) ELSE 'https://docs.google.com/document/d/' || md5(url) || '/edit' END AS u
      FROM pages)""",
)
def document_ids(spark, sf):
    address = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(
        F.concat(F.lit(" https://docs.google.com/document/d/"), F.md5("url"), F.lit("/edit"))
    )
    return table(spark, sf, "pages").select("page_id", text.document_id(address).alias("id"))


@query(
    "display_dates",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN event_type
       ELSE strftime(ts, '%-d %b %Y') END AS shown FROM events""",
)
def display_dates(spark, sf):
    written = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd")
    )
    return table(spark, sf, "events").select("event_id", dates.display_date(written).alias("shown"))


@query(
    "grouped_digits",
    r"""SELECT o_orderkey, CASE WHEN length(n) <= 3 THEN n ELSE
       ltrim(regexp_replace(lpad(left(n, length(n) - 3), 6, ' '), '(..)(..)(..)', '\1,\2,\3'), ' ,') || ',' || right(n, 3) END AS shown
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice * 10) AS BIGINT) AS VARCHAR) AS n FROM orders)""",
)
def grouped_digits(spark, sf):
    n = F.floor(F.col("o_totalprice") * 10)
    return table(spark, sf, "orders").select("o_orderkey", numbers.group_digits_indian(n).alias("shown"))


@query(
    "short_ids",
    """SELECT page_id, CASE WHEN length(url) <= 14 THEN url ELSE substr(url, 1, 12) || '…' END AS short,
       substr(url, 1, 12) || '…' AS snippet FROM pages""",
)
def short_ids(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        text.shorten_id(F.col("url")).alias("short"),
        text.snippet_id(F.col("url")).alias("snippet"),
    )


@query(
    "clamped_weeks",
    "SELECT event_id, CAST(greatest(8, least(12, user_id % 20)) AS BIGINT) AS weeks FROM events",
)
def clamped_weeks(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dates.clamp_weeks_col(F.col("user_id") % 20).alias("weeks")
    )


@query(
    "round_half_even",
    """SELECT l_partkey, CAST(printf('%.3f', avg(CAST(l_linenumber AS DOUBLE))) AS DOUBLE) AS mean
FROM lineitem GROUP BY l_partkey""",
)
def round_half_even(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_linenumber").alias("m"))
    return lines.select("l_partkey", numbers.round_half_even(F.col("m"), 3).alias("mean"))
