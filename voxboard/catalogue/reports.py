"""Padding, composing, parsing and delivering reports, over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    AS_OF,
    CANDIDATES,
    DOCS,
    EV,
    SCORED,
    TEST_VOCABULARY,
    VOCAB,
    agg_sql,
    document_reviews,
    event_reviews,
    rank_sql,
    sql_needle,
    sql_strip,
    sql_truncate,
    sql_word_count,
    table,
)
from voxboard.catalogue.evidence import CHOSEN, chosen, labelled, picked, ranked
from voxboard.catalogue.registry import query
from voxboard.catalogue.windows import WINDOW
from voxboard.functions import text
from voxboard.operators import report, themes
from voxboard.operators.joins import join_on
from voxboard.operators.ledger import publish_queue
from voxboard.plans.staging import shared
from voxboard.plans.weekly import report_payload, weekly_reports
from voxboard.session import ensure_checkpoint_dir
from voxboard.sources.artifacts import read_runs

KEYS = ["product_id"]
WEEKLY = ["product_id", "week_key"]
CHAIN = f"WITH {VOCAB}, {DOCS}, {SCORED}, {CANDIDATES}"

# Weeks in which only reviews of two event types count have two themes to show.
TWO = "few AS (SELECT * FROM ev WHERE theme_id IN ('trading_orders', 'fees_funding'))"
SPARSE_TOP = f"""{agg_sql('few', 'product_id, week_key')}, {rank_sql('product_id, week_key')},
grp AS (SELECT DISTINCT product_id, week_key FROM ev),
pads AS (
  SELECT g.product_id, g.week_key, v.* FROM grp g JOIN vocab v ON true
  WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.product_id = g.product_id
                    AND r.week_key = g.week_key AND r.theme_id = v.theme_id)),
allt AS (
  SELECT product_id, week_key, 0 AS pad, rank AS pos, theme_id, label, review_count, avg_rating FROM ranked
  UNION ALL SELECT product_id, week_key, 1, ordinal, theme_id, label, 0, NULL FROM pads),
full3 AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY product_id, week_key ORDER BY pad, pos) AS INTEGER) AS rank FROM allt)"""


def two_theme_weeks(spark, sf):
    reviews = event_reviews(spark, sf)
    few = reviews.filter(F.col("theme_id").isin("trading_orders", "fees_funding"))
    return reviews.select(*WEEKLY).distinct(), themes.rank_themes(themes.theme_counts(few, WEEKLY), WEEKLY)


@query(
    "pad_themes",
    f"""WITH {VOCAB}, {EV}, {TWO}, {SPARSE_TOP}
SELECT product_id, week_key, rank, theme_id, label, review_count, avg_rating FROM full3 WHERE rank <= 3""",
)
def pad_themes(spark, sf):
    groups, top = two_theme_weeks(spark, sf)
    rows = report.pad_themes(top, groups, WEEKLY)
    return rows.select(*WEEKLY, "rank", "theme_id", "label", "review_count", "avg_rating")


@query(
    "pad_actions",
    f"""WITH {VOCAB}, {EV}, {TWO}, {agg_sql('few', 'product_id, week_key')}, {rank_sql('product_id, week_key')},
grp AS (SELECT DISTINCT product_id, week_key FROM ev),
given AS (SELECT product_id, week_key, 0 AS tier, 1 AS pos, 'fees_funding' AS theme_id,
                 'Explain the fees of week ' || week_key AS action FROM grp),
defaults AS (
  SELECT r.product_id, r.week_key, 1 AS tier, r.rank AS pos, v.theme_id, v.action
  FROM ranked r JOIN vocab v ON v.theme_id = r.theme_id
  UNION ALL SELECT g.product_id, g.week_key, 2, v.ordinal, v.theme_id, v.action FROM grp g JOIN vocab v ON true),
fresh AS (
  SELECT *, row_number() OVER (PARTITION BY product_id, week_key, theme_id ORDER BY tier, pos) AS n
  FROM defaults WHERE theme_id <> 'fees_funding'),
allp AS (SELECT * FROM given UNION ALL SELECT * EXCLUDE (n) FROM fresh WHERE n = 1),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY product_id, week_key ORDER BY tier, pos) AS INTEGER) AS action_rank FROM allp)
SELECT product_id, week_key, action_rank, theme_id, action FROM num WHERE action_rank <= 3""",
)
def pad_actions(spark, sf):
    groups, top = two_theme_weeks(spark, sf)
    given = groups.select(
        *WEEKLY,
        F.lit(1).alias("action_rank"),
        F.lit("fees_funding").alias("theme_id"),
        F.concat(F.lit("Explain the fees of week "), "week_key").alias("action"),
    )
    return report.pad_actions(given, top, groups, WEEKLY)


@query(
    "default_actions",
    f"""WITH {VOCAB}, {EV}, {agg_sql('ev', 'product_id')}, {rank_sql('product_id')}
SELECT product_id, rank AS action_rank, theme_id, action FROM ranked JOIN vocab USING (theme_id) WHERE rank <= 3""",
)
def default_actions(spark, sf):
    counts = themes.theme_counts(event_reviews(spark, sf), KEYS)
    return report.default_actions(themes.rank_themes(counts, KEYS), KEYS)


def _lines(items: str, rank: str, source: str, name: str) -> str:
    return (
        f"{name} AS (SELECT product_id, string_agg({rank} || '. ' || {items}, chr(10) ORDER BY {rank}) AS txt "
        f"FROM {source} GROUP BY product_id)"
    )


GROUPS = """grp AS (SELECT product_id, max(date) AS week_ending, count(*) AS review_count FROM lab GROUP BY product_id)"""
TOP3 = """t3 AS (SELECT * FROM ranked WHERE rank <= 3),
a3 AS (SELECT t.product_id, t.rank, v.action FROM t3 t JOIN vocab v ON v.theme_id = t.theme_id)"""


def _body(theme_lines: str, quote_lines: str, action_lines: str) -> str:
    return (
        "'# ' || g.product_id || ' Weekly Review — Week Ending ' || strftime(g.week_ending, '%Y-%m-%d') "
        f"|| chr(10) || chr(10) || '## Top Themes' || chr(10) || {theme_lines} || chr(10) || chr(10) "
        f"|| '## What Users Said' || chr(10) || {quote_lines} || chr(10) || chr(10) "
        f"|| '## Action Ideas' || chr(10) || {action_lines} || chr(10)"
    )


THEME_LINE = "label || ' (' || review_count || ' reviews, avg ' || coalesce(CAST(avg_rating AS VARCHAR), 'None') || ')'"
PARTS = ", ".join(
    [
        GROUPS,
        TOP3,
        _lines(THEME_LINE, "rank", "t3", "th"),
        _lines("label", "rank", "t3", "thb"),
        _lines("'“' || quote || '”'", "quote_rank", "padded", "qu"),
        _lines(f"'“' || {sql_truncate('quote', 28)} || '”'", "quote_rank", "padded", "qub"),
        _lines("action", "rank", "a3", "ac"),
        _lines(sql_truncate("action", 22), "rank", "a3", "acb"),
        f"""bodies AS (
  SELECT g.*, {_body('th.txt', 'qu.txt', 'ac.txt')} AS full_body, {_body('thb.txt', 'qub.txt', 'acb.txt')} AS brief_body
  FROM grp g JOIN th USING (product_id) JOIN thb USING (product_id) JOIN qu USING (product_id)
  JOIN qub USING (product_id) JOIN ac USING (product_id) JOIN acb USING (product_id)),
composed AS (SELECT *, CASE WHEN {sql_word_count('full_body')} > 250 THEN brief_body ELSE full_body END AS body FROM bodies)""",
    ]
)


def staged_reviews(spark, sf):
    return shared(spark)(labelled(spark, sf), "labelled")


def composed(spark, sf, sparse: bool = False, reviews=None):
    stage = shared(spark)
    reviews = reviews or staged_reviews(spark, sf)
    top = stage(ranked(reviews), "top")
    groups = reviews.groupBy(*KEYS).agg(
        F.max("date").alias("week_ending"), F.count("*").alias("review_count")
    )
    groups = groups.withColumns(
        {
            "insufficient_signal": F.lit(sparse),
            "weeks_used": F.lit(12),
            "window_widened": F.lit(sparse),
        }
    )
    actions = report.default_actions(top, KEYS, TEST_VOCABULARY)
    quotes = stage(chosen(reviews, top), "quotes")
    return stage(report.assemble(groups, top, quotes, actions, KEYS), "reports")


@query(
    "compose_report",
    f"""{CHAIN}, {CHOSEN}, {PARTS}
SELECT product_id, week_ending, strftime(week_ending, '%G-W%V') AS week_key, body,
       {sql_word_count('body')} AS word_count,
       product_id || ' Weekly Review - ' || strftime(week_ending, '%G-W%V') || ' (week ending ' ||
       strftime(week_ending, '%Y-%m-%d') || ')' AS title FROM composed""",
)
def compose_report(spark, sf):
    return composed(spark, sf).select(
        "product_id", "week_ending", "week_key", "body", "word_count", "title"
    )


def _banner(body: str, banner: str) -> str:
    return (
        f"string_split({body}, chr(10))[1] || chr(10) || chr(10) || {banner} || "
        f"regexp_replace(array_to_string(string_split({body}, chr(10))[2:], chr(10)), '^\\n+', '')"
    )


LONG = (
    "'**Insufficient signal:** only ' || review_count || ' Play Store reviews in the last 12 weeks after "
    "widening toward 12. Treat themes as directional, not a full weekly read.' || chr(10) || chr(10)"
)


@query(
    "compose_sparse_report",
    f"""{CHAIN}, {CHOSEN}, {PARTS}, sp AS (SELECT *, {_banner('body', LONG)} AS warned FROM composed)
SELECT product_id, warned AS body, {sql_word_count('warned')} AS word_count FROM sp""",
)
def compose_sparse_report(spark, sf):
    return composed(spark, sf, sparse=True).select("product_id", "body", "word_count")


# Reports are composed and read back; quotes lose their marks and ellipsis.
@query(
    "parse_report",
    f"""{CHAIN}, {CHOSEN}, {PARTS}
SELECT c.product_id, c.week_ending AS parsed_week_ending, {sql_word_count('c.body')} AS parsed_word_count,
  (SELECT string_agg(label, ' | ' ORDER BY rank) FROM t3 WHERE t3.product_id = c.product_id) AS themes,
  (SELECT string_agg(n, ' | ' ORDER BY quote_rank) FROM (
     SELECT product_id, quote_rank, {sql_needle("regexp_split_to_array(quote, '[' || chr(10) || ']')[1]")} AS n
     FROM (SELECT product_id, quote_rank, quote FROM padded)) q WHERE q.product_id = c.product_id) AS quotes,
  (SELECT string_agg(action, ' | ' ORDER BY rank) FROM a3 WHERE a3.product_id = c.product_id) AS actions
FROM composed c""",
)
def parse_report(spark, sf):
    stored = composed(spark, sf).select("product_id", "body")
    rows = report.parse_reports(stored)
    return rows.select(
        "product_id",
        "parsed_week_ending",
        "parsed_word_count",
        F.array_join("parsed_themes", " | ").alias("themes"),
        F.array_join("parsed_quotes", " | ").alias("quotes"),
        F.array_join("parsed_actions", " | ").alias("actions"),
    )


# Every document as a stored body: none is a report, all lines are looked at.
@query(
    "parse_plain_texts",
    f"""SELECT doc_id, 0 AS n_items, {sql_word_count('text')} AS parsed_word_count FROM documents""",
)
def parse_plain_texts(spark, sf):
    rows = report.parse_reports(table(spark, sf, "documents").select("doc_id", "text"), "text")
    items = F.size("parsed_themes") + F.size("parsed_quotes") + F.size("parsed_actions")
    return rows.select("doc_id", items.alias("n_items"), "parsed_word_count")


@query(
    "delivery_body",
    rf"""SELECT doc_id, CASE WHEN lang = 'de' OR n_chars % 3 = 0 THEN text
  ELSE 'Weekly Review is ready.' || chr(10) || chr(10) || 'Doc: https://example.com/' || doc_id || chr(10) || chr(10)
       || '---' || chr(10) || 'Preview (first lines):' || chr(10) || chr(10)
       || array_to_string(string_split({sql_strip('text')}, chr(10))[1:12], chr(10)) END AS body FROM documents""",
)
def delivery_body(spark, sf):
    """Documents as bodies: German ones are sent whole, some have no link."""
    url = F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")))
    mode = F.when(F.col("lang") == "de", " FULL ").otherwise("link")
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", report.delivery_body(F.col("text"), url, mode).alias("body"))


@query(
    "section_text",
    f"""SELECT item_id, 'Week ' || item_id || chr(10) || chr(10) || {sql_strip('text')} || chr(10) AS section FROM benchmark""",
)
def section_text(spark, sf):
    title = F.concat(F.lit("  Week "), F.col("item_id").cast("string"))
    return table(spark, sf, "benchmark").select(
        "item_id", text.section_text(title, F.col("text")).alias("section")
    )


def weekly_documents(spark, sf):
    return weekly_reports(document_reviews(spark, sf).drop("doc_id"), AS_OF, vocab=TEST_VOCABULARY)


# The reviews inside each product's window, as the weekly plan sees them.
WINDOWED = f"""WITH {VOCAB}, {DOCS.replace('docs AS', 'every AS', 1)}, {WINDOW.replace('FROM docs', 'FROM every')},
docs AS (SELECT e.* FROM every e JOIN win w USING (product_id)
         WHERE e.date BETWEEN DATE '2024-03-31' - 7 * w.weeks_used AND DATE '2024-03-31'),
{SCORED}, {agg_sql('lab', 'product_id')}, {rank_sql('product_id')}"""


@query(
    "weekly_report",
    f"""{WINDOWED}, tops AS (
  SELECT product_id, string_agg(theme_id || ':' || low_star_count, ',' ORDER BY rank) AS top_3
  FROM ranked WHERE rank <= 3 GROUP BY 1),
sized AS (SELECT product_id, count(*) AS review_count, max(date) AS week_ending FROM docs GROUP BY 1)
SELECT s.product_id, review_count, week_ending, strftime(week_ending, '%G-W%V') AS week_key,
       CAST(weeks_used AS INTEGER) AS weeks_used, weeks_used > 8 AS window_widened,
       in_window < 30 AS insufficient_signal, top_3
FROM sized s JOIN win USING (product_id) JOIN tops USING (product_id)""",
)
def weekly_report(spark, sf):
    """The whole weekly plan for every product; texts and gates have queries of their own."""
    weekly = weekly_documents(spark, sf)
    ranks = F.array_sort(F.collect_list(F.struct("rank", "theme_id", "low_star_count")))
    tops = weekly.top.groupBy(*KEYS).agg(ranks.alias("tops"))
    rows = join_on(weekly.results(KEYS), tops, KEYS)
    named = F.transform("tops", lambda t: F.concat_ws(":", t["theme_id"], t["low_star_count"]))
    return rows.select(
        *KEYS, "review_count", "week_ending", "week_key", "weeks_used", "window_widened",
        "insufficient_signal", F.array_join(named, ",").alias("top_3"),
    )


@query(
    "report_payload",
    f"""{WINDOWED}, hist AS (
  SELECT product_id, concat_ws(',', {", ".join(f"count(*) FILTER (rating = {i})" for i in range(1, 6))}) AS histogram
  FROM docs GROUP BY 1),
rows AS (SELECT product_id, string_agg(theme_id || ':' || review_count || ':' || low_star_count, ',' ORDER BY theme_id) AS theme_rows,
                CAST(sum(least(review_count, 12)) AS INTEGER) AS n_snippets FROM agg GROUP BY 1)
SELECT product_id, histogram, theme_rows, n_snippets, 7 AS n_gates FROM hist JOIN rows USING (product_id)""",
)
def report_payload_query(spark, sf):
    """The nested row for a viewer, its lists written out."""
    rows = report_payload(weekly_documents(spark, sf), KEYS)
    themes_ = F.transform(
        "theme_rows", lambda t: F.concat_ws(":", t["theme_id"], t["review_count"], t["low_star_count"])
    )
    return rows.select(
        *KEYS,
        F.array_join(F.transform("rating_histogram", lambda n: n.cast("string")), ",").alias("histogram"),
        F.array_join(themes_, ",").alias("theme_rows"),
        F.size("snippets").alias("n_snippets"),
        F.size("gates").alias("n_gates"),
    )


# Cleaned reviews pass their gates; three products keep reviews in other languages.
@query(
    "publishable_reports",
    f"""WITH {DOCS}, mine AS (
  SELECT * FROM docs WHERE language = 'en' OR product_id IN ('src1', 'src2', 'src5')),
{WINDOW.replace('FROM docs', 'FROM mine')},
ins AS (SELECT m.product_id, m.language, w.weeks_used, w.in_window FROM mine m JOIN win w USING (product_id)
        WHERE m.date BETWEEN DATE '2024-03-31' - 7 * w.weeks_used AND DATE '2024-03-31'),
res AS (SELECT product_id, count(*) AS review_count, CAST(any_value(weeks_used) AS INTEGER) AS weeks_used,
               any_value(in_window) < 30 AS insufficient_signal,
               count(*) FILTER (language <> 'en') AS n_foreign FROM ins GROUP BY 1)
SELECT product_id, review_count, weeks_used, insufficient_signal, n_foreign = 0 AS validation_ok,
       CASE WHEN n_foreign > 0 THEN n_foreign || ' review(s): language must be ''en''' ELSE '' END AS errors,
       insufficient_signal AS warned, n_foreign = 0 AND NOT insufficient_signal AS published FROM res""",
)
def publishable_reports(spark, sf):
    """From reviews to the publish queue; quotes may differ in white space."""
    reviews = document_reviews(spark, sf).drop("doc_id")
    mine = reviews.filter((F.col("language") == "en") | F.col("product_id").isin("src1", "src2", "src5"))
    weekly = weekly_reports(mine, AS_OF, vocab=TEST_VOCABULARY, loose_space=True)
    runs = weekly.run_rows(KEYS, F.lit("2024-04-01 00:00:00").cast("timestamp"))
    none = read_runs(spark, f"{ensure_checkpoint_dir(spark)}/no-ledger-{uuid.uuid4().hex}")
    queue = publish_queue(runs, none, WEEKLY).select(*KEYS, F.lit(True).alias("queued"))
    return join_on(runs, queue, KEYS, "left").select(
        *KEYS, "review_count", "weeks_used", "insufficient_signal", "validation_ok",
        F.array_join("errors", " | ").alias("errors"), (F.size("warnings") > 0).alias("warned"),
        F.coalesce("queued", F.lit(False)).alias("published"),
    )
