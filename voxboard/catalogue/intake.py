"""Normalisation, rejects, quality and privacy of raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    AS_OF,
    DOCS,
    document_reviews,
    sql_strip,
    table,
)
from voxboard.catalogue.registry import query
from voxboard.catalogue.windows import WINDOW
from voxboard.functions import dates, numbers, privacy, text
from voxboard.functions.ids import opaque_id
from voxboard.operators import gates, intake, language, quality, scrub
from voxboard.operators.sampling import dedupe_reviews
from voxboard.plans.ingest import ingest, ingest_stats
from voxboard.plans.staging import shared
from voxboard.sources.raw import normalise_headers, union_raw
from voxboard.sources.scan import spread

KEYS = ["product_id"]


def raw_documents(spark, sf) -> DataFrame:
    """Documents as a store export: odd headers, blanks, several date forms, bad values."""
    n, d = F.col("n_chars"), F.date_sub(F.lit(AS_OF).cast("date"), (F.col("n_chars") * 7 % 100).cast("int"))
    form = n % 8
    written = (
        F.when(form == 0, d.cast("string"))
        .when(form == 1, F.date_format(d, "yyyy/MM/dd"))
        .when(form == 2, F.date_format(d, "dd-MM-yyyy"))
        .when(form == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(form == 4, F.concat(d.cast("string"), F.lit("T23:30:00-11:00")))
        .when(form == 5, F.lit("soon"))
        .when(form == 6, F.lit(""))
        .otherwise(F.date_format(d, "yyyyMMdd"))
    )
    raw = spread(table(spark, sf, "documents")).select(
        F.when(F.col("lang") == "de", "").otherwise(F.col("source")).alias(" Package Name "),
        F.when(n % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("Review Text"),
        F.when(n % 34 == 0, F.col("lang")).otherwise("").alias("TITLE"),
        written.alias("Review Submit Date and Time"),
        F.unix_millis(d.cast("timestamp")).alias("timestamp"),
        F.when(n % 13 == 0, "n/a").otherwise((n % 7).cast("string")).alias("Star Rating"),
        F.col("lang").alias("Reviewer Language"),
        F.lit("documents").alias("src_file"),
        F.col("doc_id").alias("src_pos"),
    )
    return normalise_headers(raw)


RAW = f"""raw AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE source END AS product_id,
         CASE WHEN n_chars % 17 = 0 THEN NULL ELSE nullif({sql_strip('text')}, '') END AS body,
         CASE WHEN n_chars % 34 = 0 THEN lang END AS head,
         CASE WHEN n_chars % 8 = 5 THEN NULL
              ELSE DATE '2024-03-31' - CAST(n_chars * 7 % 100 AS INTEGER) END AS date,
         CASE WHEN n_chars % 13 <> 0 AND n_chars % 7 BETWEEN 1 AND 5
              THEN CAST(n_chars % 7 AS DOUBLE) END AS rating, lang AS language
  FROM documents),
cls AS (
  SELECT doc_id, product_id, coalesce(body, head) AS text,
         CASE WHEN body IS NOT NULL THEN head END AS title, date, rating, language,
         CASE WHEN coalesce(body, head) IS NULL THEN 'empty_text'
              WHEN date IS NULL THEN 'bad_date' END AS reason FROM raw)"""


@query(
    "normalise_reviews",
    f"""WITH {RAW}
SELECT doc_id AS src_pos, product_id, 'play-' || substr(sha256(strftime(date, '%Y-%m-%d') || '|' ||
       coalesce(CAST(rating AS VARCHAR), '') || '|' || text || '|' || coalesce(title, '')), 1, 16) AS id,
       rating, title, text, date, language
FROM cls WHERE reason IS NULL""",
)
def normalise_reviews(spark, sf):
    rows = intake.normalise(raw_documents(spark, sf))
    return rows.select("src_pos", "product_id", "id", "rating", "title", "text", "date", "language")


@query(
    "reject_reasons",
    f"""WITH {RAW} SELECT CASE WHEN product_id <> 'src1' THEN 'wrong_package'
       ELSE coalesce(reason, 'accepted') END AS reason, count(*) AS n FROM cls GROUP BY 1""",
)
def reject_reasons(spark, sf):
    return intake.reject_counts(intake.classify_rows(raw_documents(spark, sf), "src1"), [])


LATIN = (
    r"NOT regexp_matches(text, '[\x{0900}-\x{0D7F}\x{0600}-\x{06FF}\x{4E00}-\x{9FFF}"
    r"\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]') AND regexp_matches(text, '[A-Za-z]') AND "
    r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]'), "
    r"lambda c: NOT regexp_matches(c, '[A-Za-z]'))) / "
    r"greatest(len(regexp_extract_all(text, '[A-Za-z]')), 1) <= 0.15"
)
ENOUGH = "len(regexp_extract_all(text, '[A-Za-z0-9]+(?:''[A-Za-z]+)?')) >= 8"


@query(
    "reject_funnel",
    f"""WITH {DOCS}, r AS (
  SELECT product_id, CASE WHEN NOT ({ENOUGH}) THEN 'short_text'
    WHEN NOT ({LATIN}) OR language <> 'en' THEN 'non_english' ELSE 'accepted' END AS reason FROM docs)
SELECT product_id, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def reject_funnel(spark, sf):
    rows = document_reviews(spark, sf).withColumn(
        "reason", quality.quality_reason(F.col("text"), F.col("language") == "en")
    )
    return intake.reject_counts(rows, KEYS)


@query("min_words", f"SELECT doc_id FROM documents WHERE {ENOUGH}")
def min_words(spark, sf):
    return quality.min_words(table(spark, sf, "documents")).select("doc_id")


@query("script_filter", f"SELECT doc_id, {LATIN} AS latin FROM documents")
def script_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", quality.is_latin_text(F.col("text")).alias("latin"))


@query(
    "filter_quality",
    f"SELECT doc_id, 'en' AS language FROM documents WHERE {ENOUGH} AND {LATIN} AND lang = 'en'",
)
def filter_quality(spark, sf):
    docs = table(spark, sf, "documents").withColumn("language", F.col("lang"))
    return quality.filter_quality(docs, F.col("language") == "en").select("doc_id", "language")


def _vote(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in quality.STOP_WORDS[lang].split("|"))
    return f"len(list_filter(toks, lambda w: w IN ({words})))"


@query(
    "language_vote",
    r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'),
       lambda w: lower(w)) AS toks FROM documents)
SELECT doc_id, """
    + f"{_vote('en')} > 0 AND {_vote('en')} >= greatest({_vote('de')}, {_vote('es')}, {_vote('fr')}) AS english FROM t",
)
def language_vote(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", quality.english_vote(F.col("text")).alias("english"))


# Learned from four fifths of the documents, told for all.
PROFILE_SQL = r"""letters AS (
  SELECT doc_id, lang, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ' AS s FROM documents
), grams AS (
  SELECT doc_id, lang, unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS gram FROM letters
), profiles AS (
  SELECT lang AS known, gram, 401 - row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS points
  FROM grams WHERE doc_id % 5 <> 0 GROUP BY lang, gram
), points AS (
  SELECT doc_id, known, sum(points) AS points FROM grams JOIN profiles USING (gram) WHERE points > 0 GROUP BY doc_id, known
), best AS (
  SELECT doc_id, arg_min(known, {'a': -points, 'b': known}) AS pred, max(points)::DOUBLE / sum(points)::DOUBLE AS share
  FROM points GROUP BY doc_id
)"""


@query(
    "detect_language",
    f"""WITH {PROFILE_SQL} SELECT d.doc_id, CASE WHEN share >= 0.3 THEN pred END AS lang_pred, coalesce(share, 0.0::DOUBLE) AS share
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id""",
)
def detect_language(spark, sf):
    """Language of every document by trigram profiles of those whose id is not divisible by five."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text", "lang")
    profiles = shared(spark)(language.fit_profiles(docs.filter("doc_id % 5 <> 0")), "profiles")
    return language.detect_language(docs.select("doc_id", "text"), profiles, "doc_id")


@query(
    "ingest_stats",
    f"""WITH {DOCS}, dd AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY product_id, date, rating, text ORDER BY doc_id) AS rn FROM docs) WHERE rn = 1),
{WINDOW.replace('FROM docs', 'FROM dd')},
raw AS (SELECT product_id, count(*) AS raw_rows FROM docs GROUP BY 1),
par AS (SELECT product_id, count(*) AS parsed FROM dd GROUP BY 1),
ins AS (SELECT d.*, CASE WHEN NOT ({ENOUGH}) THEN 'short' WHEN NOT ({LATIN}) OR language <> 'en'
               THEN 'foreign' ELSE 'kept' END AS step
        FROM dd d JOIN win w USING (product_id)
        WHERE d.date BETWEEN DATE '2024-03-31' - 7 * w.weeks_used AND DATE '2024-03-31'),
steps AS (SELECT product_id, count(*) FILTER (step = 'short') AS dropped_short_text,
                 count(*) FILTER (step = 'foreign') AS dropped_non_english,
                 count(*) FILTER (step = 'kept') AS after_quality FROM ins GROUP BY 1)
SELECT product_id, raw_rows, 0::BIGINT AS dropped_wrong_package, 0::BIGINT AS dropped_empty_text,
       0::BIGINT AS dropped_bad_date,
       parsed, in_window, in_window AS after_scrub, dropped_short_text, dropped_non_english, after_quality,
       weeks_used, DATE '2024-03-31' - 7 * weeks_used AS window_start
FROM raw JOIN par USING (product_id) JOIN win USING (product_id) JOIN steps USING (product_id)""",
)
def ingest_stats_query(spark, sf):
    """Redaction runs as in production; its tokens change no count on these texts."""
    rows = document_reviews(spark, sf).withColumn("reason", F.lit(None).cast("string"))
    parsed = shared(spark)(dedupe_reviews(rows.drop("reason"), KEYS, [F.col("doc_id")]), "parsed")
    return ingest_stats(rows, parsed, AS_OF, detector=F.col("language") == "en")


@query(
    "product_presence",
    """SELECT bool_or(source IS NOT NULL) AS any_named, bool_or(source = 'src3') AS target_named
FROM documents""",
)
def product_presence(spark, sf):
    return intake.product_presence(table(spark, sf, "documents"), "src3", "source")


@query(
    "filter_product",
    """SELECT doc_id FROM documents WHERE lang = 'de' OR source = 'src3'""",
)
def filter_product(spark, sf):
    """German documents stand for rows without a product: they pass."""
    docs = table(spark, sf, "documents").withColumn(
        "package", F.when(F.col("lang") != "de", F.concat(F.lit(" "), "source"))
    )
    return intake.filter_product(docs, "src3").select("doc_id")


@query(
    "distinct_sources",
    "SELECT DISTINCT source, lang FROM documents",
)
def distinct_sources(spark, sf):
    return intake.distinct_values(table(spark, sf, "documents"), "source", "lang")


@query(
    "union_texts",
    """SELECT origin, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT 'documents' AS origin, text, lang FROM documents
  UNION ALL SELECT 'conversations', text, NULL FROM conversations) GROUP BY ALL""",
)
def union_texts(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("origin"), "text", "lang")
    turns = table(spark, sf, "conversations").select(F.lit("conversations").alias("origin"), "text")
    return union_raw(docs, turns).groupBy("origin", "lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")
    )


@query(
    "parse_dates",
    """SELECT event_id, CASE event_id % 14 WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL
       ELSE CAST(ts AS DATE) END AS date FROM events""",
)
def parse_dates(spark, sf):
    """Event times written in every accepted form, and in some that are refused."""
    ts, form = F.col("ts"), F.col("event_id") % 14
    iso = F.to_date("ts").cast("string")
    week = F.format_string(
        "%d-W%02d-%d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.weekofyear("ts"), F.weekday("ts") + 1
    )
    written = (
        F.when(form == 0, iso)
        .when(form == 1, F.date_format(ts, "yyyy/M/d"))
        .when(form == 2, F.date_format(ts, "d-M-yyyy"))
        .when(form == 3, F.date_format(ts, "M/d/yyyy"))
        .when(form == 4, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 5, F.concat(F.lit(" "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(form == 6, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-11:00")))
        .when(form == 7, F.date_format(ts, "yyyyMMdd"))
        .when(form == 8, week)
        .when(form == 9, F.concat(F.date_format(ts, "yyyy-M-d H:m:s"), F.lit("")))
        .when(form == 10, F.date_format(ts, "yyyy"))
        .when(form == 11, F.concat(F.date_format(ts, "yyyy"), F.lit("-02-30")))
        .when(form == 12, F.concat(F.date_format(ts, "yyyy/MM/dd"), F.lit(" 10:11:12")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS 'UTC'"))
    )
    return table(spark, sf, "events").select("event_id", dates.parse_date_text(written).alias("date"))


@query(
    "parse_epochs",
    """SELECT event_id, CAST(ts AS DATE) AS from_seconds, CAST(ts AS DATE) AS from_millis FROM events""",
)
def parse_epochs(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id",
        dates.parse_date_number(F.unix_seconds(ts)).alias("from_seconds"),
        dates.parse_date_number(F.unix_millis(ts)).alias("from_millis"),
    )


@query(
    "coerce_ratings",
    """SELECT event_id, CASE WHEN event_type <> 'error' AND value BETWEEN 1 AND 5 THEN value END AS rating
FROM events""",
)
def coerce_ratings(spark, sf):
    """Event values as text; those of one event type are no numbers."""
    written = F.when(F.col("event_type") == "error", F.concat(F.col("value").cast("string"), F.lit("d")))
    written = written.otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\t")))
    return table(spark, sf, "events").select("event_id", numbers.coerce_rating(written).alias("rating"))


@query(
    "opaque_ids",
    """SELECT doc_id, 'play-' || substr(sha256('|' || n_chars || '|' || text || '|' ||
       CASE WHEN lang = 'en' THEN '' ELSE lang END), 1, 16) AS id FROM documents""",
)
def opaque_ids(spark, sf):
    title = F.when(F.col("lang") != "en", F.col("lang"))
    return table(spark, sf, "documents").select(
        "doc_id",
        opaque_id(F.lit(None), F.col("n_chars"), F.col("text"), title).alias("id"),
    )


@query(
    "strip_text",
    f"SELECT item_id, {sql_strip('raw')} AS text FROM (SELECT item_id, chr(160) || ' ' || chr(8195) || text || chr(12288) || chr(10) AS raw FROM benchmark)",
)
def strip_text(spark, sf):
    padded = F.concat(F.lit("   "), "text", F.lit("　\n"))
    return table(spark, sf, "benchmark").select("item_id", text.strip_ws(padded).alias("text"))


@query(
    "invalid_rows",
    f"""WITH {DOCS} SELECT id, 'review ' || id || ': language must be ''en'' (got ''' || language || ''')' AS message
FROM docs WHERE language <> 'en'""",
)
def invalid_rows(spark, sf):
    return gates.source_violations(document_reviews(spark, sf))


EMAIL_SQL = r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
CLEAN = r"regexp_replace(text, '(?i)\[(?:email|phone|device_id)\]', ' ', 'g')"


# What the scan for personal data says of a text without redaction tokens.
KINDS_SQL = {
    "email pattern": f"regexp_matches(t, '{EMAIL_SQL}')",
    "phone pattern": r"regexp_matches(t, '(^|[^\p{Nd}])(\+?91[\s-]*)?[6-9]\p{Nd}{9}([^\p{Nd}]|$)')",
    "device id pattern": r"regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}([^\p{L}\p{N}_]|$)|(gaid|idfa|android[_-]?id)\s*[:=]\s*[^\s]*[\p{L}\p{N}_])')",
    "username handle": r"regexp_matches(t, '(^|[^\p{L}\p{N}_])@[A-Za-z][A-Za-z0-9._]{2,}')",
}


@query(
    "pii_flags",
    f"""SELECT doc_id, {', '.join(f'{test} AS {name.split()[0]}' for name, test in KINDS_SQL.items())}
FROM (SELECT doc_id, {CLEAN} AS t FROM documents)""".replace("AS username", "AS handle"),
)
def pii_flags(spark, sf):
    kinds = privacy.pii_kinds(F.col("text"))
    docs = spread(table(spark, sf, "documents")).select("doc_id", kinds.alias("kinds"))
    return docs.select(
        "doc_id",
        F.array_contains("kinds", "email pattern").alias("email"),
        F.array_contains("kinds", "phone pattern").alias("phone"),
        F.array_contains("kinds", "device id pattern").alias("device"),
        F.array_contains("kinds", "username handle").alias("handle"),
    )


@query(
    "redact_emails",
    f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[email]', 'g') AS text FROM documents",
)
def redact_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", privacy.redact_emails(F.col("text")).alias("text"))


# What is redacted, in the SQL engine's dialect. It has no lookarounds:
# every character that may stand before a match gets a mark after it, so that "no digit
# before" becomes "a mark or the beginning", and what follows is taken along and put back.
MARK = "\ue000"
_SEP = rf"(?:[\s.-]{MARK})?"
_PHONE = (
    rf"(?:(?:\+{MARK})?91(?:[\s-]{MARK})*)?[6-9]\p{{Nd}}{{9}}($|[^\p{{Nd}}])"
    rf"|(?:\+{MARK})?\p{{Nd}}{{1,3}}{_SEP}(?:\({MARK})?\p{{Nd}}{{2,4}}(?:\){MARK})?{_SEP}"
    rf"\p{{Nd}}{{3,4}}{_SEP}\p{{Nd}}{{3,4}}($|[^\p{{Nd}}])"
)
_W, _X = r"[\p{L}\p{N}_]", "[0-9a-f]"
_UUID = f"-{MARK}".join(f"{_X}{{{n}}}" for n in (8, 4, 4, 4, 12))
_NAMED = rf"(?:gaid|idfa|android(?:_|-{MARK})?id)(?:\s{MARK})*[:=]{MARK}(?:\s{MARK})*[^\s]*{_W}"


def _replaced(x: str, other: str, pattern: str, token: str) -> str:
    """Matches of a pattern that begin after ``other`` or at the beginning; groups 2 and 3 follow them."""
    marked = f"regexp_replace({x}, '({other})', '\\1{MARK}', 'g')"
    return f"replace(regexp_replace({marked}, '(?i)(^|{MARK})(?:{pattern})', '\\1{token}\\2\\3', 'g'), '{MARK}', '')"


_NO_WORD = f"[^{_W[1:-1]}]"
_DEVICE = rf"{_UUID}($|{_NO_WORD})|{_NAMED}|{_X}{{16,}}($|{_NO_WORD})"


def sql_redacted(x: str) -> str:
    mails = f"regexp_replace({x}, '{EMAIL_SQL}', '[email]', 'g')"
    phones = _replaced(mails, r"[^\p{Nd}]", _PHONE, "[phone]")
    return sql_strip(_replaced(phones, _NO_WORD, _DEVICE, "[device_id]"))


@query(
    "scrub_reviews",
    f"""WITH {DOCS}, c AS (SELECT doc_id, product_id, text, {sql_redacted('text')} AS v FROM docs)
SELECT doc_id, product_id, v <> {sql_strip('text')} AS redacted, v AS text FROM c WHERE v <> ''""",
)
def scrub_reviews(spark, sf):
    """All texts as they are after redaction."""
    original = document_reviews(spark, sf).select("*", F.col("text").alias("original"))
    scrubbed = scrub.scrub(original)
    redacted = F.col("text") != text.strip_ws(F.col("original"))
    return scrubbed.select("doc_id", "product_id", redacted.alias("redacted"), "text")


def _clean_sql(foreign: str) -> str:
    """The whole intake over the raw export, one window per product or none."""
    kept = f"({ENOUGH}) AND ({LATIN})" + (f" AND {foreign}" if foreign else "")
    return f"""WITH {RAW}, docs AS (SELECT * FROM cls WHERE reason IS NULL), dd AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY product_id, date, rating, text ORDER BY doc_id) AS rn FROM docs) WHERE rn = 1),
{WINDOW.replace('FROM docs', 'FROM dd')}
SELECT d.product_id, 'play-' || substr(sha256(strftime(date, '%Y-%m-%d') || '|' ||
       coalesce(CAST(rating AS VARCHAR), '') || '|' || text), 1, 16) AS id, rating, date, 'en' AS language,
       {sql_redacted('text')} AS text
FROM dd d JOIN win w ON d.product_id IS NOT DISTINCT FROM w.product_id
WHERE d.date BETWEEN DATE '2024-03-31' - 7 * w.weeks_used AND DATE '2024-03-31' AND {kept}"""


CLEANED = ["product_id", "id", "rating", "date", "language", "text"]


@query("clean_corpus", _clean_sql("language = 'en'"))
def clean_corpus(spark, sf):
    """Raw export to cleaned corpus, the whole intake."""
    detector = F.col("language") == "en"
    return ingest(raw_documents(spark, sf), AS_OF, detector=detector).reviews.select(*CLEANED)


@query("clean_corpus_all_products", _clean_sql(""))
def clean_corpus_all_products(spark, sf):
    """Rows without a product, here the German ones, are a corpus of their own."""
    reviews = ingest(raw_documents(spark, sf), AS_OF, detector=F.lit(True)).reviews
    return reviews.select(*CLEANED)


@query(
    "raw_funnel",
    f"""WITH {RAW}, docs AS (SELECT * FROM cls WHERE reason IS NULL), dd AS (
  SELECT DISTINCT product_id, date, rating, text FROM docs),
{WINDOW.replace('FROM docs', 'FROM dd')},
drops AS (SELECT product_id, count(*) AS raw_rows, count(*) FILTER (reason = 'empty_text') AS dropped_empty_text,
                 count(*) FILTER (reason = 'bad_date') AS dropped_bad_date FROM cls GROUP BY 1),
par AS (SELECT product_id, count(*) AS parsed FROM dd GROUP BY 1)
SELECT r.product_id, raw_rows, dropped_empty_text, dropped_bad_date, parsed, in_window, weeks_used
FROM drops r JOIN par p ON r.product_id IS NOT DISTINCT FROM p.product_id
JOIN win w ON r.product_id IS NOT DISTINCT FROM w.product_id""",
)
def raw_funnel(spark, sf):
    """The funnel from the raw export on, rows without a product among them."""
    done = ingest(raw_documents(spark, sf), AS_OF, detector=F.lit(True))
    stats = ingest_stats(done.classified, done.parsed, AS_OF, detector=F.lit(True))
    return stats.select(
        "product_id", "raw_rows", "dropped_empty_text", "dropped_bad_date", "parsed", "in_window", "weeks_used"
    )
