"""Quality gates of composed reports, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxboard.catalogue.adapters import (
    CANDIDATES,
    DOCS,
    SCORED,
    TEST_VOCABULARY,
    VOCAB,
    sql_needle,
    sql_word_count,
    table,
)
from voxboard.catalogue.evidence import CHOSEN
from voxboard.catalogue.intake import CLEAN, KINDS_SQL
from voxboard.catalogue.registry import query
from voxboard.catalogue.reports import PARTS, composed, staged_reviews
from voxboard.functions.text import word_count
from voxboard.operators import gates, metrics, themes

KEYS = ["product_id"]
CHAIN = f"WITH {VOCAB}, {DOCS}, {SCORED}, {CANDIDATES}, {CHOSEN}, {PARTS}"
# The personal-data patterns, in the SQL engine's dialect.
PII = r"regexp_matches({x}, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b|(^|[^\p{Nd}])(\+?91[\s-]*)?[6-9]\p{Nd}{9}([^\p{Nd}]|$)|(^|[^\p{L}\p{N}_])@[A-Za-z][A-Za-z0-9._]{2,}|(^|[^\p{L}\p{N}_])([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}([^\p{L}\p{N}_]|$)|(gaid|idfa|android[_-]?id)\s*[:=]\s*[^\s]*[\p{L}\p{N}_])')"


def checks(spark, sf):
    reviews = staged_reviews(spark, sf)
    table_ = themes.theme_counts(reviews, KEYS, TEST_VOCABULARY)
    reports = composed(spark, sf, reviews=reviews)
    return gates.evaluate_gates(reviews, table_, reports, KEYS, vocab=TEST_VOCABULARY)


# Window: dates of the documents span 99 days, so this gate fails for most.
VERDICTS = f"""pr AS (
  SELECT product_id, count(*) AS n, min(date) AS lo, max(date) AS hi,
         count(*) FILTER (language <> 'en') AS foreign_n FROM lab GROUP BY product_id),
outs AS (SELECT l.product_id, count(*) FILTER (l.date < p.hi - 86) AS n_out FROM lab l JOIN pr p USING (product_id) GROUP BY 1),
nq AS (SELECT product_id, count(*) AS n_quotes FROM padded GROUP BY 1),
nt AS (SELECT product_id, count(*) AS n_themes FROM agg GROUP BY 1),
v AS (
  SELECT c.product_id, c.body, pr.*EXCLUDE (product_id), n_out, n_quotes, n_themes
  FROM composed c JOIN pr USING (product_id) JOIN outs USING (product_id)
  JOIN nq USING (product_id) JOIN nt USING (product_id)),
verdicts AS (
  SELECT product_id, 1 AS ordinal, 'window' AS name, n_out = 0 AND hi - lo <= 86 AS ok FROM v
  UNION ALL SELECT product_id, 2, 'theme_count', n_themes <= 5 AND n_themes >= 3 FROM v
  UNION ALL SELECT product_id, 3, 'quotes', n_quotes = 3 AND NOT EXISTS (
      SELECT 1 FROM padded q WHERE q.product_id = v.product_id AND NOT EXISTS (
        SELECT 1 FROM lab l WHERE l.product_id = q.product_id
        AND contains(l.text, rtrim(q.quote, '…')))) FROM v
  UNION ALL SELECT product_id, 4, 'actions', n_themes >= 3 FROM v
  UNION ALL SELECT product_id, 5, 'length', {sql_word_count('body')} <= 250 FROM v
  UNION ALL SELECT product_id, 6, 'privacy', NOT {PII.replace('{x}', 'body')} FROM v
  UNION ALL SELECT product_id, 7, 'source', foreign_n = 0 FROM v)"""


@query("gate_checks", f"{CHAIN}, {VERDICTS} SELECT product_id, CAST(ordinal AS INTEGER) AS ordinal, name, ok FROM verdicts")
def gate_checks(spark, sf):
    return checks(spark, sf).select("product_id", "ordinal", "name", "ok")


@query(
    "gate_report",
    f"""{CHAIN}, {VERDICTS}
SELECT product_id, bool_and(ok) AS ok, CAST(count(*) FILTER (NOT ok) AS INTEGER) AS n_failed,
       string_agg(name, ',' ORDER BY ordinal) FILTER (NOT ok) AS failed
FROM verdicts GROUP BY product_id""",
)
def gate_report(spark, sf):
    rows = gates.gate_report(checks(spark, sf), KEYS)
    failed = F.filter(F.array(*[F.lit(n) for n in gates.GATE_NAMES]), lambda n: ~F.element_at("gates", n)["ok"])
    return rows.select(
        "product_id", "ok", "n_failed", F.nullif(F.array_join(failed, ","), F.lit("")).alias("failed")
    )


@query(
    "quote_verbatim",
    f"""{CHAIN} SELECT product_id, CAST(quote_rank AS INTEGER) AS place, id,
       EXISTS (SELECT 1 FROM lab l WHERE l.product_id = q.product_id
               AND contains(l.text, rtrim(q.quote, '…'))) AS verbatim FROM padded q""",
)
def quote_verbatim(spark, sf):
    """Quotes cut from texts with uneven white space are not verbatim any more."""
    reviews = staged_reviews(spark, sf)
    rows = gates.quote_flags(composed(spark, sf, reviews=reviews), reviews, KEYS)
    return rows.select("product_id", "place", "id", "verbatim")


# A stored text is read back line by line: of a quote its first line counts, and whether
# that occurs in a review. The text of one product is lost.
FIRST_LINE = sql_needle("regexp_split_to_array(q.quote, '[' || chr(10) || ']')[1]")
STORED = VERDICTS.replace("contains(l.text, rtrim(q.quote, '…'))", f"contains(l.text, {FIRST_LINE})")


# What the scan says of the body, once as the first text and once as the report.
_KINDS = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{k}' END" for k, t in KINDS_SQL.items()) + "], lambda k: k IS NOT NULL)"
_SAYS = "list_transform(kinds, lambda k: '{} contains possible PII (' || k || ')')"
_BODY_KINDS = _KINDS.replace("(t,", f"({CLEAN.replace('(text,', '(body,')},")
_BODY_SAYS = " || '; ' || ".join(
    f"array_to_string({_SAYS.format(x).replace('kinds,', _BODY_KINDS + ',', 1)}, '; ')" for x in ("artifact text 1", "report body")
)
_DAY = "strftime({}, '%Y-%m-%d')"
STORED_ERRORS = f"""wrong AS (
  SELECT product_id, string_agg('quote ' || quote_rank || ' is not a verbatim substring of any review text', '; ' ORDER BY quote_rank) AS said
  FROM padded q WHERE NOT EXISTS (SELECT 1 FROM lab l WHERE l.product_id = q.product_id AND contains(l.text, {FIRST_LINE}))
  GROUP BY product_id),
errors AS (
  SELECT product_id, name, concat_ws('; ', CASE name
    WHEN 'window' THEN concat_ws('; ',
      CASE WHEN n_out > 0 THEN n_out || ' review(s) outside 12-week window ending ' || {_DAY.format('hi')} ||
           ' (oldest allowed ' || {_DAY.format('hi - 86')} || ')' END,
      CASE WHEN hi - lo > 86 THEN 'date span ' || (hi - lo) || ' days exceeds 12-week cap (84 days)' END)
    WHEN 'theme_count' THEN CASE WHEN n_themes < 3 THEN 'report shows ' || n_themes || ' themes; expected top 3' END
    WHEN 'quotes' THEN concat_ws('; ', CASE WHEN n_quotes <> 3 THEN 'expected exactly 3 quotes, got ' || n_quotes END, said)
    WHEN 'actions' THEN CASE WHEN n_themes < 3 THEN 'expected exactly 3 actions, got ' || n_themes END
    WHEN 'length' THEN CASE WHEN {sql_word_count('body')} > 250 THEN 'report body word count ' || {sql_word_count('body')} || ' exceeds 250' END
    WHEN 'source' THEN CASE WHEN foreign_n > 0 THEN foreign_n || ' review(s): language must be ' || chr(39) || 'en' || chr(39) END
    ELSE CASE WHEN NOT ok THEN {_BODY_SAYS} END END) AS errors
  FROM verdicts JOIN v USING (product_id) LEFT JOIN wrong USING (product_id))"""


@query(
    "stored_report_gates",
    f"""{CHAIN}, {STORED}, {STORED_ERRORS}
SELECT product_id, CAST(ordinal AS INTEGER) AS ordinal, name, ok, coalesce(errors, '') AS errors
FROM verdicts JOIN errors USING (product_id, name) WHERE product_id <> 'src0'
UNION ALL SELECT 'src0', 5, 'length', false, 'report not found' FROM verdicts WHERE product_id = 'src0' AND ordinal = 5""",
)
def stored_report_gates(spark, sf):
    """Stored texts parsed and checked; the product without a stored text fails."""
    reviews = staged_reviews(spark, sf)
    stored = composed(spark, sf, reviews=reviews).filter("product_id <> 'src0'").select("product_id", "body")
    table_ = themes.theme_counts(reviews, KEYS, TEST_VOCABULARY)
    groups = reviews.select("product_id").distinct()
    rows = gates.evaluate_stored(reviews, table_, stored, groups, KEYS, vocab=TEST_VOCABULARY)
    return rows.select("product_id", "ordinal", "name", "ok", F.array_join("errors", "; ").alias("errors"))


# Documents as report bodies, with actions, word counts and column names that are right in
# some and wrong in others, each on its own ground.
_N_WORDS = sql_word_count("text")
MADE = f"""docs AS (SELECT doc_id, n_chars AS n, text, {CLEAN} AS t FROM documents),
made AS (
  SELECT doc_id, n, n % 2 = 0 AS exact, {_N_WORDS} AS words, {_N_WORDS} + CAST(n % 6 = 0 AS INTEGER) AS stored,
         {_KINDS} AS kinds,
         [CASE n % 3 WHEN 0 THEN 'fix it now' WHEN 1 THEN ' ' ELSE 'show the fee before payment' END,
          'answer tickets within two days', 'test each release on old phones'][1:CASE WHEN n % 4 = 0 THEN 2 ELSE 3 END] AS actions,
         [CASE WHEN n % 7 = 0 THEN 'weather' ELSE 'fees_funding' END, 'customer_support', 'app_reliability'] AS ids
  FROM docs),
said AS (
  SELECT doc_id, 'actions' AS name, len(actions) || ' actions' AS detail, list_concat(list_concat(
      CASE WHEN exact AND len(actions) <> 3 THEN ['expected exactly 3 actions, got ' || len(actions)] ELSE [] END,
      CASE n % 3 WHEN 0 THEN ['action 1 is too short to be a concrete next step'] WHEN 1 THEN ['action 1 is empty'] ELSE [] END),
      CASE WHEN n % 7 = 0 THEN ['action 1 theme_id ''weather'' is not an observed/vocab theme'] ELSE [] END) AS errors FROM made
  UNION ALL SELECT doc_id, 'length', words || ' words (limit 250)', list_concat(
      CASE WHEN words > 250 THEN ['report body word count ' || words || ' exceeds 250'] ELSE [] END,
      CASE WHEN stored <> words THEN ['report word_count (' || stored || ') != computed body words (' || words || ')'] ELSE [] END) FROM made
  UNION ALL SELECT doc_id, 'privacy', 'no usernames / emails / phones / device ids in artifacts', list_concat(list_concat(
      {_SAYS.format('artifact text 1')}, {_SAYS.format('artifact text 3')}), {_SAYS.format('report body')}) FROM made)"""


@query(
    "failing_gates",
    f"""WITH {MADE} SELECT doc_id, name, len(errors) = 0 AS ok, detail, array_to_string(errors, '; ') AS errors FROM said""",
)
def failing_gates(spark, sf):
    """Actions, length and privacy, failing each on its own ground, with what they say."""
    n = F.col("n_chars")
    first = F.when(n % 3 == 0, "fix it now").when(n % 3 == 1, " ").otherwise("show the fee before payment")
    actions = F.array(first, F.lit("answer tickets within two days"), F.lit("test each release on old phones"))
    strange = F.when(n % 7 == 0, "weather").otherwise("fees_funding")
    reports = table(spark, sf, "documents").select(
        "doc_id",
        (n % 2 == 0).alias("exact"),
        F.col("text").alias("body"),
        word_count(F.col("text")).alias("body_words"),
        (word_count(F.col("text")) + (n % 6 == 0).cast("int")).alias("word_count"),
        F.slice(actions, 1, F.when(n % 4 == 0, 2).otherwise(3)).alias("actions"),
        F.array(strange, F.lit("customer_support"), F.lit("app_reliability")).alias("action_themes"),
        F.lit(None).cast("array<string>").alias("seen"),
        F.array("lang", "text").alias("summaries"),
    )
    found = F.array(gates.action_gate(), gates.length_gate(), gates.privacy_gate())
    rows = reports.select("doc_id", F.inline(found))
    return rows.select("doc_id", "name", "ok", "detail", F.array_join("errors", "; ").alias("errors"))


# Documents as records of scored reports.
@query(
    "eval_score",
    """SELECT doc_id, lang = 'en' AND n_chars > 500 AS compliance,
       (CAST(n_chars % 5 AS DOUBLE) + n_chars % 4 + n_chars % 3 + n_chars % 7 + n_chars % 2) / 5 AS quality
FROM documents""",
)
def eval_score(spark, sf):
    n = F.col("n_chars")
    scores = table(spark, sf, "documents").select(
        "doc_id",
        (F.col("lang") == "en").alias("C1"),
        (n > 500).alias("C2"),
        *[(n % m).cast("double").alias(q) for q, m in [("Q1", 5), ("Q2", 4), ("Q3", 3), ("Q4", 7), ("Q6", 2)]],
    )
    return metrics.eval_score(scores, ["doc_id"], ["C1", "C2"], ["Q1", "Q2", "Q3", "Q4", "Q6"])
