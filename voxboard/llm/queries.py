"""The operators over whole tables as named queries, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxboard.llm.common import documents
from voxboard.llm.decontaminate import contaminated
from voxboard.llm.language_id import (
    fit_language_models,
    held_out,
    labelled_documents,
    language_id,
)
from voxboard.llm.lexical_search import build_index
from voxboard.llm.line_dedup import line_dedup
from voxboard.llm.lm_score import lm_score
from voxboard.llm.packing import pack
from voxboard.llm.periodic_runs import periodic_runs, run_digests, with_planted_periods
from voxboard.llm.personal_data import KINDS, MARKS, joined_spans, personal_data
from voxboard.llm.personal_data import counted as counted_kind
from voxboard.llm.quality_rules import COUNTS, quality_rules
from voxboard.llm.repeats import repeated_spans
from voxboard.llm.secret_scan import counted, joined, secret_scan, sql_twin
from voxboard.llm.simhash import as_hex, simhash_members
from voxboard.llm.token_files import document_keys, write_tokens

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT a.doc_id, a.pos, a.line, s.k IS NOT NULL AND a.doc_id <> s.keeper AS gone
  FROM keys a LEFT JOIN shared s ON a.k = s.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM benchmark
), lists AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM texts
), items AS (
  SELECT DISTINCT id AS item_id, least(len(w), 5) AS n,
         unnest(list_transform(range(1, CAST(len(w) - least(len(w), 5) + 2 AS BIGINT)),
                               lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM lists WHERE kind = 'i' AND len(w) > 0
), lengths AS (SELECT DISTINCT n FROM items
), runs AS (
  SELECT DISTINCT id AS doc_id,
         unnest(list_transform(range(1, CAST(len(w) - n + 2 AS BIGINT)),
                               lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM lists, lengths WHERE kind = 'd' AND len(w) >= n
), sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id
), found AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM runs JOIN items USING (s) GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found * 10 >= n_shingles * 8
"""

LEXICAL_SEARCH_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), corpus AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM texts WHERE len(t) > 0
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM texts)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, corpus GROUP BY term, n_docs
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term), corpus GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# Words that match themselves at a lag are found by their last 16 words: any run has
# at least 16 words that do.
PERIODIC_RUNS_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS v
    FROM range(256) r(b))
), hashed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
                         lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, crc
), placed AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w
  FROM placed
), grams AS (
  SELECT doc_id, unnest(range(15, n)) AS i,
         unnest(list_transform(range(15, n), lambda i: array_to_string(w[i - 14:i + 1], ' '))) AS gram
  FROM texts WHERE n >= 24
), twice AS (SELECT doc_id, gram, list(i) AS places FROM grams GROUP BY ALL HAVING count(*) > 1
), matches AS (
  SELECT doc_id, i, i - j AS lag FROM (SELECT doc_id, places, unnest(places) AS i FROM twice), unnest(places) u(j) WHERE j < i
), islands AS (
  SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM matches
), stretches AS (
  SELECT doc_id, min(i) - 15 - lag AS s, max(i) - (min(i) - 15 - lag) + 1 AS length, lag
  FROM islands GROUP BY doc_id, lag, island
), runs AS (
  SELECT doc_id, s, length, min(lag) AS period FROM stretches
  WHERE length >= 24 AND length >= 3 * lag GROUP BY doc_id, s, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, list({'s': s, 'l': length, 'p': period}) AS r,
         string_agg(s || ',' || length || ',' || period || chr(10), '' ORDER BY s, period) AS lines
  FROM runs GROUP BY doc_id
), best AS (
  SELECT doc_id, s, length, period FROM runs a WHERE NOT EXISTS (
    SELECT 1 FROM runs b WHERE a.doc_id = b.doc_id AND (b.length * a.period > a.length * b.period
      OR b.length * a.period = a.length * b.period AND (b.s < a.s OR b.s = a.s AND b.period < a.period)))
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.length, b.period,
       1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(CASE WHEN r IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT coalesce(list_bool_or(
         list_transform(r, lambda q: i - 1 >= q.s + q.p AND i - 1 < q.s + q.l)), false)) END, ' ')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id LEFT JOIN best b ON t.doc_id = b.doc_id
"""


# The same counts by joins of words with the spans they stand beside.
PERSONAL_DATA_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), matched AS (
  SELECT doc_id, 0 AS k, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS f,
         string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM docs
  UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
         string_split_regex(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM docs
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'),
         string_split_regex(text, '[0-9]([\x20-]?[0-9])+') FROM docs
  UNION ALL SELECT doc_id, 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'),
         string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM docs
), each AS (SELECT doc_id, k, f, gaps, unnest(f) AS v, generate_subscripts(f, 1) AS i FROM matched WHERE len(f) > 0
), placed AS (
  SELECT doc_id, k, v, regexp_replace(v, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM each
), base AS (
  SELECT doc_id, k, s, s + length(v) AS e, k || CASE k WHEN 0 THEN lower(v) WHEN 1 THEN v ELSE digits END AS entity FROM placed
  WHERE k = 0
    OR k = 1 AND len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 3) AS INT) > 255)) = 0
    OR k = 2 AND length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j:
         CASE WHEN j % 2 = 0 THEN CAST(digits[length(digits) - j] AS INT)
              ELSE 2 * CAST(digits[length(digits) - j] AS INT) - CASE WHEN digits[length(digits) - j] >= '5' THEN 9 ELSE 0 END END)) % 10 = 0
    OR k = 3 AND length(digits) BETWEEN 9 AND 15
), split AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, string_split_regex(text, '[^\x20\x09-\x0D]+') AS gaps FROM docs
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word,
         unnest(list_transform(range(1, len(w) + 1), lambda j: length(w[j]))) AS n,
         unnest(list_transform(range(1, len(w) + 1), lambda j: length(gaps[j]))) AS gap FROM split WHERE len(w) > 0
), spots AS (
  SELECT doc_id, i, word, CAST(sum(gap + n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - n AS a, n,
         trim(lower(word), $marks) AS term FROM words
), touched AS (
  SELECT b.doc_id, b.k, b.s, b.entity, min(w.i) AS low, max(w.i) AS high, list(w.i) AS inside
  FROM base b JOIN spots w ON b.doc_id = w.doc_id AND w.a < b.e AND b.s < w.a + w.n GROUP BY ALL
), taken AS (SELECT DISTINCT doc_id, unnest(inside) AS i FROM touched
), near AS (
  SELECT DISTINCT t.doc_id, t.entity, w.i, w.term, w.a + w.n - length(ltrim(w.word, $marks)) AS s,
         w.a + w.n - length(ltrim(w.word, $marks)) + length(trim(w.word, $marks)) AS e
  FROM touched t JOIN spots w ON t.doc_id = w.doc_id AND (w.i BETWEEN t.low - 8 AND t.low - 1 OR w.i BETWEEN t.high + 1 AND t.high + 8)
  ANTI JOIN taken x ON w.doc_id = x.doc_id AND w.i = x.i WHERE w.term <> ''
), named AS (
  SELECT *, 'w' || term AS name, 0 AS level FROM near
  UNION ALL SELECT *, 's' || regexp_replace(term, '[0-9]', '#', 'g'), 1 FROM near WHERE regexp_matches(term, '[0-9]')
), counted AS (
  SELECT name, count(DISTINCT doc_id) AS docs FROM (
    SELECT doc_id, 'w' || term AS name FROM spots WHERE term <> ''
    UNION ALL SELECT doc_id, 's' || regexp_replace(term, '[0-9]', '#', 'g') FROM spots WHERE regexp_matches(term, '[0-9]'))
  GROUP BY name
), both_ AS (
  SELECT entity, name, count(DISTINCT n.doc_id) AS b FROM named n JOIN docs d ON n.doc_id = d.doc_id
  GROUP BY entity, name HAVING count(DISTINCT text) >= 3
), shares AS (SELECT entity, count(DISTINCT doc_id) / (SELECT count(*) FROM docs) AS p FROM base GROUP BY entity
), telling AS (
  SELECT entity, name FROM both_ JOIN counted USING (name) JOIN shares USING (entity)
  WHERE p < 1 AND ln((b + 2.0::DOUBLE * p) / (docs + 2.0::DOUBLE) / p) >= -ln(p) * 0.9::DOUBLE
), marks AS (
  SELECT doc_id, s, e, bool_or(level = 0) AS own, bool_or(level = 0 AND regexp_matches(term, '[0-9]')) AS shaped, bool_or(level = 1) AS shape_tells
  FROM named SEMI JOIN telling USING (entity, name) GROUP BY doc_id, s, e
), spans AS (
  SELECT doc_id, k, s, e FROM base
  UNION ALL SELECT doc_id, CASE WHEN shaped AND NOT shape_tells THEN 4 ELSE 5 END, s, e FROM marks WHERE own
), listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card,
         count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM (SELECT *, ['email', 'ip', 'card', 'phone', 'term_general', 'term_removed'][k + 1] AS kind FROM spans) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN listed l ON d.doc_id = l.doc_id
""".replace("$marks", "'" + MARKS.replace("'", "''") + "'")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = write_tokens(docs, tokenizer_path("byte_bpe_50k.json"))
    found = files.digests(files.lookup(document_keys(docs)))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(documents(spark, sf_dir))


@query("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_rules(documents(spark, sf_dir), labels)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")


@query("op5_secret_scan", sql_twin())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir)).select(
        "doc_id",
        *[counted("base_spans", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined("base_spans"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


@query("op6_line_dedup", LINE_DEDUP_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op7_decontamination", DECONTAMINATION_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), benchmark)


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = fit_language_models(labelled_documents(docs))
    found = language_id(docs.select("doc_id", "text"), models)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_members(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query("op12_personal_data", PERSONAL_DATA_SQL)
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"),
        *[counted_kind("base_spans", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined_spans("base_spans"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


@query("op13_periodic_runs", PERIODIC_RUNS_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_periods(documents(spark, sf_dir))))


@query("op11_lexical_search", LEXICAL_SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return build_index(documents(spark, sf_dir)).search(items)
