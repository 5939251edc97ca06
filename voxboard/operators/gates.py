"""Data-quality gates of a report.

A gate is a row ``(keys, ordinal, name, ok, detail, errors)``; ``errors`` holds
messages about the report itself, so its length is bounded by the report. Faulty
reviews are counted there and listed row by row by ``source_violations``.
"""

from __future__ import annotations

import datetime as dt
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxboard.functions.privacy import pii_kinds
from voxboard.functions.text import strip_ws, word_count
from voxboard.model import (
    MAX_WEEKS,
    PII_COLUMNS,
    TOP_K,
    VOCABULARY,
    WINDOW_SLACK_DAYS,
    WORD_LIMIT,
    Vocabulary,
)
from voxboard.operators.evidence import verbatim_in_group
from voxboard.operators.joins import join_on
from voxboard.operators.windows import as_date

# Gate names in display order and the least words of an action.
GATE_NAMES = ["window", "theme_count", "quotes", "actions", "length", "privacy", "source"]
MIN_ACTION_WORDS = 4
MAX_THEMES = 5

_STRINGS = "array<string>"


def _errors(*messages: Column) -> Column:
    """The messages that apply, in order."""
    return F.array_compact(F.array(*messages))


def _bad_source() -> Column:
    return ~F.col("source").eqNullSafe(F.lit("play"))


def _bad_language() -> Column:
    return ~F.lower("language").eqNullSafe(F.lit("en"))


def invalid_rows(reviews: DataFrame) -> DataFrame:
    return reviews.filter(_bad_source() | _bad_language())


def source_violations(reviews: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One row per violation; a review may break both rules."""

    def shown(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))

    messages = _errors(
        F.when(
            _bad_source(),
            F.concat(F.lit("review "), F.col("id"), F.lit(": source must be 'play' (got "), shown(F.col("source")), F.lit(")")),
        ),
        F.when(
            _bad_language(),
            F.concat(F.lit("review "), F.col("id"), F.lit(": language must be 'en' (got "), shown(F.col("language")), F.lit(")")),
        ),
    )
    return invalid_rows(reviews).select(*keys, "id", F.explode(messages).alias("message"))


def review_profile(
    reviews: DataFrame,
    keys: list[str],
    as_of: str | dt.date | Column | None = None,
    weeks: DataFrame | Column | int | None = None,
) -> DataFrame:
    """Counts the window and source gates need, one row per group.

    ``weeks`` may be a table with the ``weeks_used`` of each group.

    Reviews are first counted per day, so the newest date of a group, which is
    the default end of the window, is found among days and not among reviews.
    """
    daily = reviews.groupBy(*keys, "date").agg(
        F.count("*").alias("__n"),
        F.count_if(_bad_source()).alias("__source"),
        F.count_if(_bad_language()).alias("__language"),
    )
    newest = F.max("date").over(W.partitionBy(*keys))
    if isinstance(weeks, DataFrame):
        daily = join_on(daily, weeks, keys, "left")
        width = F.coalesce("weeks_used", F.lit(MAX_WEEKS))
    else:
        width = F.lit(MAX_WEEKS) if weeks is None else (F.lit(weeks) if isinstance(weeks, int) else weeks)
    width = F.greatest(F.lit(8), F.least(F.lit(MAX_WEEKS), width))
    end = newest if as_of is None else as_date(as_of)
    days = daily.withColumn("__as_of", end).withColumn("__width", width)
    oldest_allowed = F.date_sub(F.col("__as_of"), F.col("__width") * 7 + WINDOW_SLACK_DAYS)
    newest_allowed = F.date_add(F.col("__as_of"), WINDOW_SLACK_DAYS)
    outside = (F.col("date") < oldest_allowed) | (F.col("date") > newest_allowed)
    return days.groupBy(*keys).agg(
        F.sum("__n").alias("n_reviews"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.sum(F.when(outside, F.col("__n")).otherwise(0)).alias("n_outside"),
        F.sum("__source").alias("n_bad_source"),
        F.sum("__language").alias("n_bad_language"),
        F.max("__as_of").alias("as_of"),
        F.max("__width").alias("max_weeks"),
        F.max(oldest_allowed).alias("oldest_allowed"),
    )


def _gate(name: str, errors: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(GATE_NAMES.index(name) + 1).alias("ordinal"),
        F.lit(name).alias("name"),
        (F.size(errors) == 0).alias("ok"),
        detail.alias("detail"),
        errors.alias("errors"),
    )


def window_gate() -> Column:
    """Dates inside the window with two days of slack, and no span above the cap."""
    span = F.datediff("date_max", "date_min")
    errors = _errors(
        F.when(
            F.col("n_outside") > 0,
            F.format_string(
                "%d review(s) outside %d-week window ending %s (oldest allowed %s)",
                "n_outside",
                "max_weeks",
                F.col("as_of").cast("string"),
                F.col("oldest_allowed").cast("string"),
            ),
        ),
        F.when(
            span > MAX_WEEKS * 7 + WINDOW_SLACK_DAYS,
            F.format_string(
                f"date span %d days exceeds {MAX_WEEKS}-week cap ({MAX_WEEKS * 7} days)", span
            ),
        ),
    )
    none = F.coalesce("n_reviews", F.lit(0)) == 0
    detail = F.format_string(
        "%s -> %s (%d reviews)",
        F.col("date_min").cast("string"),
        F.col("date_max").cast("string"),
        "n_reviews",
    )
    return _gate(
        "window",
        F.when(none, F.array(F.lit("no reviews loaded"))).otherwise(errors),
        F.when(none, F.lit("no reviews")).otherwise(detail),
    )


def source_gate() -> Column:
    errors = _errors(
        F.when(F.coalesce("n_reviews", F.lit(0)) == 0, F.lit("no reviews loaded")),
        F.when(F.col("n_bad_source") > 0, F.format_string("%d review(s): source must be 'play'", "n_bad_source")),
        F.when(F.col("n_bad_language") > 0, F.format_string("%d review(s): language must be 'en'", "n_bad_language")),
    )
    return _gate("source", errors, F.lit("Play Store only; language=en"))


def theme_errors(themes: DataFrame, keys: list[str], vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Per group the number of themes and what is wrong with their ids and labels."""
    allowed = "[" + ", ".join(f"'{i}'" for i in sorted(vocab.ids)) + "]"
    expected = vocab.label_of(F.col("theme_id"))
    place = W.partitionBy(*keys, "theme_id").orderBy("ordinal")
    rows = themes.select(*keys, "ordinal", "theme_id", "label").withColumn(
        "__copy", F.row_number().over(place)
    )
    messages = _errors(
        F.when(
            ~vocab.contains(F.col("theme_id")),
            F.concat(F.lit("unknown theme id '"), F.col("theme_id"), F.lit(f"'; must be ⊆ {allowed}")),
        ),
        F.when(
            F.col("__copy") > 1,
            F.concat(F.lit("duplicate theme id '"), F.col("theme_id"), F.lit("'")),
        ),
        F.when(
            expected.isNotNull() & ~F.col("label").eqNullSafe(expected),
            F.concat(
                F.lit("theme "), F.col("theme_id"), F.lit(": label '"), F.col("label"),
                F.lit("' != fixed label '"), expected, F.lit("'"),
            ),
        ),
    )
    # A theme table has a handful of rows per group.
    found = F.array_sort(F.collect_list(F.struct("ordinal", messages.alias("messages"))))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_themes"), F.flatten(found["messages"]).alias("theme_errors")
    )


def theme_gate() -> Column:
    n = F.coalesce("n_themes", F.lit(0).cast("long"))
    shown = F.size("themes")
    errors = F.concat(
        _errors(F.when(n > MAX_THEMES, F.format_string(f"theme count %d exceeds cap {MAX_THEMES}", n))),
        _strings("theme_errors"),
        _errors(
            F.when(
                F.col("exact") & (shown != TOP_K),
                F.format_string(f"report shows %d themes; expected top {TOP_K}", shown),
            ),
            F.when(n > MAX_THEMES, F.format_string(f"clustered theme count %d exceeds cap {MAX_THEMES}", n)),
        ),
    )
    return _gate("theme_count", errors, F.format_string("%d clustered; report top %d", n, shown))


def quote_flags(
    reports: DataFrame, reviews: DataFrame, keys: list[str], loose_space: bool = False
) -> DataFrame:
    """Each quote of each report with its place and whether it is verbatim."""
    if "quote_ids" in reports.columns:
        paired = F.arrays_zip(F.col("quote_ids").alias("id"), F.col("quotes").alias("quote"))
        quotes = reports.select(*keys, F.posexplode(paired).alias("at", "q")).select(
            *keys, (F.col("at") + 1).alias("place"), F.col("q.id").alias("id"), F.col("q.quote").alias("quote")
        )
    else:
        quotes = reports.select(*keys, F.posexplode("quotes").alias("at", "quote")).select(
            *keys, (F.col("at") + 1).alias("place"), "quote"
        )
    return verbatim_in_group(quotes, reviews, keys, loose_space)


def quote_errors(flags: DataFrame, keys: list[str]) -> DataFrame:
    message = F.format_string("quote %d is not a verbatim substring of any review text", "place")
    found = F.array_sort(F.collect_list(F.struct("place", message.alias("message"))))
    return flags.filter(~F.col("verbatim")).groupBy(*keys).agg(found["message"].alias("quote_errors"))


def quote_gate() -> Column:
    n = F.size("quotes")
    errors = F.concat(
        _errors(F.when(F.col("exact") & (n != TOP_K), F.format_string(f"expected exactly {TOP_K} quotes, got %d", n))),
        _strings("quote_errors"),
    )
    return _gate("quotes", errors, F.format_string("%d quotes; verbatim checked against corpus", n))


def _strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(_STRINGS))


def action_gate(vocab: Vocabulary = VOCABULARY, with_themes: bool = True) -> Column:
    """Three concrete actions, each for a theme that was observed or is known."""
    n = F.size("actions")
    count = _errors(F.when(F.col("exact") & (n != TOP_K), F.format_string(f"expected exactly {TOP_K} actions, got %d", n)))
    weak = F.transform(
        "actions",
        lambda a, i: F.when(strip_ws(a) == "", F.format_string("action %d is empty", i + 1)).when(
            word_count(a) < MIN_ACTION_WORDS,
            F.format_string("action %d is too short to be a concrete next step", i + 1),
        ),
    )
    parts = [count, F.array_compact(weak)]
    if with_themes:
        known = F.array_union(F.array(*[F.lit(i) for i in vocab.ids]), _strings("seen"))
        strange = F.transform(
            "action_themes",
            lambda t, i: F.when(
                ~F.array_contains(known, t),
                F.format_string("action %d theme_id '%s' is not an observed/vocab theme", i + 1, t),
            ),
        )
        parts.append(F.array_compact(strange))
    return _gate("actions", F.concat(*parts), F.format_string("%d actions", n))


def length_gate() -> Column:
    words = F.col("body_words")
    errors = _errors(
        F.when(words > WORD_LIMIT, F.format_string(f"report body word count %d exceeds {WORD_LIMIT}", words)),
        F.when(
            F.col("word_count") != words,
            F.format_string("report word_count (%d) != computed body words (%d)", "word_count", words),
        ),
    )
    return _gate("length", errors, F.format_string(f"%d words (limit {WORD_LIMIT})", words))


def privacy_gate(extra: list[Column] = (), review_columns: list[str] = ()) -> Column:
    """No personal data in the report, the theme summaries and other texts."""
    texts = F.concat(F.array("body"), _strings("summaries"), F.array(*extra).cast(_STRINGS))
    per_text = F.transform(
        texts,
        lambda t, i: F.transform(
            pii_kinds(t),
            lambda kind: F.format_string("artifact text %d contains possible PII (%s)", i + 1, kind),
        ),
    )
    leaked = sorted(set(review_columns) & set(PII_COLUMNS))
    columns = [F.lit(f"cleaned table retains personal columns: {leaked}")] if leaked else []
    in_body = F.transform(
        pii_kinds(F.col("body")), lambda kind: F.format_string("report body contains possible PII (%s)", kind)
    )
    return _gate(
        "privacy",
        F.concat(F.flatten(per_text), F.array(*columns).cast(_STRINGS), in_body),
        F.lit("no usernames / emails / phones / device ids in artifacts"),
    )


def evaluate_gates(
    reviews: DataFrame,
    themes: DataFrame,
    reports: DataFrame,
    keys: list[str],
    as_of: str | dt.date | Column | None = None,
    weeks: int | None = None,
    vocab: Vocabulary = VOCABULARY,
    extra: list[Column] = (),
    loose_space: bool = False,
) -> DataFrame:
    """All seven gates of every report, as rows.

    ``reports`` has themes, quotes, actions, body and word_count, and optionally
    quote_ids, action_themes and insufficient_signal; a report flagged as
    insufficient may have fewer than three of each. What the gates need is
    joined to each report once, and all gates are read off that row.

    The window is ``weeks`` wide, or as wide as the report's ``weeks_used`` says.
    ``extra`` are further texts of the report that must hold no personal data. With
    ``loose_space`` white space in quotes matches any other.
    """
    keys = list(keys)
    if weeks is None and "weeks_used" in reports.columns:
        weeks = reports.groupBy(*keys).agg(F.max("weeks_used").alias("weeks_used"))
    sparse = F.col("insufficient_signal") if "insufficient_signal" in reports.columns else F.lit(False)
    relaxed = F.coalesce(sparse, F.lit(False)) & (
        (F.size("quotes") < TOP_K) | (F.size("themes") < TOP_K)
    )
    rows = reports.withColumn("exact", ~relaxed)
    if "ordinal" not in themes.columns:
        position = F.array_position(F.array(*[F.lit(i) for i in vocab.ids]), F.col("theme_id"))
        themes = themes.withColumn("ordinal", position)
    observed = themes.groupBy(*keys).agg(
        F.collect_set("theme_id").alias("seen"),
        F.array_sort(F.collect_list(F.struct("ordinal", "summary")))["summary"].alias("summaries"),
    )
    parts = [
        review_profile(reviews, keys, as_of, weeks),
        theme_errors(themes, keys, vocab),
        observed,
        quote_errors(quote_flags(rows, reviews, keys, loose_space), keys),
    ]
    for part in parts:
        rows = join_on(rows, part, keys, "left")
    facts = rows.withColumn("body_words", word_count(F.col("body")))
    gates = [
        window_gate(),
        theme_gate(),
        quote_gate(),
        action_gate(vocab, "action_themes" in reports.columns),
        length_gate(),
        privacy_gate(extra, review_columns=reviews.columns),
        source_gate(),
    ]
    return facts.select(*keys, F.inline(F.array(*gates)))


def gate_report(gates: DataFrame, keys: list[str], reports: DataFrame | None = None) -> DataFrame:
    """One row per report: overall result, gates by name and all errors in order.

    With ``reports`` the row also has their ``insufficient_signal`` and ``warnings``.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("ordinal", "name", "ok", "detail", "errors"))
    )
    rows = gates.groupBy(*keys).agg(F.bool_and("ok").alias("ok"), ordered.alias("__g"))
    entry = F.transform(
        "__g",
        lambda g: F.struct(
            g["name"].alias("key"),
            F.struct(g["name"].alias("name"), g["ok"].alias("ok"), g["detail"].alias("detail"), g["errors"].alias("errors")).alias("value"),
        ),
    )
    result = rows.select(
        *keys,
        "ok",
        F.size(F.filter("__g", lambda g: ~g["ok"])).alias("n_failed"),
        F.flatten(F.col("__g.errors")).alias("errors"),
        F.map_from_entries(entry).alias("gates"),
    )
    if reports is None:
        return result
    flag = F.coalesce("insufficient_signal", F.lit(False)).alias("insufficient_signal")
    notes = sparse_warnings(reports).select(*keys, flag, "warnings")
    return join_on(result, notes, keys, "left")


def sparse_warnings(reports: DataFrame) -> DataFrame:
    """Warnings of reports below the sparse floor."""
    relaxed = (F.size("quotes") < TOP_K) | (F.size("themes") < TOP_K)
    warnings = F.when(
        F.col("insufficient_signal"),
        _errors(
            F.lit("Insufficient signal week: delivery is skipped; the local report is still gated."),
            F.when(
                relaxed,
                F.lit("Exact 3/3/3 relaxed because the window is below the sparse floor."),
            ),
        ),
    ).otherwise(F.array().cast(_STRINGS))
    return reports.withColumn("warnings", warnings)


def missing_report_gates(groups: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """A failed length gate for every group without a stored report."""
    lost = join_on(groups.select(*keys).distinct(), reports.select(*keys), keys, "left_anti")
    gate = _gate("length", F.array(F.lit("report not found")), F.lit("report missing"))
    return lost.select(*keys, F.inline(F.array(gate)))


def evaluate_stored(
    reviews: DataFrame,
    themes: DataFrame,
    stored: DataFrame,
    groups: DataFrame,
    keys: list[str],
    as_of: str | dt.date | Column | None = None,
    weeks: int | None = None,
    vocab: Vocabulary = VOCABULARY,
    loose_space: bool = False,
) -> DataFrame:
    """Gates of stored report texts, parsed back into their sections."""
    from voxboard.operators.report import parse_reports

    flags = [c for c in ("insufficient_signal", "weeks_used") if c in stored.columns]
    parsed = parse_reports(stored).select(
        *keys,
        F.col("parsed_themes").alias("themes"),
        F.col("parsed_quotes").alias("quotes"),
        F.col("parsed_actions").alias("actions"),
        "body",
        F.col("parsed_word_count").alias("word_count"),
        *flags,
    )
    present = evaluate_gates(
        reviews, themes, parsed, keys, as_of, weeks, vocab, loose_space=loose_space
    )
    return present.unionByName(missing_report_gates(groups, stored, keys))
