"""Padding, composing and parsing of the one-page report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxboard.functions.dates import iso_week_key, report_title
from voxboard.functions.text import (
    SPACE,
    lines_of,
    normalise_needle,
    strip_ws,
    truncate_words,
    word_count,
)
from voxboard.model import MAX_WEEKS, TOP_K, VOCABULARY, WORD_LIMIT, Vocabulary
from voxboard.operators.joins import join_on
from voxboard.operators.ranking import first_per, top_ranked

UNNAMED_PRODUCT = "unnamed product"
REPORT_NAME = "Weekly Review"
EMPTY_THEME = "Insufficient volume this window"

# Section headings and the list-item and date patterns of a report.
THEMES_HEADING = "## Top Themes"
QUOTES_HEADING = "## What Users Said"
ACTIONS_HEADING = "## Action Ideas"
ITEM = rf"^\p{{Nd}}+\.{SPACE}+(.*)$"
THEME_STATS = rf"{SPACE}*\(\p{{Nd}}+{SPACE}+reviews.*$"
WEEK_ENDING = r"(?i)week ending\s+(\d{4}-\d{2}-\d{2})"


def _vocabulary_rows(groups: DataFrame, keys: list[str], vocab: Vocabulary) -> DataFrame:
    # The vocabulary is a literal array: five rows per group, no join.
    return groups.select(*keys, F.inline(vocab.as_array()))


def pad_themes(
    top: DataFrame, groups: DataFrame, keys: list[str], k: int = TOP_K, vocab: Vocabulary = VOCABULARY
) -> DataFrame:
    """Top themes filled up to ``k`` from the vocabulary in order, with no reviews."""
    columns = ["theme_id", "label", "review_count", "avg_rating", "low_star_count", "summary"]
    real = top.select(*keys, F.lit(0).alias("__pad"), F.col("rank").alias("__at"), *columns)
    spare = _vocabulary_rows(groups, keys, vocab).select(
        *keys,
        F.lit(1).alias("__pad"),
        F.col("ordinal").alias("__at"),
        "theme_id",
        "label",
        F.lit(0).cast("long").alias("review_count"),
        F.lit(None).cast("double").alias("avg_rating"),
        F.lit(0).cast("long").alias("low_star_count"),
        F.lit(EMPTY_THEME).alias("summary"),
    )
    order = [F.col("__pad"), F.col("__at")]
    # A spare theme gives way to the real one of the same id.
    both = first_per(real.unionByName(spare), [*keys, "theme_id"], order)
    return top_ranked(both, keys, order, k, "rank").drop("__pad", "__at")


def default_actions(top: DataFrame, keys: list[str], vocab: Vocabulary = VOCABULARY) -> DataFrame:
    return top.select(
        *keys,
        F.col("rank").alias("action_rank"),
        "theme_id",
        vocab.action_of(F.col("theme_id")).alias("action"),
    )


def pad_actions(
    actions: DataFrame,
    top: DataFrame,
    groups: DataFrame,
    keys: list[str],
    n: int = TOP_K,
    vocab: Vocabulary = VOCABULARY,
) -> DataFrame:
    """Given actions, then defaults of top themes, then of the other themes.

    Given actions are all kept, even for one theme; a default is added only
    for a theme that has no action yet.
    """
    given = top_ranked(actions, keys, [F.col("action_rank")], n, "__at").select(
        *keys, F.lit(0).alias("__tier"), "__at", "theme_id", "action"
    )
    from_top = default_actions(top, keys, vocab).select(
        *keys, F.lit(1).alias("__tier"), F.col("action_rank").alias("__at"), "theme_id", "action"
    )
    from_vocab = _vocabulary_rows(groups, keys, vocab).select(
        *keys,
        F.lit(2).alias("__tier"),
        F.col("ordinal").alias("__at"),
        "theme_id",
        F.col("default_action").alias("action"),
    )
    order = [F.col("__tier"), F.col("__at")]
    # A handful of rows per theme: given actions come first and push out defaults.
    place = F.row_number().over(W.partitionBy(*keys, "theme_id").orderBy(*order))
    both = given.unionByName(from_top).unionByName(from_vocab).withColumn("__n", place)
    kept = both.filter((F.col("__tier") == 0) | (F.col("__n") == 1)).drop("__n")
    return top_ranked(kept, keys, order, n, "action_rank").drop("__tier", "__at")


def _numbered(items: Column) -> Column:
    return F.transform(
        F.slice(items, 1, TOP_K),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x),
    )


def _document(heading: Column, themes: Column, quotes: Column, actions: Column) -> Column:
    lines = F.concat(
        F.array(heading, F.lit(""), F.lit(THEMES_HEADING)),
        _numbered(themes),
        F.array(F.lit(""), F.lit(QUOTES_HEADING)),
        _numbered(F.transform(quotes, lambda q: F.concat(F.lit("“"), q, F.lit("”")))),
        F.array(F.lit(""), F.lit(ACTIONS_HEADING)),
        _numbered(actions),
    )
    return F.concat(strip_ws(F.array_join(lines, "\n")), F.lit("\n"))


def compose(
    df: DataFrame,
    product: Column,
    out: str = "body",
    themes: str = "themes",
    quotes: str = "quotes",
    actions: str = "actions",
    report_name: str = REPORT_NAME,
) -> DataFrame:
    """Add the report text; above the word limit without numbers and with shorter items.

    ``themes`` is an array of structs with label, review_count and avg_rating.
    Both lengths are columns of their own, so each is written once.
    """
    heading = F.concat(
        F.lit("# "),
        product,
        F.lit(f" {report_name} — Week Ending "),
        F.col("week_ending").cast("string"),
    )
    detailed = F.transform(
        themes,
        lambda t: F.concat(
            t["label"],
            F.lit(" ("),
            t["review_count"].cast("string"),
            F.lit(" reviews, avg "),
            F.coalesce(t["avg_rating"].cast("string"), F.lit("None")),
            F.lit(")"),
        ),
    )
    labels = F.transform(themes, lambda t: t["label"])
    both = df.withColumns(
        {
            "__full": _document(heading, detailed, F.col(quotes), F.col(actions)),
            "__brief": _document(
                heading,
                labels,
                F.transform(quotes, lambda q: truncate_words(q, 28)),
                F.transform(actions, lambda a: truncate_words(a, 22)),
            ),
        }
    )
    body = F.when(word_count(F.col("__full")) > WORD_LIMIT, F.col("__brief")).otherwise(F.col("__full"))
    return both.withColumn(out, body).drop("__full", "__brief")


def _with_banner(df: DataFrame, body: str, banner: Column, out: str) -> DataFrame:
    lines = F.col("__lines")
    rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
    text = F.concat(F.get(lines, F.lit(0)), F.lit("\n\n"), banner, F.regexp_replace(rest, r"^\n+", ""))
    return df.withColumn("__lines", lines_of(F.col(body))).withColumn(out, text).drop("__lines")


def compose_sparse(
    df: DataFrame,
    product: Column,
    out: str = "body",
    themes: str = "themes",
    quotes: str = "quotes",
    actions: str = "actions",
    report_name: str = REPORT_NAME,
    normal: str | None = None,
) -> DataFrame:
    """The report of a week with too few reviews, with a warning under the title.

    ``normal`` names the column with the report without a warning, if there is one.
    """
    review_count, weeks = F.col("review_count"), F.col("weeks_used")
    long_banner = F.format_string(
        "**Insufficient signal:** only %d Play Store reviews in the "
        f"last %d weeks after widening toward {MAX_WEEKS}. "
        "Treat themes as directional, not a full weekly read.\n\n",
        review_count,
        weeks,
    )
    short_banner = F.format_string(
        f"**Insufficient signal:** %d reviews in %d weeks (widened toward {MAX_WEEKS}).\n\n",
        review_count,
        weeks,
    )
    rows = df
    if normal is None:
        rows, normal = compose(df, product, "__long", themes, quotes, actions, report_name), "__long"
    rows = _with_banner(rows, normal, long_banner, "__long")
    rows = rows.withColumns(
        {
            "__q": F.transform(quotes, lambda q: truncate_words(q, 20)),
            "__a": F.transform(actions, lambda a: truncate_words(a, 16)),
        }
    )
    rows = compose(rows, product, "__short", themes, "__q", "__a", report_name)
    rows = _with_banner(rows, "__short", short_banner, "__short")
    body = F.when(word_count(F.col("__long")) > WORD_LIMIT, F.col("__short")).otherwise(F.col("__long"))
    return rows.withColumn(out, body).drop("__long", "__short", "__q", "__a")


def _parts(top: DataFrame, quotes: DataFrame, actions: DataFrame, keys: list[str]) -> DataFrame:
    """Themes, quotes and actions of each group as three arrays, in one shuffle."""
    fields = {"rank": "int", "theme_id": "string", "label": "string", "review_count": "long"}
    fields |= {"avg_rating": "double", "id": "string", "text": "string"}

    def rows(df: DataFrame, kind: str, **names: str) -> DataFrame:
        values = [
            (F.col(names[f]) if f in names else F.lit(None)).cast(t).alias(f) for f, t in fields.items()
        ]
        return df.select(*keys, F.lit(kind).alias("kind"), F.struct(*values).alias("part"))

    named = {f: f for f in ("rank", "theme_id", "label", "review_count", "avg_rating")}
    every = (
        rows(top, "theme", **named)
        .unionByName(rows(quotes, "quote", rank="quote_rank", id="id", text="quote", theme_id="theme_id"))
        .unionByName(rows(actions, "action", rank="action_rank", text="action", theme_id="theme_id"))
    )

    def listed(kind: str) -> Column:
        # At most TOP_K short rows per group and kind.
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("part"))))

    return every.groupBy(*keys).agg(
        listed("theme").alias("__themes"),
        listed("quote").alias("__quotes"),
        listed("action").alias("__actions"),
    )


def assemble(
    groups: DataFrame,
    top: DataFrame,
    quotes: DataFrame,
    actions: DataFrame,
    keys: list[str],
    product: Column | None = None,
    report_name: str = REPORT_NAME,
) -> DataFrame:
    """One report per group.

    ``groups`` has week_ending, review_count, weeks_used, window_widened and
    insufficient_signal. ``top`` and ``actions`` are padded; groups below the
    sparse floor get the warning variant. Reviews without a product make a report of
    their own, under a placeholder.
    """
    if product is None:
        product = F.coalesce(F.col("product_id"), F.lit(UNNAMED_PRODUCT))
    empty = F.array().cast("array<string>")
    joined = join_on(groups, _parts(top, quotes, actions, keys), keys, "left")
    rows = joined.select(
        *groups.columns,
        "__themes",
        F.col("__themes.label").alias("themes"),
        F.col("__themes.theme_id").alias("top_3"),
        F.coalesce(F.col("__quotes.text"), empty).alias("quotes"),
        F.coalesce(F.col("__quotes.id"), empty).alias("quote_ids"),
        F.coalesce(F.col("__actions.text"), empty).alias("actions"),
        F.coalesce(F.col("__actions.theme_id"), empty).alias("action_themes"),
    )
    rows = compose(rows, product, "__normal", "__themes", report_name=report_name)
    rows = compose_sparse(
        rows, product, "__sparse", "__themes", report_name=report_name, normal="__normal"
    )
    body = F.when(F.col("insufficient_signal"), F.col("__sparse")).otherwise(F.col("__normal"))
    if "week_key" not in rows.columns:
        rows = rows.withColumn("week_key", iso_week_key(F.col("week_ending")))
    title = report_title(product, F.col("week_key"), F.col("week_ending"), report_name)
    return (
        rows.withColumn("body", body)
        .drop("__normal", "__sparse", "__themes")
        .withColumns({"word_count": word_count(F.col("body")), "title": title})
    )


def parse_reports(df: DataFrame, body: str = "body") -> DataFrame:
    """Stored report text back to its sections.

    Lines are folded inside the row, so no report leaves its partition; at most
    ``TOP_K`` items per section are carried along.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(
        F.lit("").alias("section"),
        empty.alias("themes"),
        empty.alias("quotes"),
        empty.alias("actions"),
    )

    def add(items: Column, item: Column, here: Column) -> Column:
        return F.when(here & (F.size(items) < TOP_K), F.array_append(items, item)).otherwise(items)

    def step(acc: Column, raw: Column) -> Column:
        line = strip_ws(raw)
        is_heading = line.startswith("## ")
        heading = F.lower(line)
        section = (
            F.when(~is_heading, acc["section"])
            .when(heading.contains("theme"), "themes")
            .when(heading.contains("said") | heading.contains("quote"), "quotes")
            .when(heading.contains("action"), "actions")
            .otherwise("")
        )
        item = strip_ws(F.regexp_extract(line, ITEM, 1))
        is_item = ~is_heading & line.rlike(ITEM)
        return F.struct(
            section.alias("section"),
            add(
                acc["themes"],
                strip_ws(F.regexp_replace(item, THEME_STATS, "")),
                is_item & (acc["section"] == "themes"),
            ).alias("themes"),
            add(acc["quotes"], normalise_needle(item), is_item & (acc["section"] == "quotes")).alias(
                "quotes"
            ),
            add(acc["actions"], item, is_item & (acc["section"] == "actions")).alias("actions"),
        )

    text = F.col(body)
    ending = F.try_to_date(F.nullif(F.regexp_extract(text, WEEK_ENDING, 1), F.lit("")), "yyyy-MM-dd")
    folded = df.withColumn("__p", F.aggregate(lines_of(text), start, step))
    return folded.select(
        *df.columns,
        F.col("__p.themes").alias("parsed_themes"),
        F.col("__p.quotes").alias("parsed_quotes"),
        F.col("__p.actions").alias("parsed_actions"),
        ending.alias("parsed_week_ending"),
        word_count(text).alias("parsed_word_count"),
    )


def delivery_body(
    body: Column, doc_url: Column, mode: Column, report_name: str = REPORT_NAME, product: Column | None = None
) -> Column:
    """Email text: the whole report, or a link and its first twelve lines."""
    who = F.lit("") if product is None else F.concat(product, F.lit(" "))
    preview = F.array_join(F.slice(lines_of(strip_ws(body)), 1, 12), "\n")
    wanted = F.lower(strip_ws(F.coalesce(mode, F.lit("link"))))
    no_link = F.coalesce(doc_url, F.lit("")) == ""
    return F.when((wanted == "full") | no_link, body).otherwise(
        F.concat(
            who,
            F.lit(f"{report_name} is ready.\n\nDoc: "),
            doc_url,
            F.lit("\n\n---\nPreview (first lines):\n\n"),
            preview,
        )
    )
