"""Quotes: candidates, selection, padding, verbatim checks and evidence views."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxboard.functions.keywords import keyword_scores, score_of
from voxboard.functions.numbers import rating_sort
from voxboard.functions.text import (
    collapse_ws,
    english_signal,
    normalise_needle,
    truncate_words,
    unwrap_quotes,
    word_count,
)
from voxboard.model import (
    ENGLISH_SIGNAL_FLOOR,
    MAX_CANDIDATES,
    MAX_PER_THEME,
    MAX_QUOTE_RATING,
    MIN_QUOTE_WORDS,
    TOP_K,
    VOCABULARY,
    Vocabulary,
)
from voxboard.operators.barrier import compute_once
from voxboard.operators.joins import join_on, join_small
from voxboard.operators.ranking import first_per, top_ranked

QUOTE_LENGTH_CAP = 240


def quote_candidates(
    labelled: DataFrame, top: DataFrame, keys: list[str], max_per_theme: int = MAX_PER_THEME
) -> DataFrame:
    """Low-rated, long enough reviews of the top themes, worst rated first.

    The cap holds per theme, so it is applied to all themes before the small
    table of top themes is joined: the large side is never joined at all.
    """
    rating = F.col("rating")
    pool = labelled.filter(rating.isNull() | (rating <= MAX_QUOTE_RATING)).filter(
        word_count(F.col("text")) >= MIN_QUOTE_WORDS
    )
    columns = [c for c in [*keys, "theme_id", "id", "rating", "text", "scores"] if c in pool.columns]
    capped = top_ranked(
        pool.select(*columns),
        [*keys, "theme_id"],
        [rating_sort(rating), F.col("id")],
        max_per_theme,
        "candidate_rank",
    )
    ranks = top.select(*keys, "theme_id", F.col("rank").alias("theme_rank"))
    return join_on(capped, ranks, [*keys, "theme_id"])


def limit_candidates(candidates: DataFrame, keys: list[str], n: int = MAX_CANDIDATES) -> DataFrame:
    """The first candidates of a group, the most an outside selector is given."""
    order = [rating_sort(F.col("rating")), F.col("id")]
    return top_ranked(candidates, keys, order, n, "list_rank")


def quote_features(candidates: DataFrame, vocab: Vocabulary = VOCABULARY) -> DataFrame:
    """Theme hits, English signal and capped length, computed once per candidate."""
    if "scores" not in candidates.columns:
        candidates = candidates.withColumn("scores", keyword_scores(F.col("text"), vocab))
    return candidates.select(
        "*",
        score_of(F.col("scores"), F.col("theme_id"), vocab).alias("theme_hits"),
        english_signal(F.col("text")).alias("signal"),
        F.least(F.length("text"), F.lit(QUOTE_LENGTH_CAP)).alias("capped_length"),
    )


def quote_order() -> list[Column]:
    return [
        F.col("theme_hits").desc(),
        rating_sort(F.col("rating")).asc(),
        F.col("signal").desc(),
        F.col("capped_length").desc(),
        F.col("id").asc(),
    ]


def select_quotes(
    candidates: DataFrame, keys: list[str], n: int = TOP_K, vocab: Vocabulary = VOCABULARY
) -> DataFrame:
    """One strong quote per top theme, then the best of the rest up to ``n``.

    The best fitting candidate of each theme comes first, in theme order; after
    those, three ever weaker requirements on theme hits and English signal.
    """
    fluent = F.col("signal") >= ENGLISH_SIGNAL_FLOOR
    strong = fluent & (F.col("theme_hits") >= 1)
    tier = F.when(strong, 1).when(fluent, 2).otherwise(3)
    # At most max_per_theme candidates share a theme, so these windows stay small.
    place = F.row_number().over(W.partitionBy(*keys, "theme_id", "tier").orderBy(*quote_order()))
    rows = (
        quote_features(candidates, vocab)
        .withColumn("tier", tier)
        .withColumn("leading", (F.col("tier") == 1) & (place == 1))
    )
    order = [
        F.when(F.col("leading"), 0).otherwise(1),
        F.when(F.col("leading"), F.col("theme_rank")).otherwise(F.col("tier")),
        *quote_order(),
    ]
    picked = top_ranked(rows, keys, order, n, "quote_rank")
    return picked.select(
        *keys,
        "quote_rank",
        "id",
        "theme_id",
        "rating",
        truncate_words(F.col("text")).alias("quote"),
    )


def pad_quotes(
    picked: DataFrame, reviews: DataFrame, groups: DataFrame, keys: list[str], n: int = TOP_K
) -> DataFrame:
    """Fill every group up to ``n`` quotes from its remaining reviews.

    ``groups`` lists the groups. Only reviews of groups that fall short go on;
    ids and wordings already used are left out, and of equal wordings the first
    counts.
    """
    # At most n picked quotes per group.
    used = picked.groupBy(*keys).agg(
        F.count("*").alias("__have"),
        F.collect_list("id").alias("__ids"),
        F.collect_list(normalise_needle(F.col("quote"))).alias("__needles"),
    )
    none = F.array().cast("array<string>")
    short = (
        join_on(groups.select(*keys).distinct(), used, keys, "left")
        .select(
            *keys,
            F.coalesce("__have", F.lit(0)).alias("__have"),
            F.coalesce("__ids", none).alias("__ids"),
            F.coalesce("__needles", none).alias("__needles"),
        )
        .filter(F.col("__have") < n)
    )
    order = [rating_sort(F.col("rating")), F.col("__words").desc(), F.col("id")]
    extra_columns = [c for c in ("theme_id",) if c in reviews.columns]
    pool = (
        join_small(reviews, short, keys)
        .filter(~F.array_contains("__ids", F.col("id")))
        .select(
            *keys,
            "__have",
            "__needles",
            "id",
            *extra_columns,
            "rating",
            "text",
        )
    )
    pool = compute_once(
        pool, {"__words": word_count(F.col("text")), "quote": truncate_words(F.col("text"))}
    ).drop("text")
    pool = (
        compute_once(pool, {"__needle": normalise_needle(F.col("quote"))})
        .filter((F.col("__needle") != "") & ~F.array_contains("__needles", F.col("__needle")))
        .drop("__needles")
    )
    # Copies are cut per wording before the shuffle, then n rows per group.
    fresh = first_per(pool, [*keys, "__needle"], order)
    extra = top_ranked(fresh, keys, order, n, "__place").filter(
        F.col("__place") <= F.lit(n) - F.col("__have")
    )
    padded = extra.select(
        *keys,
        (F.col("__have") + F.col("__place")).cast("int").alias("quote_rank"),
        "id",
        *(extra_columns or [F.lit(None).cast("string").alias("theme_id")]),
        "rating",
        "quote",
    )
    return picked.select(padded.columns).unionByName(padded)


def verbatim_in_group(
    quotes: DataFrame, reviews: DataFrame, keys: list[str], loose_space: bool = False
) -> DataFrame:
    """Add ``verbatim``: does the quote occur in any review of its group.

    A quote that names its review is first looked up there by id; only quotes
    that fail are compared with the other reviews of the group. Reviews are the
    side that streams by, so a hot group never comes together in one task.

    With ``loose_space`` any run of white space matches any other; a shortened
    quote of a text with uneven white space is found only then.
    """
    shape = collapse_ws if loose_space else (lambda c: c)
    rows = compute_once(quotes, {"__needle": shape(normalise_needle(F.col("quote")))})
    texts = reviews.select(*keys, "id", shape(F.col("text")).alias("__text"))

    def found(needles: DataFrame, on: list[str]) -> DataFrame:
        inside = F.col("__text").contains(F.col("__needle"))
        return join_small(texts, needles, on).filter(inside).select(needles.columns).distinct()

    asked = rows.filter(F.col("__needle") != "")
    hits = asked.select(*keys, "__needle").limit(0)
    if "id" in rows.columns:
        cited = found(asked.select(*keys, "id", "__needle").distinct(), [*keys, "id"])
        # Few rows, read twice: what is found here need not be looked for again.
        hits = cited.select(*keys, "__needle").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    left_over = join_on(asked.select(*keys, "__needle").distinct(), hits, [*keys, "__needle"], "left_anti")
    every = hits.unionByName(found(left_over, keys)).withColumn("__found", F.lit(True))
    return (
        join_on(rows, every, [*keys, "__needle"], "left")
        .withColumn("verbatim", F.coalesce("__found", F.lit(False)))
        .drop("__found", "__needle")
    )


def resolve_picks(
    picks: DataFrame,
    reviews: DataFrame,
    keys: list[str],
    n: int = TOP_K,
    fallback: DataFrame | None = None,
) -> DataFrame:
    """Quotes chosen outside: kept if their review exists and the words are verbatim.

    ``picks`` has ``pick_rank``, ``id`` and ``quote``. Valid picks are renumbered. A
    group with fewer than ``n`` of them gets its quotes of ``fallback`` instead, the
    result of ``select_quotes``, if that is given.
    """
    cited = picks.select(*keys, "id").distinct()
    ids = join_small(reviews.select(*keys, "id"), cited, [*keys, "id"], "left_semi").distinct()
    known = join_on(picks, ids, [*keys, "id"], "left_semi")
    valid = verbatim_in_group(known, reviews, keys).filter("verbatim").drop("verbatim")
    kept = top_ranked(valid, keys, [F.col("pick_rank")], n, "quote_rank")
    kept = kept.withColumn("quote", truncate_words(unwrap_quotes(F.col("quote"))))
    if fallback is None:
        return kept
    columns = [*keys, "quote_rank", "id", "quote"]
    full = kept.groupBy(*keys).count().filter(F.col("count") >= n).select(*keys)
    chosen = join_on(kept.select(*columns), full, keys, "left_semi")
    return chosen.unionByName(join_on(fallback.select(*columns), full, keys, "left_anti"))


GRAM_WORDS = 3
CHAR_GRAM = 8
#: Grams that a bitmap is made for, and bits of it in a byte.
MAX_GRAMS = 500_000
BITS = 7
_TOKEN = r"[\p{L}\p{N}_]+"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _inner_tokens(needle: Column) -> Column:
    """Tokens of a needle that are whole tokens of any text it occurs in.

    The first and the last token may be parts of longer ones and are left out
    where they touch the end of the needle.
    """
    return _tokens(F.regexp_replace(needle, rf"^{_TOKEN}|{_TOKEN}$", ""))


def _gram_hash(tokens: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(tokens, i + j) for j in range(GRAM_WORDS)])


Test = Callable[[Column], Column]


def _word_grams(tokens: Column, wanted: Test | None = None) -> Column:
    """Hashes of all runs of neighbouring tokens, each once. ``tokens`` is a plain column."""
    last = F.size(tokens) - GRAM_WORDS
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: _gram_hash(tokens, i))
    return F.when(last >= 0, F.array_distinct(F.filter(hashes, wanted) if wanted else hashes))


def gram_test(grams: DataFrame, hashed: Test = lambda g: g) -> Test | None:
    """A test that every ``__gram`` of a table passes and others only now and then.

    A bitmap of the hashes, sixteen bits per gram and at most some 1.2 MB, is part of the
    expression, so runs that no needle has are dropped in the array they are made in and
    never become rows. Beyond MAX_GRAMS there is no test, and the join alone drops them.
    """
    rows = grams.select("__gram").distinct()
    n = rows.count()
    if not 0 < n <= MAX_GRAMS:
        return None
    size = 1 << (16 * n // BITS).bit_length()

    def place(gram: Column) -> Column:
        return F.pmod(hashed(gram), F.lit(BITS * size))

    at = rows.select(place(F.col("__gram")).alias("p"))
    marks = at.select(F.floor(F.col("p") / BITS).alias("byte"), F.expr(f"shiftleft(1, cast(p % {BITS} as int))").alias("bit"))
    bitmap = bytearray(size)
    for byte, bit in marks.groupBy("byte").agg(F.bit_or("bit")).collect():
        bitmap[byte] = bit
    held = F.lit(bytes(bitmap))

    def test(gram: Column) -> Column:
        byte = F.substring(held, F.floor(place(gram) / BITS).cast("int") + 1, F.lit(1))
        # Seven bits a byte, so that a byte is an ASCII character.
        mark = F.pow(F.lit(2), place(gram) % BITS).cast("int")
        return F.ascii(byte.cast("string")).bitwiseAND(mark) != 0

    return test


def _char_runs(text: Column) -> Column:
    """The CHAR_GRAM characters from every position on, fewer at the end; each once.

    One pattern with one pass over the text: a lambda over positions is not compiled
    and takes microseconds for each of them.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{CHAR_GRAM}}}))."), F.lit(1)))


def _char_grams(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(__id, __gram): runs of the given numbers of characters, some more than once.

    A shorter run is the beginning of one of CHAR_GRAM characters. Rows are made by
    generators, which are compiled with the join that drops nearly all of them.
    """
    runs = texts.select("__id", F.explode(_char_runs(F.col("__text"))).alias("__gram"))
    if sizes == [CHAR_GRAM]:
        return runs
    heads = F.array(*[F.substring("__gram", 1, n) for n in sizes])
    return runs.select("__id", F.explode(heads).alias("__gram"))


def _found_needles(grams: DataFrame, needle_grams: DataFrame, texts: DataFrame) -> DataFrame:
    """Needles that occur in a text holding their rarest run.

    Runs no needle has are dropped while the texts are read. A needle with a run
    that occurs nowhere is settled without a search.
    """
    wanted = needle_grams.select("__gram").distinct()
    matched = join_small(grams, wanted, ["__gram"]).persist(StorageLevel.MEMORY_AND_DISK)
    spread = matched.groupBy("__gram").agg(F.count("*").alias("__n"))
    counted = needle_grams.join(spread, "__gram", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    rarest = first_per(counted, ["__needle"], [F.col("__n"), F.col("__gram")])
    anchors = rarest.filter(F.col("__n") > 0).select("__needle", "__gram")
    candidates = join_small(matched, anchors, ["__gram"]).select("__id", "__needle")
    return (
        join_small(texts, candidates, ["__id"])
        .filter(F.col("__text").contains(F.col("__needle")))
        .select("__needle")
    )


def verbatim_in_corpus(
    needles: DataFrame,
    corpus: DataFrame,
    needle: str = "needle",
    text: str = "text",
    id_column: str = "id",
) -> DataFrame:
    """Add ``verbatim``: does the needle occur in any text of the whole corpus.

    A containment test has no key to join on, but a text that contains a needle
    contains every run of its inner words. Each needle is looked up by its
    rarest run, and only the texts that hold it are searched, so a phrase that
    fills much of the corpus pairs up with the needles made of nothing else.
    Of the runs of a text only those that some needle may have become rows.
    Needles with too few inner words are looked up by runs of characters; that
    pass is left out when there are none.
    """
    rows = needles.withColumn("__needle", normalise_needle(F.col(needle)))
    wanted = (
        rows.filter(F.col("__needle") != "")
        .select("__needle")
        .distinct()
        .withColumn("__t", _inner_tokens(F.col("__needle")))
    )
    texts = corpus.select(F.col(id_column).alias("__id"), F.col(text).alias("__text"))
    by_words = F.size("__t") >= GRAM_WORDS
    found = []
    if not wanted.filter(by_words).isEmpty():
        # Tokens are a column before they are indexed; inside a lambda they would be
        # split again for every position.
        grams = texts.select("__id", _tokens(F.col("__text")).alias("__t"))
        asked = wanted.filter(by_words).select("__needle", F.explode(_word_grams(F.col("__t"))).alias("__gram"))
        runs = F.explode(_word_grams(F.col("__t"), gram_test(asked))).alias("__gram")
        found.append(_found_needles(grams.select("__id", runs), asked, texts))
    short = wanted.filter(~by_words).select("__needle", F.length("__needle").alias("n"))
    # At most CHAR_GRAM distinct lengths, and one that stands for all longer needles.
    lengths = sorted(r[0] for r in short.select(F.least("n", F.lit(CHAR_GRAM + 1))).distinct().collect())
    sizes = [n for n in lengths if n <= CHAR_GRAM]
    if sizes:
        # A needle that is one run is settled by the run itself; no text is searched.
        whole = short.filter(F.col("n") <= CHAR_GRAM).select(F.col("__needle").alias("__gram"))
        held = join_small(_char_grams(texts, sizes), whole, ["__gram"])
        found.append(held.select(F.col("__gram").alias("__needle")))
    if len(lengths) > len(sizes):
        longer = short.filter(F.col("n") > CHAR_GRAM).select(
            "__needle", F.explode(_char_runs(F.col("__needle"))).alias("__gram")
        )
        longer = longer.filter(F.length("__gram") == CHAR_GRAM)
        found.append(_found_needles(_char_grams(texts, [CHAR_GRAM]), longer, texts))
    if not found:
        return rows.withColumn("verbatim", F.lit(False)).drop("__needle")
    hits = reduce(DataFrame.unionByName, found).distinct().withColumn("__found", F.lit(True))
    return (
        rows.join(hits, "__needle", "left")
        .withColumn("verbatim", F.coalesce("__found", F.lit(False)))
        .drop("__needle", "__found")
    )


def filter_evidence(
    rows: DataFrame,
    mode: str,
    top: DataFrame | None = None,
    keys: list[str] = (),
    quotes: bool = False,
    vocab: Vocabulary = VOCABULARY,
) -> DataFrame:
    """Evidence of all themes, of the top themes, or of one theme.

    For quotes the top-theme view shows everything. An unknown theme id shows
    everything too.
    """
    if mode in vocab.ids:
        return rows.filter(F.col("theme_id") == mode)
    if mode == "top3" and not quotes:
        return join_small(rows, top.select(*keys, "theme_id"), [*keys, "theme_id"], "left_semi")
    return rows


def ground_actions(actions: DataFrame, quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Actions with the first quote of the same theme, if there is one."""
    first = first_per(quotes, [*keys, "theme_id"], [F.col("quote_rank")]).select(
        *keys, "theme_id", F.col("quote").alias("grounded_in")
    )
    return join_on(actions, first, [*keys, "theme_id"], "left")
