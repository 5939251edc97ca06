"""Keyword evidence per theme."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxboard.functions.text import whole_words
from voxboard.model import VOCABULARY, Vocabulary


def keyword_scores(c: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    """Struct with the number of keyword hits for each theme."""
    return F.struct(
        *[
            F.coalesce(F.regexp_count(c, F.lit(whole_words(t.pattern))), F.lit(0)).alias(t.theme_id)
            for t in vocab.themes
        ]
    )


def keyword_hint(c: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    """First theme, in vocabulary order, with any hit."""
    return F.coalesce(
        *[F.when(c.rlike(whole_words(t.pattern)), F.lit(t.theme_id)) for t in vocab.themes]
    )


def hint_from_scores(scores: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    return F.coalesce(
        *[F.when(scores[t.theme_id] > 0, F.lit(t.theme_id)) for t in vocab.themes]
    )


def best_score(scores: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    return F.greatest(*[scores[i] for i in vocab.ids])


def heuristic_from_scores(scores: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    """Theme with most hits; ties by fixed preference; no hit at all: the default."""
    best = best_score(scores, vocab)
    tied = [F.when(scores[i] == best, F.lit(i)) for i in vocab.preference]
    return F.when(best > 0, F.coalesce(*tied)).otherwise(F.lit(vocab.default))


def confident_from_scores(
    scores: Column, min_score: int = 1, vocab: Vocabulary = VOCABULARY
) -> Column:
    """The single theme with most hits if it reaches ``min_score``; ties are null."""
    if min_score <= 0:
        return F.lit(None).cast("string")
    best = best_score(scores, vocab)
    winners = reduce(
        lambda a, b: a + b, [(scores[i] == best).cast("int") for i in vocab.ids]
    )
    winner = F.coalesce(*[F.when(scores[i] == best, F.lit(i)) for i in vocab.ids])
    return F.when((best >= min_score) & (winners == 1), winner)


def score_of(scores: Column, theme_id: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    """Hits of the theme a row carries."""
    return F.coalesce(
        *[F.when(theme_id == i, scores[i]) for i in vocab.ids], F.lit(0)
    )


def heuristic_theme(c: Column, vocab: Vocabulary = VOCABULARY) -> Column:
    return heuristic_from_scores(keyword_scores(c, vocab), vocab)


def confident_theme(c: Column, min_score: int = 1, vocab: Vocabulary = VOCABULARY) -> Column:
    return confident_from_scores(keyword_scores(c, vocab), min_score, vocab)
