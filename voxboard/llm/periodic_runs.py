"""Runs of words that repeat with a period, found word by word, and texts without the repeats."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import append_batches, word_list
from voxboard.operators.barrier import compute_once

#: A run has at least so many words, and at least so many periods.
MIN_WORDS = 24
MIN_PERIODS = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FIELDS = "text string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
Run = tuple[int, int, int]


def diagonals(lags: np.ndarray, width: int, min_words: int, min_periods: int) -> list[Run]:
    """Runs of the periods from ``width / 2`` up to ``width``, given each word's latest lag.

    ``lags[x]`` is how far before it the ``width`` words from place ``x`` occurred last
    (0: never). Going from word to word, an occurrence makes the match of the active lag
    one longer; another lag or none ends the diagonal, which emits its run at once if it
    is long enough.
    """
    out: list[Run] = []
    active = matched = 0
    last = -2

    def ended() -> None:
        # The match covers ``width`` words from its first place, and one period before it.
        length = matched - 1 + width + active
        if active and length >= max(min_words, min_periods * active):
            out.append((last - matched + 1 - active, length, active))

    places = np.flatnonzero((lags >= width // 2) & (lags < width))
    for x, lag in zip(places.tolist(), lags[places].tolist()):
        if lag == active and x == last + 1:
            matched += 1
        else:
            ended()
            active, matched = lag, 1
        last = x
    ended()
    return out


def periodic(codes: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[Run]:
    """(start, length, period) of all runs of a sequence, by start and then period.

    A run of period p and three periods matches itself at lag p over 2p words, so a word
    is looked up together with the words before it: with the next power of two above p.
    Of a primitive period that many words do not recur any sooner, and so only the latest
    occurrence can be on a diagonal that counts: one lag is active per width, even where
    one word fills the text. Widths double as long as anything recurs; in most texts that
    ends after eight words.
    """
    n, found = len(codes), []
    if n < min_words:
        return found
    ranks = codes.astype(np.int64)
    for level in count():
        width = 1 << level
        if len(ranks) <= width:
            break
        # Numbers of twice as many words: those of the two halves, numbered anew.
        both = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        order = np.argsort(both, kind="stable")
        fresh = np.diff(both[order]) != 0
        if fresh.all():
            break
        ranks = np.empty(len(both), np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(fresh)))
        lags = np.zeros(len(both), np.int64)
        lags[order[1:]] = np.where(fresh, 0, np.diff(order))
        found += diagonals(lags, 2 * width, min_words, min_periods)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(text: bytes | None, min_words: int, min_periods: int) -> tuple[bytes, list[Run]]:
    """The words outside repeats, joined by blanks, and the runs, of one whole text."""
    words = (text or b"").split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = periodic(codes, min_words, min_periods)
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words), runs


def periodic_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS
) -> DataFrame:
    """``docs`` with ``text`` without its periodic repeats, and the ``runs`` found in it.

    Words are runs without ASCII blanks and are numbered from 0. A run is a stretch of
    words with smallest period q that no neighbouring word continues, of at least
    ``min_words`` words and ``min_periods`` periods (three or more). Of each run the first
    q words stay; a word that lies in the repeats of any run goes, the others are joined by
    single blanks. ``runs`` are sorted by start, then period.

    A null or empty text has no words, gives an empty text and no run. Rows stay where
    they are, without a shuffle: repeated rows each give a row, null ids are like others,
    an empty table gives an empty one, and a column ``runs`` of the input is replaced. A
    text costs n log n of its words at most, whatever is repeated in it.
    """
    if min_periods < 3:
        raise ValueError("a period must occur three times at least")

    def batch(texts: list[bytes | None]) -> list[pa.Array]:
        made = [collapse(t, min_words, min_periods) for t in texts]
        return [pa.array([m[0] for m in made], pa.binary()).cast(pa.string()),
                pa.array([m[1] for m in made], pa.list_(RUN))]

    return append_batches(docs, FIELDS, batch)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents of which a tenth, by the crc32 of the id, repeat a passage.

    With h that crc and g its tenth, the n words from a = g % n on become repeats of the
    first p = 1 + (n - a) div (3 + g % 8) of them. Null ids stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = h % 10 == 0
    df = compute_once(
        docs.select("doc_id", F.col("text").cast("string").alias("text")),
        {"words": F.when(chosen, word_list(F.col("text"))), "g": F.when(chosen, g)},
    )
    n = F.size("words").cast("long")
    df = compute_once(df, {"a": F.when(n > 0, F.col("g") % n)})
    df = compute_once(df, {"p": F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))})
    again = F.transform(
        "words",
        lambda w, i: F.when(i < F.col("a"), w).otherwise(
            F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
        ),
    )
    return df.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def strongest(runs: str) -> Column:
    """The run with the greatest length by period, the first of several; null without any."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(
        runs,
        first,
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, its strongest run, and sha256 of runs and text."""
    df = compute_once(found, {"best": strongest("runs")})
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return df.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )
