"""Quality of documents: statistics of simple rules, judged by an isolation forest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.llm.common import append_batches, stage

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
TREES = 200
#: Leaves of a tree at most; its height is the logarithm.
TREE_ROWS = 128
#: Share of labelled good documents that the threshold may cost.
MAX_LOSS = 0.001
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# What the forest sees, as amounts per word (lines: per line) and the mean length of a word.
RULES = (
    "symbols", "upper_words", "words_without_letters", "words_ending_in_sign", "word_chars",
    "dup_lines", "repeat_words",
)
FIELDS = ", ".join(f"{c} long" for c in COUNTS) + ", rules array<double>"


def repeated_words(codes: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice, the first included."""
    if len(codes) < 4:
        return 0
    size = int(codes.max()) + 1
    pairs = codes[:-1] * size + codes[1:]
    # Pairs are numbered anew, so that the product fits whatever the vocabulary.
    _, pairs = np.unique(pairs, return_inverse=True)
    _, kind, n = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    twice = n[kind] >= 2
    marks = np.zeros(len(codes), bool)
    for k in range(3):
        marks[k : k + len(twice)] |= twice
    return int(marks.sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts, and what the forest sees, of one whole text (null: no words)."""
    text = text or b""
    words = text.split()
    n = len(words)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    octets = np.frombuffer(text, np.uint8)
    points = int(((octets & 0xC0) != 0x80).sum())
    chars = points - sum(text.count(bytes([b])) for b in BLANKS)
    symbols = sum(text.count(bytes([b])) for b in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(codes)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    bare = sum(w.isascii() and not any(c in LETTERS for c in w) for w in words)
    signs = sum(w[-1] in SIGNS for w in words)
    per = 1.0 / n if n else 0.0
    rules = [symbols * per, upper * per, bare * per, signs * per, chars * per]
    rules += [dup_lines / max(1, len(lines)), repeats * per]
    return [n, chars, symbols, dup_lines, repeats], rules


LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SIGNS = frozenset(b"#*$%&|<>!?~^=+@")


def rule_batch(texts: list[bytes | None]) -> list[pa.Array]:
    made = [statistics(t) for t in texts]
    counts = np.array([m[0] for m in made], np.int64).reshape(-1, len(COUNTS))
    rules = pa.array([m[1] for m in made], pa.list_(pa.float64()))
    return [*(pa.array(counts[:, i]) for i in range(len(COUNTS))), rules]


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The documents with the five counts and ``rules``, one value per name in RULES."""
    return append_batches(docs, FIELDS, rule_batch)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2)
    full = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def tree_height(tree_rows: int) -> int:
    return max(1, int(np.ceil(np.log2(max(tree_rows, 2)))))


@dataclass
class IsolationForest:
    """Trees as arrays: node ``i`` has children ``2i + 1`` and ``2i + 2``.

    ``column`` is -1 at a leaf; ``depth`` is the path length that a leaf stands for,
    its own depth plus what rows left in it would still need on average. ``band`` is
    the range of each column in labelled good rows, if there are any.
    """

    column: np.ndarray
    cut: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float = 1.0
    band: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def empty(cls, trees: int, height: int, norm: float) -> IsolationForest:
        size = 2 ** (height + 1) - 1
        return cls(np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size)), norm)

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int, tree_rows: int, seed: int = 0) -> IsolationForest:
        """A forest over rows in memory, each tree over ``tree_rows`` of them."""
        rnd = np.random.default_rng(seed)
        tree_rows = min(tree_rows, len(rows))
        height = tree_height(tree_rows)
        forest = cls.empty(trees, height, float(average_path(tree_rows)) or 1.0)
        for t in range(trees):
            todo = [(0, 0, rows[rnd.choice(len(rows), tree_rows, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                if not forest.split(t, node, level, height, len(part), low, high, rnd):
                    continue
                left = part[:, forest.column[t, node]] <= forest.cut[t, node]
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return forest

    def split(
        self, t: int, node: int, level: int, height: int, n: int, low: np.ndarray, high: np.ndarray, rnd
    ) -> bool:
        """Cut a node of n rows between their lowest and highest values, or make it a leaf."""
        open_columns = np.flatnonzero(high > low)
        if level == height or n < 2 or not len(open_columns):
            self.depth[t, node] = level + average_path(n)
            return False
        c = int(rnd.choice(open_columns))
        # Below the largest value, so that neither side is empty.
        self.column[t, node] = c
        self.cut[t, node] = min(rnd.uniform(low[c], high[c]), np.nextafter(high[c], low[c]))
        return True

    def leaves(self, rows: np.ndarray, t: int) -> np.ndarray:
        """The node of a tree that each row ends in."""
        column, cut = self.column[t], self.cut[t]
        node = np.zeros(len(rows), np.int64)
        while True:
            c = column[node]
            inner = np.flatnonzero(c >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = 2 * at + 1 + (rows[inner, c[inner]] > cut[at])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / mean path of the sample): near 1 is an anomaly."""
        total = np.zeros(len(rows))
        for t in range(len(self.column)):
            total += self.depth[t][self.leaves(rows, t)]
        return 2.0 ** (-total / len(self.column) / self.norm)


def good_band(rows: np.ndarray, max_loss: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Lowest and highest value of each column in good rows, without the outermost.

    Over all columns and both ends at most ``max_loss`` of the rows lie outside.
    """
    if not len(rows):
        return None
    share = max_loss / (2 * rows.shape[1])
    low = np.quantile(rows, share, axis=0, method="lower")
    return low, np.quantile(rows, 1 - share, axis=0, method="higher")


def beyond(rows: np.ndarray, band: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """By how much each value lies outside the band, or the value if there is no band.

    A forest isolates a text with one odd word among texts without any as fast as one
    that is odd throughout; what good texts have is therefore no oddity.
    """
    if band is None:
        return rows
    return np.maximum(0.0, np.maximum(rows - band[1], band[0] - rows))


def calibrated_threshold(scores: np.ndarray, good: np.ndarray, max_loss: float) -> float:
    """Lowest score above which at most ``max_loss`` of the good rows lie.

    Without a good row nothing is known to be harmless, and nothing is rejected. The
    threshold lies halfway to the next higher score of a bad row, away from the good.
    """
    own = np.sort(scores[good])
    if not len(own):
        return np.inf
    allowed = int(max_loss * len(own))
    highest = own[len(own) - 1 - allowed]
    above = scores[~good & (scores > highest)]
    return float((highest + above.min()) / 2) if len(above) else float(highest)


def rule_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(RULES))


def range_batches(shared, level: int):
    """A task: rules to (tree, node, rows, lows, highs) of the nodes of a level of the forest so far."""
    first, width, k = 2**level - 1, 2**level, len(RULES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        trees = len(forest.column)
        n = np.zeros((trees, width), np.int64)
        low, high = np.full((trees, width, k), np.inf), np.full((trees, width, k), -np.inf)
        for batch in batches:
            rows = beyond(rule_matrix(batch.column(0)), forest.band)
            rows, times = np.unique(rows, axis=0, return_counts=True)
            for t in range(trees):
                node = forest.leaves(rows, t) - first
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node[order], 0) :]  # the others ended in leaves above
                if not len(order):
                    continue
                found, starts = np.unique(node[order], return_index=True)
                n[t, found] += np.add.reduceat(times[order], starts)
                low[t, found] = np.minimum(low[t, found], np.minimum.reduceat(rows[order], starts))
                high[t, found] = np.maximum(high[t, found], np.maximum.reduceat(rows[order], starts))
        tree, node = np.nonzero(n)
        columns = [tree, node, n[tree, node], *low[tree, node].T, *high[tree, node].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=RANGE_NAMES)

    return run


LOWS, HIGHS = [f"low_{i}" for i in range(len(RULES))], [f"high_{i}" for i in range(len(RULES))]
RANGE_NAMES = ["tree", "node", "n", *LOWS, *HIGHS]
RANGES = "tree long, node long, n long, " + ", ".join(f"{c} double" for c in (*LOWS, *HIGHS))


def grow_forest(
    rows: DataFrame, band: tuple[np.ndarray, np.ndarray] | None, trees: int, tree_rows: int, seed: int = 0
) -> IsolationForest | None:
    """Trees of at most ``tree_rows`` leaves over every row of ``rows`` (rules), level by level.

    All rows pass down all trees once per level; how many reach a node and between which
    values they lie is worked out in the tasks and put together per node, so what comes
    back is bounded by the forest. A node draws its cut from a generator of its own, and
    the forest does not depend on how the rows are dealt out. None if there is no row.
    """
    total = rows.count()
    if not total:
        return None
    height = tree_height(min(tree_rows, total))
    forest = IsolationForest.empty(trees, height, float(average_path(total)) or 1.0)
    forest.band = band
    for level in range(height + 1):
        shared = rows.sparkSession.sparkContext.broadcast(forest)
        parts = rows.select("rules").mapInArrow(range_batches(shared, level), RANGES)
        nodes = parts.groupBy("tree", "node").agg(
            F.sum("n").alias("n"), *[F.min(c).alias(c) for c in LOWS], *[F.max(c).alias(c) for c in HIGHS]
        )
        table = nodes.toArrow()
        low, high = (np.column_stack([table[c].to_numpy() for c in names]) for names in (LOWS, HIGHS))
        cut = False
        for i, (t, node, n) in enumerate(zip(*(table[c].to_pylist() for c in ("tree", "node", "n")))):
            place = 2**level - 1 + node
            rnd = np.random.default_rng([seed, t, place])
            cut |= forest.split(t, place, level, height, n, low[i], high[i], rnd)
        shared.unpersist()
        if not cut:
            break
    return forest


def ordered(values: DataFrame, rank: int) -> DataFrame:
    """The value ``v`` of a rank, from 0 for the lowest; of each task at most ``rank`` more go on."""
    return values.orderBy("v").limit(rank + 1).agg(F.max("v").alias("v"))


def label_band(good: DataFrame, max_loss: float) -> tuple[np.ndarray, np.ndarray] | None:
    """``good_band`` of all rows of a table (rules)."""
    n = good.count()
    if not n:
        return None
    share = max_loss / (2 * len(RULES))
    low, high = int(np.floor(share * (n - 1))), n - 1 - int(np.ceil((1 - share) * (n - 1)))
    ends = []
    for i in range(len(RULES)):
        value = F.get("rules", F.lit(i))
        for sign, rank in ((1, low), (-1, high)):
            found = ordered(good.select((value * sign).alias("v")), rank)
            ends.append(found.select(F.lit(i).alias("i"), F.lit(sign).alias("sign"), "v"))
    found = {(r["i"], r["sign"]): r["sign"] * r["v"] for r in reduce(DataFrame.unionAll, ends).collect()}
    return tuple(np.array([found[i, sign] for i in range(len(RULES))]) for sign in (1, -1))


def label_threshold(scored: DataFrame, max_loss: float) -> float:
    """``calibrated_threshold`` of all rows of a table (anomaly, quality)."""
    good = scored.filter("quality = 1").select((-F.col("anomaly")).alias("v"))
    n = good.count()
    if not n:
        return float("inf")
    highest = -ordered(good, int(max_loss * n)).first()["v"]
    above = scored.filter("quality <> 1").filter(F.col("anomaly") > highest).agg(F.min("anomaly")).first()[0]
    return float(highest if above is None else (highest + above) / 2)


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    max_loss: float = MAX_LOSS,
) -> IsolationForest | None:
    """A forest over ``stats`` (doc_id, counts, rules), its bands and threshold from ``labels``.

    Every row that passes the base rules is in every tree, and every labelled one
    (doc_id, quality) of them counts for the bands and the threshold. None if there is no row.
    """
    passed = stats.filter(~base_failed()).select("doc_id", "rules")
    marked = labels.filter("quality is not null").select("doc_id", "quality")
    known = stage(passed.join(marked, "doc_id").select("rules", "quality"), "labelled")
    band = label_band(known.filter("quality = 1"), max_loss)
    forest = grow_forest(passed, band, trees, tree_rows)
    if forest:
        scored = stage(with_anomaly(known, forest).select("anomaly", "quality"), "scored")
        forest.threshold = label_threshold(scored, max_loss)
    return forest


def with_anomaly(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with ``anomaly``, the score of its ``rules``."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    names = stats.columns

    def run(batches):
        for batch in batches:
            rules = rule_matrix(batch.column(names.index("rules")))
            known = shared.value
            scores = known.scores(beyond(rules, known.band)) if known else np.zeros(len(rules))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "anomaly"])

    return stats.mapInArrow(
        run, T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())])
    )


def judge(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with ``base_failed``, ``anomaly`` and ``kept``."""
    limit = float(forest.threshold) if forest else float("inf")
    return with_anomaly(stats, forest).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") <= limit)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, five counts, rules, anomaly, base_failed, kept) of every document.

    Words are runs without ASCII blanks. A text fails the base rules with fewer than
    50 words or with over half of its words in repeated three-word windows; others are
    kept unless the forest isolates them earlier than labelled good documents allow.
    Null and empty texts have no words and fail. Repeated rows each give a row, ties
    at the threshold are kept, null ids are judged like others. Texts are read once,
    in the task that reads them; what follows works on a few numbers per document.
    """
    stats = stage(rule_statistics(docs.select("doc_id", "text")).drop("text"), "rules")
    return judge(stats, fit_quality(stats, labels, **options))
