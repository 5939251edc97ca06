"""Likelihood of documents under a language model learned from the corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import stage
from voxboard.llm.gru import STEPS, STREAMS, Adam, Gru, log10_likelihoods, train

CLASSES = 64
#: Words that are a class of their own, beside the end of a text.
SINGLES = 24
#: Most words whose counts every task gets; all others are looked up by a join.
HEAD_WORDS = 200_000
ROUNDS = 4
RATE = 0.02
#: A task with few texts goes over them again until it has made so many updates in a round.
LEAST_UPDATES = 40
#: Bytes of text, or classes, that are worked on together.
PART_BYTES = 8 << 20
PART_CLASSES = 2 << 20
END = 0


class Codes(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], list[np.ndarray]]:
    """The different words of some texts, and each text as their numbers."""
    known = Codes()
    out = []
    for text in texts:
        words = (text or b"").lower().split()
        out.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return list(known), out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)


def endings(words: list[bytes]) -> np.ndarray:
    """The last two bytes of each word as a number."""
    return np.fromiter((int.from_bytes(w[-2:]) for w in words), np.int32, len(words))


def count_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (hash, ending, n) of their words, added up before they are sent."""
    for batch in batches:
        words, codes = numbered(batch.column(0).to_pylist())
        n = np.bincount(np.concatenate([np.zeros(0, np.int64), *codes]), minlength=len(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(word_hashes(words)), pa.array(endings(words)), pa.array(n)], ["h", "ending", "n"]
        )


@dataclass
class Vocabulary:
    """What is known of the training words: totals, classes, and counts of frequent words.

    Class 0 is the end of a text, then come ``SINGLES`` frequent words, then words by
    their last two bytes, and last all others. ``total`` and ``kinds`` are the tokens
    and different words of each class, singles aside.
    """

    tokens: int
    words: int
    texts: int
    discount: float
    head: np.ndarray
    head_counts: np.ndarray
    singles: np.ndarray
    ending_class: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.total)

    def class_of(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = self.ending_class[ending]
        if len(self.singles):
            order = np.argsort(self.singles)
            at = np.minimum(np.searchsorted(self.singles[order], hashes), len(self.singles) - 1)
            hit = self.singles[order][at] == hashes
            out = np.where(hit, order[at] + 1, out)
        return out

    def head_count(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each frequent word; 0 for a word that has to be looked up."""
        if not len(self.head):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.head, hashes), len(self.head) - 1)
        return np.where(self.head[at] == hashes, self.head_counts[at], 0)

    def unseen_log10(self) -> np.ndarray:
        """Logarithm of what a class leaves to all words that were not in training."""
        share = np.where(self.kinds > 0, self.discount * self.kinds / np.maximum(self.total, 1), 1.0)
        return np.log10(share)

    def total_log10(self) -> np.ndarray:
        return np.log10(np.maximum(self.total, 1))


def learn_vocabulary(counts: DataFrame, texts: int, head_words: int, classes: int, singles: int) -> Vocabulary:
    """Totals of a staged table (h, ending, n) of all training words; no list of all words.

    What comes to the driver is bounded: one row per ending (two bytes), per size class
    of counts, and the frequent words, of which there are at most ``head_words``.
    """
    sizes = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    by_size = counts.groupBy(sizes.alias("size")).agg(
        F.count("*").alias("kinds"), F.sum("n").alias("n"), F.min("n").alias("least"),
        F.sum((F.col("n") == 1).cast("long")).alias("once"),
        F.sum((F.col("n") == 2).cast("long")).alias("twice"),
    ).orderBy(F.desc("size")).collect()
    held, cut = 0, None
    for r in by_size:
        held += r["kinds"]
        if held > head_words:
            break
        cut = r["least"]
    head = counts.filter(F.col("n") >= cut).collect() if cut is not None else []
    head.sort(key=lambda r: r["h"])
    once, twice = sum(r["once"] for r in by_size), sum(r["twice"] for r in by_size)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    own = sorted(head, key=lambda r: (-r["n"], r["h"]))[:singles]
    by_ending = {r["ending"]: (r["n"], r["kinds"]) for r in counts.groupBy("ending").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    for r in own:
        n, kinds = by_ending[r["ending"]]
        by_ending[r["ending"]] = (n - r["n"], kinds - 1)
    room = classes - 2 - len(own)
    common = sorted(by_ending, key=lambda e: (-by_ending[e][0], e))[:room]
    ending_class = np.full(1 << 16, classes - 1, np.int64)
    for i, e in enumerate(common):
        ending_class[e] = len(own) + 1 + i
    total, kinds = np.zeros(classes), np.zeros(classes)
    for e, (n, k) in by_ending.items():
        total[ending_class[e]] += n
        kinds[ending_class[e]] += k
    return Vocabulary(
        tokens=sum(r["n"] for r in by_size) + texts,
        words=sum(r["kinds"] for r in by_size) + (texts > 0),
        texts=texts,
        discount=discount,
        head=np.array([r["h"] for r in head], np.int64),
        head_counts=np.array([r["n"] for r in head], np.int64),
        singles=np.array([r["h"] for r in own], np.int64),
        ending_class=ending_class,
        total=total,
        kinds=kinds,
    )


def encode_batches(shared, columns: int):
    """A task: documents, their text last, to classes, sums over frequent words, and the rest.

    Of each text: the number of tokens, the classes of all its tokens as bytes, how
    many are known frequent words with the sums that need their counts, and hash and
    class of every other word.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = shared.value
        free = (np.arange(own.classes) > 0) & (np.arange(own.classes) <= len(own.singles))
        less = np.where(free | (np.arange(own.classes) == END), 0.0, own.total_log10())
        ended = (np.log10(own.texts + 0.1), int(own.texts > 0))
        for whole in batches:
            for batch in parts(whole, columns, PART_BYTES):
                words, codes = numbered(batch.column(columns).to_pylist())
                hashes = word_hashes(words)
                kind = own.class_of(hashes, endings(words))
                count = own.head_count(hashes)
                known = count > 0
                base = np.where(known, np.log10(count + 0.1), 0.0)
                part = np.where(known & ~free[kind], np.log10(np.maximum(count - own.discount, 1e-9)), 0.0)
                part -= less[kind]
                size, seen, bases, inner, classes, rest, rest_kind = [], [], [], [], [], [], []
                for c in codes:
                    lost = c[~known[c]]
                    size.append(len(c) + 1)
                    seen.append(int(known[c].sum()) + ended[1])
                    bases.append(float(base[c].sum()) + ended[0])
                    inner.append(float(part[c].sum()))
                    classes.append(np.append(kind[c], END).astype(np.uint8).tobytes())
                    rest.append(hashes[lost])
                    rest_kind.append(kind[lost])
                ends = pa.array(np.cumsum([0, *map(len, rest)]).astype(np.int32))
                arrays = [
                    pa.array(size, pa.int64()),
                    pa.array(seen, pa.int64()),
                    pa.array(bases, pa.float64()),
                    pa.array(inner, pa.float64()),
                    pa.array(classes, pa.binary()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rest))),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rest_kind).astype(np.int16))),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:columns], *arrays],
                    [*batch.schema.names[:columns], *(f.split()[0] for f in ENCODED.split(", "))],
                )

    return run


ENCODED = (
    "n_tokens long, n_seen long, base double, inner double, classes binary, "
    "rest array<long>, rest_class array<short>"
)


def text_classes(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint8).astype(np.int16) for c in batch.column(column).to_pylist()]


def train_batches(shared, rate: float):
    """A task over the classes of training texts: its weights after them, times their tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Gru = shared.value
        optimiser, tokens = Adam(len(model.flat()), rate), 0
        for whole in batches:
            for batch in parts(whole, 0, PART_CLASSES):
                texts = text_classes(batch, 0)
                tokens += sum(map(len, texts))
                while True:
                    model, _ = train(model, texts, optimiser)
                    if optimiser.t >= LEAST_UPDATES or tokens > LEAST_UPDATES * STEPS * STREAMS:
                        break
        if tokens:
            flat = model.flat().astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat * tokens), pa.array(np.full(len(flat), tokens))],
                ["i", "value", "tokens"],
            )

    return run


def fit_model(encoded: DataFrame, shares: np.ndarray, rounds: int, rate: float) -> Gru:
    """Weights learned from every training text, each in one of ``rounds`` rounds.

    In a round every task starts from the same weights and goes over its own texts;
    the weights that the tasks end with are averaged by their tokens, added up by
    Spark, so what reaches the driver is one set of weights, however many tasks there are.
    """
    model = Gru.start(shares)
    sc = encoded.sparkSession.sparkContext
    texts = encoded.filter(~F.col("held_out"))
    for r in range(rounds):
        shared = sc.broadcast(model)
        own = texts.filter(F.pmod(F.xxhash64("ref"), F.lit(rounds)) == r).select("classes")
        made = own.mapInArrow(train_batches(shared, rate / (r + 1)), "i long, value double, tokens long")
        mean = made.groupBy("i").agg((F.sum("value") / F.sum("tokens")).alias("mean")).collect()
        if mean:
            flat = np.empty(len(mean))
            flat[[m["i"] for m in mean]] = [m["mean"] for m in mean]
            model = model.filled(flat)
        shared.unpersist()
    return model


def score_batches(shared, columns: int):
    """A task: documents, their classes last, to the log10 likelihood of their classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, columns, PART_CLASSES):
                found = log10_likelihoods(shared.value, text_classes(batch, columns))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:columns], pa.array(found)], [*batch.schema.names[:columns], "outer"]
                )

    return run


def held_out(folds: int = 10) -> Column:
    """Documents that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def lm_score(
    docs: DataFrame,
    held: Column | None = None,
    classes: int = CLASSES,
    singles: int = SINGLES,
    head_words: int = HEAD_WORDS,
    rounds: int = ROUNDS,
    rate: float = RATE,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Words are runs without ASCII blanks, A-Z in lower case; a text ends with one more
    token. The model is learned from documents where ``held`` is false. A word's
    probability is that of its class, given all tokens before it in the text, times its
    share of the class. Classes (frequent words, word endings, the end) are predicted by
    a gated recurrent model trained by truncated backpropagation on every training text;
    its state goes on from window to window until the text ends. Shares are counts of all
    training tokens less a discount, which is left to words not seen in training, taken
    as one. ``base_score`` is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))).

    Null and empty texts have one token, their end. Without a training document every
    word is unseen. Repeated rows each get a row. Counts of words beyond the most
    frequent ``head_words`` stay in a table and are joined by hash (64 bits).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", (held if held is not None else held_out()).alias("held_out"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    learned = rows.filter(~F.col("held_out"))
    counts = stage(
        learned.select("text").mapInArrow(count_batches, "h long, ending int, n long")
        .groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")),
        "counts",
    )
    own = learn_vocabulary(counts, learned.count(), head_words, classes, singles)
    shared = spark.sparkContext.broadcast(own)
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(encode_batches(shared, 2), f"doc_id {kind}, held_out boolean, {ENCODED}")
    # Rows are numbered in what is written, so the numbers stay whatever is lost later.
    encoded = stage(encoded.select(F.monotonically_increasing_id().alias("ref"), "*"), "encoded")

    shares = own.total.copy()
    shares[END] = own.texts
    heads = dict(zip(own.head.tolist(), own.head_counts.tolist()))
    shares[1 : len(own.singles) + 1] = [heads[h] for h in own.singles.tolist()]
    model = fit_model(encoded, shares / max(shares.sum(), 1), rounds, rate)

    rest = encoded.select("ref", F.explode(F.arrays_zip("rest", "rest_class")).alias("w")).select(
        "ref", F.col("w.rest").alias("h"), F.col("w.rest_class").cast("int").alias("class")
    )
    least = int(own.head_counts.min()) if len(own.head_counts) else None
    rare = counts.filter(F.col("n") < least) if least is not None else counts
    unseen = F.array(*[F.lit(float(x)) for x in own.unseen_log10() + own.total_log10()])
    c = F.coalesce("n", F.lit(0))
    sums = (
        rest.join(rare.select("h", "n"), "h", "left")
        .groupBy("ref")
        .agg(
            F.sum((c > 0).cast("long")).alias("rest_seen"),
            F.sum(F.log10(c + 0.1)).alias("rest_base"),
            F.sum(F.when(c > 0, F.log10(c - own.discount)).otherwise(F.get(unseen, F.col("class")))).alias("rest_inner"),
        )
    )
    kept = encoded.select("ref", "doc_id", "held_out", "n_tokens", "n_seen", "base", "inner", "classes")
    fields = f"ref long, doc_id {kind}, held_out boolean, n_tokens long, n_seen long, base double, inner double, outer double"
    scored = kept.mapInArrow(score_batches(spark.sparkContext.broadcast(model), 7), fields)
    floor = float(np.log10(own.tokens + 0.1 * (own.words + 1)))
    zero = F.lit(0)
    return scored.join(sums, "ref", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("rest_seen", zero)).alias("n_known"),
        F.lit(own.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("outer") + F.col("inner") + F.coalesce("rest_inner", zero)).alias("score"),
    )
