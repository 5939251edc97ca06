"""Language of a text by character models with Kneser-Ney smoothing."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxboard.llm.common import append_batches, hash_share, hash_unit

ORDER = 4
#: Labelled documents per language that a model is fitted on, and that it is calibrated on.
FIT_DOCUMENTS = 1500
CALIBRATION_DOCUMENTS = 500
#: So many letters go with eight bits a character; a larger alphabet gets wider ones.
LETTERS = 254
#: Languages that share a table of grams; a table has a column for each of them.
BLOCK = 4
SPARE = 2.0
UNKNOWN = "und"
FIELDS = "lang_pred string, score double, cross_entropy double, rejected boolean"
#: Characters that are scored at once.
CHUNK = 1 << 20


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point the lower-case letter that stands for it, or 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letters(text: bytes | None) -> np.ndarray:
    """Letters of a text, with one 0 for each run of other characters."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = letter_table()[np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    return codes[keep]


def code_width(alphabet: np.ndarray) -> int:
    """Bits a character, so that each learned letter, the break and "other" have a code."""
    return next(w for w in (8, 16, 21) if len(alphabet) + 2 <= 1 << w)


def grams(codes: np.ndarray, order: int, width: int = 8) -> np.ndarray:
    """Each character with the ``order - 1`` before it, ``width`` bits a character.

    Up to 64 bits this is a hash without collisions; a text starts after zeros.
    """
    padded = np.concatenate((np.zeros(order - 1, np.uint64), codes.astype(np.uint64)))
    out = np.zeros(len(codes), np.uint64)
    for k in range(order):
        out = (out << np.uint64(width)) | padded[k : k + len(codes)]
    return out


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a sorted array, and which keys are there at all."""
    at = np.searchsorted(sorted_keys, keys)
    np.minimum(at, max(len(sorted_keys) - 1, 0), out=at)
    return at, (sorted_keys[at] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


@dataclass
class Level:
    """One order of a block of languages' models, in sorted hash arrays.

    ``keys`` are the grams that any language of the block has, ``probability`` has a column per
    language. ``contexts`` and ``weight`` are what goes to the next shorter order.
    """

    keys: np.ndarray
    probability: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@dataclass
class CharacterModels:
    languages: list[str]
    alphabet: np.ndarray
    order: int
    blocks: list[list[Level]] = field(default_factory=list)
    limits: np.ndarray | None = None
    noise: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.width = code_width(self.alphabet)
        # 65,534 letters and fewer leave room for four characters, more of them for three.
        self.order = min(self.order, 64 // self.width)
        self.kinds = LETTERS + 2 if self.width == 8 else len(self.alphabet) + 2

    def codes(self, text: bytes | None) -> np.ndarray:
        """0 for a break, from 1 the learned letters, the highest code for any other letter."""
        found = letters(text)
        at, known = find(self.alphabet, found)
        out = np.where(found == 0, 0, np.where(known, at + 1, (1 << self.width) - 1))
        return out.astype(np.uint8 if self.width == 8 else np.uint32)

    def grams(self, text: bytes | None) -> np.ndarray:
        return grams(self.codes(text), self.order, self.width)

    def mask(self, order: int) -> np.uint64:
        return np.uint64((1 << (self.width * order)) - 1)

    def fit(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        """``counts``: sorted grams of the full order and their counts, per language."""
        for at in range(0, len(self.languages), BLOCK):
            self.fit_block([counts[name] for name in self.languages[at : at + BLOCK]])

    def fit_block(self, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The models of the next languages; none depends on another language."""
        by_order: dict[int, list] = {self.order: own}
        width, levels = np.uint64(self.width), []
        for m in range(self.order - 1, 0, -1):
            # A shorter gram counts the characters that come before it.
            by_order[m] = [np.unique(keys & self.mask(m), return_counts=True) for keys, _ in by_order[m + 1]]
        for m in range(1, self.order + 1):
            keys = np.unique(np.concatenate([k for k, _ in by_order[m]]))
            contexts = np.unique(keys >> width)
            probability = np.empty((len(keys), len(own)))
            weight = np.ones((len(contexts), len(own)))
            below = self.in_block(levels, len(own), keys, m - 1)
            place = np.searchsorted(contexts, keys >> width)
            for l, (k, c) in enumerate(by_order[m]):
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                context = np.searchsorted(contexts, k >> width)
                total = np.bincount(context, c, len(contexts))
                kinds = np.bincount(context, minlength=len(contexts))
                seen = total > 0
                weight[seen, l] = discount * kinds[seen] / total[seen]
                probability[:, l] = weight[place, l] * below[:, l]
                at = np.searchsorted(keys, k)
                probability[at, l] += (c - discount) / total[context]
            levels.append(Level(keys, probability, contexts, weight))
        self.blocks.append(levels)

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Interpolated probability of each gram's last character, by language."""
        found, n = [], len(self.languages)
        for i, levels in enumerate(self.blocks):
            found.append(self.in_block(levels, min(BLOCK, n - i * BLOCK), keys, order))
        return found[0] if len(found) == 1 else np.concatenate(found, axis=1)

    def in_block(self, levels: list[Level], n: int, keys: np.ndarray, order: int) -> np.ndarray:
        """``probability`` by the ``n`` languages of a block.

        A gram that no language has comes from the next shorter one, times the weight
        that its context leaves over; a context that a language lacks leaves all.
        """
        if order == 0:
            return np.full((len(keys), n), 1.0 / self.kinds)
        level = levels[order - 1]
        if order < self.order:
            keys = keys & self.mask(order)
        at, known = find(level.keys, keys)
        out = level.probability[at]
        lost = np.flatnonzero(~known)
        if len(lost):
            rest = keys[lost]
            place, seen = find(level.contexts, rest >> np.uint64(self.width))
            weight = np.where(seen[:, None], level.weight[place], 1.0)
            out[lost] = weight * self.in_block(levels, n, rest, order - 1)
        return out

    def cross_entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character by language, and the number of characters; texts are whole."""
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        chunk = max(1, CHUNK // max(1, len(self.blocks)))
        for i, text in enumerate(texts):
            codes = self.codes(text)
            sizes[i] = len(codes) if codes.any() else 0
            keys = grams(codes, self.order, self.width)
            for at in range(0, len(keys) if sizes[i] else 0, chunk):
                out[i] -= np.log(self.probability(keys[at : at + chunk], self.order)).sum(axis=0)
        return out / np.maximum(sizes, 1)[:, None], sizes

    def calibrate(self, names: np.ndarray, entropies: np.ndarray, sizes: np.ndarray) -> None:
        """Limits from documents of known language that the models have not seen.

        A language's limit lies halfway between its own documents' cross-entropy and
        the lowest that another language's documents have under its model, plus what
        texts of a given length vary by: ``SPARE`` times the largest deviation times the
        square root of its length, divided by the square root of the length at hand. A
        text of a few words says little, and stays unless it is far off.
        """
        n = len(self.languages)
        self.limits, self.noise = np.full(n, np.log(self.kinds)), np.zeros(n)
        for l, name in enumerate(self.languages):
            own = (names == name) & (sizes > 0)
            if not own.any():
                continue
            centre = np.average(entropies[own, l], weights=sizes[own])
            others = [
                np.average(entropies[o, l], weights=sizes[o])
                for other in self.languages
                if other != name and (o := (names == other) & (sizes > 0)).any()
            ]
            self.limits[l] = (centre + min([*others, np.log(self.kinds)])) / 2
            self.noise[l] = SPARE * ((entropies[own, l] - centre) * np.sqrt(sizes[own])).max()

    def predict(self, texts: list[bytes | None]) -> list[pa.Array]:
        if not self.languages:
            blank = [not letters(t).any() for t in texts]
            zeros = pa.array(np.zeros(len(texts)))
            return [pa.array([UNKNOWN] * len(texts), pa.string()), zeros, zeros, pa.array(blank, pa.bool_())]
        entropies, sizes = self.cross_entropies(texts)
        best = entropies.argmin(axis=1) if len(texts) else np.zeros(0, np.int64)
        lowest = entropies[np.arange(len(texts)), best]
        some = sizes > 0
        # Weight of the winner if the text had at most 40 characters: longer ones are sure.
        gaps = (entropies - lowest[:, None]) * np.minimum(sizes, 40)[:, None]
        score = np.where(some, 1.0 / np.exp(-gaps).sum(axis=1), 0.0)
        limit = self.limits[best] + self.noise[best] / np.sqrt(np.maximum(sizes, 1))
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
        return [
            pa.array(names, pa.string()),
            pa.array(score),
            pa.array(np.where(some, lowest, 0.0)),
            pa.array(~some | (lowest > limit)),
        ]


def labelled_sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """(lang, n, text): the same documents on every run, by a hash of their ids.

    Rows that cannot be among the first are passed over where they are read, and only
    the keys of the chosen ones go back to the texts.
    """
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    body = F.xxhash64("text").alias("body")
    ids = labelled.join(F.broadcast(sizes), "lang").select(
        "lang", "id", body, "size", hash_unit("id").alias("h")
    )
    ids = ids.filter(F.col("h") <= hash_share(F.col("size"), per_language))
    order = W.partitionBy("lang").orderBy("h", "id", "body")
    ranked = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    chosen = ranked.groupBy("lang", "id", "body").agg(F.min("n").alias("n"))
    texts = labelled.select("lang", "id", body, "text")
    # Equal rows count once, however many there are.
    return texts.join(F.broadcast(chosen), ["lang", "id", "body"]).dropDuplicates(["lang", "id", "body"])


def gram_counts(alphabet: np.ndarray, order: int):
    """A task over (lang, text): to (lang, gram, count), added up within the batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = CharacterModels([], alphabet, order)
        for batch in batches:
            totals: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = np.unique(models.grams(text), return_counts=True)
                own = totals.setdefault(lang, Counter())
                for k, c in zip(keys.view(np.int64).tolist(), n.tolist()):
                    own[k] += c
            rows = [(lang, k, c) for lang, own in totals.items() for k, c in own.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                ["lang", "gram", "n"],
            )

    return run


def letter_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [letters(t) for t in batch.column(0).to_pylist()]
        values, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(values, np.int64)), pa.array(np.asarray(n, np.int64))], ["letter", "n"]
        )


def fit_language_models(
    labelled: DataFrame,
    order: int = ORDER,
    fit_documents: int = FIT_DOCUMENTS,
    calibration_documents: int = CALIBRATION_DOCUMENTS,
) -> CharacterModels:
    """Models of the languages in ``labelled`` (id, lang, text; none null).

    Every language is learned, and every letter of the sample has a code of its own.
    Bounded on purpose: at most ``fit_documents`` whole texts per language, and
    ``calibration_documents`` more for the limits. Grams are counted in the tasks
    and added up by Spark; their number is bounded by the sample, and the driver gets
    those of ``BLOCK`` languages at a time. Without a labelled row there is no language.
    """
    sample = labelled_sample(labelled, fit_documents + calibration_documents)
    kept = sample.select("lang", F.col("text").cast("binary").alias("text"), "n").persist()
    # In small samples a fourth is left for calibration.
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    share = fit_documents / (fit_documents + calibration_documents)
    marked = kept.join(F.broadcast(sizes), "lang").withColumn(
        "fit", F.col("n") <= F.greatest(F.lit(1), F.ceil(F.col("size") * share))
    )
    fit = marked.filter("fit").select("lang", "text")
    found = fit.select("text").mapInArrow(letter_counts, "letter long, n long")
    learned = found.filter("letter > 0").select("letter").distinct().collect()
    alphabet = np.array(sorted(r[0] for r in learned), np.uint32)
    rows = (
        fit.mapInArrow(gram_counts(alphabet, order), "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .persist()
    )
    models = CharacterModels(sorted(r[0] for r in rows.select("lang").distinct().collect()), alphabet, order)
    for at in range(0, len(models.languages), BLOCK):
        names = models.languages[at : at + BLOCK]
        counts = {}
        for lang, part in rows.filter(F.col("lang").isin(names)).toPandas().groupby("lang"):
            keys = part["gram"].to_numpy().view(np.uint64)
            place = np.argsort(keys)
            counts[lang] = (keys[place], part["n"].to_numpy()[place].astype(np.float64))
        models.fit_block([counts[name] for name in names])
    rows.unpersist()
    if models.languages:
        unseen = marked.filter(~F.col("fit")).select("lang", "text")
        shared = labelled.sparkSession.sparkContext.broadcast(models)

        def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                entropies, n = shared.value.cross_entropies(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(list(entropies), pa.list_(pa.float64())), pa.array(n)],
                    ["lang", "entropies", "n"],
                )

        measured = unseen.mapInArrow(measure, "lang string, entropies array<double>, n long").toArrow()
        models.calibrate(
            np.array(measured["lang"].to_pylist()),
            measured["entropies"].combine_chunks().flatten().to_numpy().reshape(-1, len(models.languages)),
            measured["n"].to_numpy().astype(np.int64),
        )
    kept.unpersist()
    return models


def held_out(folds: int = 5) -> Column:
    """Documents that are never learned from; a null id is one of them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def labelled_documents(docs: DataFrame) -> DataFrame:
    """(id, lang, text) of documents to learn from."""
    return docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), "lang", "text"
    )


def language_id(docs: DataFrame, models: CharacterModels) -> DataFrame:
    """The documents with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    A text is lower-cased letters with one break for each run of other characters; its
    language is that of the lowest cross-entropy per character, over the whole text.
    Ties go to the first language in order of name. ``score`` (0 to 1) is the
    winner's weight among the languages. Null texts and texts without a letter are
    ``und`` with score 0 and rejected; others are rejected beyond the limit of
    ``calibrate``. Rows stay where they are; repeated rows each get a row, and columns
    of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return append_batches(docs, FIELDS, lambda texts: shared.value.predict(texts))
