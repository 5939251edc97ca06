"""Passages that repeat across documents, by sparse suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, same_document, stage, with_columns

MIN_WORDS = 50
WINDOW = 24
GRAM = 3
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
KEPT_WORDS = 500_000
#: Keys of documents that are looked at together.
CHUNK = 1 << 20
#: What a key is within its batch: a copy of one before, the first of several, the only one.
COPY, FIRST, ONLY = 0, 1, 2


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Rolling:
    """Hashes of any runs of a sequence from sums of powers, modulo 2 ** 64."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                made = np.full(n, base)
                made[0] = 1
                setattr(self, name, np.cumprod(made))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes) + 1)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * self.powers[: len(codes)])))

    def runs(self, sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` elements from each position on, wherever they stand."""
        value = (sums[at + n] - sums[at]) * self.inverses[at]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        return value ^ (value >> np.uint64(32))


def word_codes(text: bytes, known: WordHashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def minimisers(scores: np.ndarray, window: int) -> np.ndarray:
    """Positions that have the smallest score in some run of ``window`` positions.

    Only the scores in a run decide, so equal passages keep equal positions.
    """
    if len(scores) < window:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(scores, window)
    return np.unique(runs.argmin(axis=1) + np.arange(len(runs)))


def states(keys: list[np.ndarray]) -> list[np.ndarray]:
    """COPY, FIRST or ONLY for each key among all keys of a batch."""
    if not keys:
        return []
    joined = np.concatenate(keys)
    _, first, kind, n = np.unique(joined, return_index=True, return_inverse=True, return_counts=True)
    out = np.where(n[kind] > 1, COPY, ONLY).astype(np.int8)
    out[first[n > 1]] = FIRST
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def lists(values: list[np.ndarray], kind: pa.DataType, numpy_kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values).astype(numpy_kind) if values else np.zeros(0, numpy_kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def key_batch(batch: pa.RecordBatch, rows: list, at: list, keys: list) -> pa.RecordBatch:
    place = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(place),
            batch.column(1).take(place),
            lists(at, pa.int32(), np.int32),
            lists([k.view(np.int64) for k in keys], pa.int64(), np.int64),
            lists(states(keys), pa.int8(), np.int8),
        ],
        ["id", "body", "at", "keys", "state"],
    )


def keyed_batches(batches: Iterable[pa.RecordBatch], keys_of) -> Iterator[pa.RecordBatch]:
    """Places and keys of each text that ``keys_of`` gives any, in parts of bounded size.

    Documents go by id, so that the first copy in a part is the one of the smallest id.
    """
    known, rolling = WordHashes(), Rolling()
    for batch in batches:
        batch = batch.sort_by([("id", "ascending"), ("body", "ascending")])
        rows, at, keys, held = [], [], [], 0
        for i in range(batch.num_rows):
            found = keys_of(word_codes(batch.column(2)[i].as_py(), known), rolling, batch, i)
            if found is None:
                continue
            rows.append(i)
            at.append(found[0])
            keys.append(found[1])
            held += len(found[0])
            if held >= CHUNK:
                yield key_batch(batch, rows, at, keys)
                rows, at, keys, held = [], [], [], 0
        yield key_batch(batch, rows, at, keys)


KEY_FIELDS = "id {id}, body long, at array<int>, keys array<long>, state array<byte>"


def suffix_batches(min_words: int, window: int, gram: int):
    """A task over (id, body, text): retained suffixes, each keyed by its first words.

    A passage of ``min_words`` words has a retained position among its first
    ``window``, and from there on at least ``min_words - window - gram + 2`` words,
    which are hashed to the key.
    """
    prefix = min_words - window - gram + 2

    def keys_of(codes: np.ndarray, rolling: Rolling, batch, i):
        if len(codes) < min_words:
            return None
        sums = rolling.sums(codes)
        place = minimisers(rolling.runs(sums, np.arange(len(codes) - gram + 1), gram), window)
        place = place[place + prefix <= len(codes)]
        return place, rolling.runs(sums, place, prefix)

    return lambda batches: keyed_batches(batches, keys_of)


def extended_batches(min_words: int, window: int):
    """A task over (id, body, text, places): windows of ``min_words`` that a match may reach.

    A match at a place is extended to the left by up to ``window`` words and to the
    right until ``min_words`` are full: each such window gets its own key.
    """

    def keys_of(codes: np.ndarray, rolling: Rolling, batch, i):
        found = np.array(batch.column(3)[i].as_py(), np.int64)
        starts = np.unique((found[:, None] - np.arange(window)).ravel())
        starts = starts[(starts >= 0) & (starts + min_words <= len(codes))]
        return starts, rolling.runs(rolling.sums(codes), starts, min_words)

    return lambda batches: keyed_batches(batches, keys_of)


def neighbour_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, ref, i, state): each row beside what its neighbours in order say of it.

    ``leads`` if the row before has another key, ``alone`` if the row after has another
    one as well and no copy was met before the sort. The last row waits for the next batch.
    """
    held = None

    def judged(rows: list[np.ndarray], before: int | None, after: int | None) -> pa.RecordBatch:
        key, ref, i, state = rows
        leads = np.empty(len(key), bool)
        leads[0] = before is None or key[0] != before
        leads[1:] = key[1:] != key[:-1]
        ends = np.append(leads[1:], after is None or key[-1] != after)
        alone = leads & ends & (state == ONLY)
        return pa.RecordBatch.from_arrays(
            [pa.array(ref), pa.array(i), pa.array(leads), pa.array(alone), pa.array(state)],
            ["ref", "i", "leads", "alone", "state"],
        )

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(p) for p in zip(held, rows)]
        held = [r[-1:] for r in rows]
        if len(rows[0]) > 1:
            yield judged([r[:-1] for r in rows], before, int(rows[0][-1]))
            before = int(rows[0][-2])
    if held is not None:
        yield judged(held, before, None)


def compared(table: DataFrame) -> DataFrame:
    """(ref, i, leads, alone, state) of all keys but copies within their batch.

    A batch sends a key once, however often it holds it, so a key that a third of all
    documents have is sorted as one row per batch.
    """
    each = table.select(
        "ref", "id", F.posexplode(F.arrays_zip("keys", "state")).alias("i", "k")
    ).select(F.col("k.keys").alias("key"), "ref", "i", F.col("k.state").alias("state"), "id")
    sent = each.filter(F.col("state") > COPY)
    ordered = sent.repartition("key").sortWithinPartitions("key", F.col("id").asc_nulls_last(), "ref", "i")
    return ordered.select("key", "ref", "i", "state").mapInArrow(
        neighbour_batches, "ref long, i int, leads boolean, alone boolean, state byte"
    )


def listed(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("ref").agg(F.collect_list("i").alias(name))


def merged(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Unions of the runs of ``n`` words that begin at sorted ``starts``."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > n) + 1
    first = starts[np.concatenate(([0], cuts))]
    last = starts[np.concatenate((cuts - 1, [len(starts) - 1]))]
    return list(zip(first.tolist(), (last + n).tolist()))


def span_batches(min_words: int):
    """A task over (id, body, at, state, leading, alone): to spans of repeated words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends, later = [], [], [], []
            for i in range(batch.num_rows):
                at, _, leading, alone = (batch.column(c)[i].as_py() or [] for c in range(2, 6))
                at = np.array(at, np.int64)
                shared, copies = np.ones(len(at), bool), np.ones(len(at), bool)
                shared[alone] = False
                copies[leading] = False
                cut = merged(at[copies], min_words)
                for a, b in merged(at[shared], min_words):
                    rows.append(i)
                    starts.append(a)
                    ends.append(b)
                    later.append(sum(min(b, y) - max(a, x) for x, y in cut if x < b and y > a))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(later, pa.int64()),
                ],
                ["id", "body", "start", "end", "n_later"],
            )

    return run


def windows_shared(
    docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """(id, body, at, state, leading, alone): windows near matches, and what is known of them."""
    if min_words - window - gram + 2 < 1:
        raise ValueError("window and gram must leave room for a prefix within min_words")
    base = keyed(docs).select("id", "body", F.col("text").cast("binary").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    fields = KEY_FIELDS.format(id=kind)
    number = F.monotonically_increasing_id().alias("ref")
    # Rows are numbered in what is written, so the numbers stay whatever is lost later.
    suffixes = stage(
        base.mapInArrow(suffix_batches(min_words, window, gram), fields).select(number, "*"), "suffixes"
    )
    met = compared(suffixes).filter((F.col("state") == ONLY) & ~F.col("alone"))
    matched = suffixes.join(listed(met, "met"), "ref", "left")
    # Places whose key has a copy in their batch match without a neighbour to say so.
    here = F.filter(F.transform("state", lambda s, i: F.when(s < ONLY, i)), lambda i: i.isNotNull())
    every = F.concat(here, F.coalesce("met", F.array().cast("array<int>")))
    places = matched.filter(F.size(every) > 0).select(
        "id", "body", F.transform(every, lambda i: F.get("at", i)).alias("places")
    )
    near = base.alias("l").join(
        places.dropDuplicates(["id", "body"]).alias("r"), same_document()
    ).select("l.*", "r.places")
    windows = stage(near.mapInArrow(extended_batches(min_words, window), fields).select(number, "*"), "windows")
    leading = stage(compared(windows).filter("leads").select("ref", "i", "alone"), "leading")
    return (
        windows.join(listed(leading, "leading"), "ref", "left")
        .join(listed(leading.filter("alone"), "alone"), "ref", "left")
        .select("id", "body", "at", "state", "leading", "alone")
    )


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """(doc_id, text_hash, start, end, n_later): words that repeat elsewhere, as spans.

    Words are runs without ASCII blanks, A-Z in lower case; ``start`` and ``end``
    (exclusive) count words. A window of ``min_words`` words repeats if the same words
    follow each other at another place, in another document or in the same; a span is
    a longest union of repeating windows. ``n_later`` of its words are covered by
    windows that are not the first of their kind (by doc_id, nulls last).

    Suffixes are retained at minimisers of ``gram``-word hashes over ``window``
    positions. They are sorted by their first words and compared with their neighbours;
    each match is extended to the left by up to ``window`` words and to the right, and
    the windows it reaches are compared the same way. Every window that repeats holds a
    retained position among its first ``window``, with all that follows of it, so none
    is missed. Keys are 64-bit hashes. Texts of fewer than ``min_words`` words, null
    and empty ones among them, have no span. Equal rows repeat each other.
    """
    found = windows_shared(docs, min_words, **options)
    kind = found.schema["id"].dataType.simpleString()
    fields = f"id {kind}, body long, start long, end long, n_later long"
    return found.mapInArrow(span_batches(min_words), fields).withColumnsRenamed(
        {"id": "doc_id", "body": "text_hash"}
    )


def cut_words(text: bytes | None, spans: list) -> bytes | None:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at : words[start][0]])
        at = words[end][0] if end < len(words) else len(text)
    return b"".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """The documents with all but the first copy of repeating windows cut from ``text``."""
    found = windows_shared(docs, min_words, **options)
    kind = found.schema["id"].dataType.simpleString()

    def later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for at, leading in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at = np.delete(np.array(at, np.int64), np.array(leading or [], np.int64))
                spans.append([list(s) for s in merged(at, min_words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                ["id", "body", "spans"],
            )

    fields = f"id {kind}, body long, spans array<array<long>>"
    spans = found.select("id", "body", "at", "leading").mapInArrow(later, fields)
    # Equal rows have windows of their own; what the first of them keeps, all keep.
    one = spans.groupBy("id", "body").agg(F.min_by("spans", F.size("spans")).alias("spans"))
    joined = keyed(docs).alias("l").join(one.alias("r"), same_document(), "left").select("l.*", "r.spans")
    cut = F.udf(lambda t, s: None if t is None else cut_words(bytes(t), s or []), "binary")
    return with_columns(joined, docs, {"text": cut(F.col("text").cast("binary"), "spans").cast("string")})
