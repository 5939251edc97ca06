"""Near-duplicate documents by SimHash, paired with the help of pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, same_document, stage, with_columns
from voxboard.llm.graph import components

WORDS = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
BLOCKS = 6
LANES = np.uint64(0x0101010101010101)
#: Shingles that are added up at once.
CHUNK = 1 << 20


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included.

    bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII blanks.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    n = len(found) - words + 1
    spans = zip(starts[:n], ends[words - 1 :])
    return np.fromiter((digest(whole[a : b - 1], SEED) for a, b in spans), np.uint64, n)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``sizes`` hashes, the bits set in over half of them.

    Eight bits are counted at once in the bytes of a word, in blocks of 255 hashes,
    which a byte can hold; blocks are then added up by document.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    blocks = -(-n // 255)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    inside = np.arange(blocks.sum()) - np.repeat(first, blocks)
    cuts = np.repeat(begin, blocks) + 255 * inside
    value = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * counts > n[:, None]
        for byte in range(8):
            value |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = value
    return out


def fingerprint_batches(words: int):
    """A task: (id, body, text as bytes) to (id, body, fp)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, pending, sizes, held = [], [], [], 0
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                pending.append(hashes)
                sizes.append(len(hashes))
                held += len(hashes)
                if held >= CHUNK:
                    parts.append(majority(np.concatenate(pending), np.array(sizes)))
                    pending, sizes, held = [], [], 0
            if sizes:
                parts.append(majority(np.concatenate(pending), np.array(sizes)))
            fps = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "body", "fp"]
            )

    return run


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """Keys of which two fingerprints that differ in at most ``max_bits`` bits share one.

    Differing bits touch at most ``max_bits`` of the ``blocks``; the others agree. One
    key per choice of ``blocks - max_bits`` blocks says which blocks and what is in them.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for place, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        key = F.lit(place).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            bits = F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> list[np.ndarray]:
    """Hamming distance of each fingerprint to each reference fingerprint."""
    return [np.bitwise_count(fps ^ p).astype(np.int16) for p in pivots]


def reference_fingerprints(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def links(keys: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> np.ndarray:
    """Spanning links (pairs of positions) among fingerprints of one key.

    By the triangle inequality two fingerprints within ``max_bits`` bits have
    distances to any pivot within ``max_bits`` of each other. Fingerprints of a key
    are sorted by the first coordinate, so a position only meets those up to that
    difference; the other coordinates discard pairs one after the other, and the
    survivors are verified bit by bit. Within a key only links that join two groups
    are kept, which is at most one per fingerprint.
    """
    first = np.bitwise_count(fps ^ pivots[0])
    order = np.lexsort((fps, first, keys))
    keys, fps = keys[order], fps[order]
    table = pivot_table(fps, pivots)
    root = np.arange(len(fps))
    out = []
    left = np.arange(len(fps))
    step = 0
    while len(left):
        step += 1
        left = left[left + step < len(fps)]
        right = left + step
        near = (keys[left] == keys[right]) & (table[0][right] - table[0][left] <= max_bits)
        left = left[near]
        i, j = left, left + step
        for column in table[1:]:
            close = np.abs(column[i] - column[j]) <= max_bits
            i, j = i[close], j[close]
        true = (np.bitwise_count(fps[i] ^ fps[j]) <= max_bits) & (root[i] != root[j])
        i, j = i[true], j[true]
        if not len(i):
            continue
        for a, b in zip(i.tolist(), j.tolist()):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return fps[pairs]


def link_batches(max_bits: int, pivots: np.ndarray, hold: int = 1 << 17):
    """A task over (key, fp) sorted by key: to links (a, b). Keys may span batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def solved(keys, fps):
            pairs = links(keys, fps, pivots, max_bits).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) < hold:
                continue
            last = np.searchsorted(keys, keys[-1])
            if last:
                yield solved(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield solved(keys, fps)

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, body, fp) of every document; fp is the 64-bit fingerprint as a long."""
    texts = keyed(docs).select("id", "body", F.col("text").cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(fingerprint_batches(words), f"id {kind}, body long, fp long")


def fingerprint_groups(
    classes: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, blocks: int = BLOCKS
) -> DataFrame:
    """``classes`` with ``root``: their different fingerprints ``fp``, grouped by links."""
    keys = classes.select(
        F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("key"), "fp"
    )
    dealt = keys.repartition("key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(link_batches(max_bits, reference_fingerprints(pivots)), "a long, b long")
    roots = components(edges)
    return classes.join(roots, classes.fp == roots.node, "left").select(
        *classes.columns, F.coalesce("root", "fp").alias("root")
    )


def simhash_members(
    docs: DataFrame,
    words: int = WORDS,
    max_bits: int = MAX_BITS,
    pivots: int = PIVOTS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(id, body, fp, component_id): the narrow result of ``simhash_groups``."""
    if blocks <= max_bits:
        raise ValueError("blocks must be more than max_bits")
    members = stage(fingerprints(docs, words), "fingerprints")
    # Copies meet here, combined before the shuffle; from now on a fingerprint is one row.
    classes = stage(members.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    placed = fingerprint_groups(classes, max_bits, pivots, blocks)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return members.join(named, "fp").select("id", "body", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``fingerprint`` (16 hex digits) and ``component_id``.

    A-Z in lower case, words between ASCII blanks, shingles of ``words`` words, repeats
    included (a shorter text is one shingle). A fingerprint bit is set if it is set in
    over half of the shingles' XXH64 hashes (seed 42). Texts without a word, null among
    them, have fingerprint zero and link like any other. Fingerprints link at
    ``max_bits`` or fewer differing bits, and documents whose fingerprints are joined
    by links form a component, named by its smallest doc_id (null if all are null).
    No link between different fingerprints is lost: block keys bring together every
    pair that may link, and pivot distances discard only pairs that cannot.
    Repeated rows each give a row; columns of the two names are replaced.
    """
    names = simhash_members(docs, **options).dropDuplicates(["id", "body"])
    joined = keyed(docs).alias("l").join(names.alias("r"), same_document())
    return with_columns(
        joined.select("l.*", "r.fp", "r.component_id"),
        docs,
        {"fingerprint": as_hex(F.col("fp")), "component_id": F.col("component_id")},
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest doc_id.

    Among rows that share this id the one with the smallest text hash stays, and of
    equal rows one. A component whose ids are all null keeps one row as well.
    """
    members = simhash_members(docs, **options)
    # Components are named by an id; those of null ids are told apart by nothing else
    # than the fingerprint of their root, so they are kept per fingerprint.
    first = members.filter(F.col("id").eqNullSafe(F.col("component_id")))
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    chosen = (
        first.groupBy("id", group.alias("g")).agg(F.min("body").alias("body")).select("id", "body")
    )
    kept = keyed(docs).alias("l").join(chosen.alias("r"), same_document(), "left_semi")
    once = kept.dropDuplicates(["id", "body"])
    return once.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
