"""Near copies by the similarity of their five-word shingles, found by SimHash and MinHash and verified."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, same_document, scratch, stage
from voxboard.llm.graph import components
from voxboard.llm.simhash import MAX_BITS, fingerprint_groups, majority, shingle_hashes
from voxboard.session import ensure_checkpoint_dir

WORDS = 5
PERCENT = 80
#: A pair of exactly 0.8 shares no band with probability (1 - 0.8 ** 4) ** 28 = 4e-7.
BANDS = 28
BAND_ROWS = 4
SEED = 42
#: How often the most typical member of a key meets all others.
ROUNDS = 2
#: Rows of two longs that are sent to every task; more are joined.
BROADCAST_ROWS = 500_000
#: Shingles whose minima are taken at once.
CHUNK = 1 << 12


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted; none without a word."""
    return np.unique(shingle_hashes(text, words))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` orders of the hashes."""
    made = np.random.default_rng(SEED).integers(0, 1 << 64, (2, n, 1), dtype=np.uint64)
    return made[0] | np.uint64(1), made[1]


def band_keys(found: np.ndarray, factors: np.ndarray, summands: np.ndarray, rows: int) -> np.ndarray:
    """One key per band of ``rows`` minima; the number of the band is part of it."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, (factors * found[at : at + CHUNK] + summands).min(axis=1), out=least)
    bands = least.reshape(-1, rows)
    return np.array(
        [xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64
    ).view(np.int64)


def class_of(found: np.ndarray) -> int:
    """A long that names a shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64))


def signature_batches(words: int, bands: int, rows: int):
    """A task: (id, body, text as bytes) to (id, body, fp, cls, size, bands)."""
    factors, summands = permutations(bands * rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, classes, sizes, keys = [], [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), words)
                found = np.unique(hashes)
                prints.append(majority(hashes, np.array([len(hashes)]))[0])
                classes.append(class_of(found))
                sizes.append(len(found))
                keys.append(band_keys(found, factors, summands, rows) if len(found) else [])
            prints = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(prints), pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "body", "fp", "cls", "size", "bands"],
            )

    return run


def set_batches(words: int):
    """A task: (cls, text as bytes) to (cls, shingles)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingle_set(text.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cls], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    ["cls", "shingles"],
                )

    return run


def alike(a: Column, b: Column, percent: int) -> Column:
    """Whether two sets share ``percent`` of what either of them has."""
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def placed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with ``root``: that of its group so far, or the class itself."""
    members = members.drop("root")
    if roots is None:
        return members.withColumn("root", F.col("cls"))
    joined = members.join(roots, members.cls == roots.node, "left")
    return joined.select(*members.columns, F.coalesce("root", "cls").alias("root"))


def of_like_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def centre_pairs(now: DataFrame, percent: int) -> DataFrame:
    """(a, b): the ``centre`` of each key with the members of its key in other groups."""
    centres = now.filter("cls = centre").select("key", F.col("size").alias("size_c"), F.col("root").alias("root_c"))
    met = now.join(centres, "key").filter(
        (F.col("root") != F.col("root_c")) & of_like_size(F.col("size"), F.col("size_c"), percent)
    )
    return met.select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()


def mixed_keys(members: DataFrame) -> DataFrame:
    """(key, centre): keys that hold more than one group, and their most typical member."""
    found = members.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("degree", "cls")).alias("c")
    )
    return found.filter("low < high").select("key", F.col("c.cls").alias("centre"))


def size_class(size: Column) -> Column:
    """Sizes in steps of a twentieth."""
    return F.floor(F.log(size.cast("double")) / F.lit(np.log(1.05))).cast("int")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``members`` (cls, size, root) in different groups that may be ``alike``.

    Exact. With the shingles of a set in order of rarity, two sets that are alike share
    one, and the first that they share stands so early in both that enough are left after
    it. A shingle that no other set has is never shared but holds its place, so a set
    with too many of its own meets nobody, whatever group it is in. A place allows partners
    up to some size: rows are dealt out by shingle and size, the larger set of a pair
    to the sizes that it may meet. Of the group that most sets of a shingle are in, sets
    meet those of other groups only.
    """
    whole, share = 100 + percent, percent
    tokens = sets.join(members, "cls").select("cls", "size", "root", F.explode("shingles").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    held = tokens.join(shared, "token")
    by_rarity = Window.partitionBy("cls").orderBy("df", "token")
    own = Window.partitionBy("cls")
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(by_rarity) - 1
    largest = F.floor((F.col("size") - F.col("place")) * whole / share) - F.col("size")
    early = held.withColumn("place", place).withColumn("largest", largest)
    early = early.filter(F.col("largest") * 100 >= F.col("size") * percent).drop("df")
    early = stage(early, "prefixes")
    groups = early.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token")
    groups = groups.agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots"))
    early = early.join(groups.filter("roots > 1"), "token").withColumn(
        "minor", (F.col("root") != F.col("major")).cast("int")
    )
    least = F.ceil(F.col("size") * percent / 100)
    sizes = F.sequence(size_class(least), size_class(F.least("size", "largest")))
    left = early.filter(least <= F.least("size", "largest")).select(
        "token", "cls", "root", "size", "place", F.explode(sizes).alias("class"),
        # Sets of other groups meet everybody, those of the major group only those.
        F.when(F.col("minor") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))).alias("meets"),
    ).withColumn("kind", F.explode("meets")).drop("meets")
    right = early.select(
        "token", size_class(F.col("size")).alias("class"), F.col("minor").alias("kind"),
        *[F.col(c).alias(f"{c}_b") for c in ("cls", "root", "size", "place")],
    )
    after = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    met = left.join(right, ["token", "class", "kind"]).filter(
        (F.col("root") != F.col("root_b"))
        & (F.col("size_b") <= F.col("size"))
        & of_like_size(F.col("size"), F.col("size_b"), percent)
        & (after * whole >= (F.col("size") + F.col("size_b")) * share)
    )
    return met.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    true = pairs.join(left, "a").join(right, "b").filter(alike(F.col("sa"), F.col("sb"), percent))
    return stage(true.select("a", "b"), "links")


def similar_classes(
    buckets: DataFrame, sets: DataFrame, percent: int, rounds: int = ROUNDS
) -> DataFrame | None:
    """(node, root) as of ``components``, over the pairs that share a key and are ``alike``.

    In ``rounds`` rounds the most typical member of each key of ``buckets`` (key, cls, size),
    the one with the most company over all its keys, meets the others and leaves; that
    joins most groups of any size by one pair per member. What is still in keys with
    several groups goes through ``prefix_pairs``. No pair that is alike is left out.
    """
    company = buckets.groupBy("key").agg(F.count("*").alias("n"))
    degree = buckets.join(company, "key").groupBy("cls").agg(F.sum("n").alias("degree"))
    left = buckets.join(degree, "cls").select("key", "cls", "size", "degree")
    roots, done, links = None, None, []

    def add(pairs: DataFrame) -> None:
        nonlocal roots, done
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        if not pairs.isEmpty():
            done = pairs if done is None else done.unionByName(pairs)
            links.append(verified(pairs, sets, percent))
            roots = components(reduce(DataFrame.unionByName, links))

    for _ in range(rounds):
        now = placed(left, roots)
        now = stage(now.join(mixed_keys(now), "key"), "buckets")
        add(centre_pairs(now, percent))
        left = now.filter("cls <> centre").drop("centre")
    now = placed(left, roots)
    rest = now.join(mixed_keys(now), "key").select("cls", "size", "root").distinct()
    add(prefix_pairs(stage(rest, "doubtful"), sets, percent))
    return roots


def near_copies(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """(id, body, root): documents whose texts are joined by similar pairs share a root.

    Words as in ``simhash``, A-Z in lower case; a text is the set of its ``words``-word
    shingles, a shorter one is one shingle, and texts without a word are alike. Two
    texts are similar if they share ``percent`` of the shingles that either has.
    Candidates lie in one SimHash component (fingerprints of the same shingles, linked at
    ``max_bits`` bits by pivot distances) or share a MinHash band, which also brings those
    together that differ in more bits; each is verified on the whole sets (by 64-bit
    hashes of the shingles). Equal sets are one class from the start. Repeated rows each
    give a row, null ids are like others, an empty table gives an empty one.
    """
    texts = keyed(docs).select("id", "body", F.col("text").cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(
        signature_batches(words, bands, rows),
        f"id {kind}, body long, fp long, cls long, size long, bands array<long>",
    )
    signed = stage(made, "signatures")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "body")
    classes = signed.groupBy("cls").agg(
        *[F.any_value(c).alias(c) for c in ("fp", "size", "bands")], F.min(order).alias("d")
    )
    classes = stage(classes, "classes")
    # A component of fingerprints is one more key that its classes share.
    groups = fingerprint_groups(classes.select("fp").distinct(), max_bits)
    grouped = classes.join(groups, "fp").select(F.xxhash64(F.lit("simhash"), "root").alias("key"), "cls", "size")
    each = classes.select(F.explode("bands").alias("key"), "cls", "size").unionByName(grouped)
    shared = each.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    buckets = stage(each.join(shared.filter("low < high").select("key"), "key"), "buckets")
    # One text of each class that has company is read again.
    wanted = classes.join(buckets.select("cls").distinct(), "cls", "left_semi")
    first = wanted.select("cls", "d.id", "d.body")
    whole = texts.alias("l").join(sent_if_small(first), same_document()).select("r.cls", "l.text")
    sets = whole.dropDuplicates(["cls"]).mapInArrow(set_batches(words), "cls long, shingles array<long>")
    roots = similar_classes(buckets, stage(sets, "sets"), percent)
    if roots is None:
        return signed.select("id", "body", F.col("cls").alias("root"))
    return signed.join(roots, signed.cls == roots.node, "left").select(
        "id", "body", F.coalesce("root", "cls").alias("root")
    )


def sent_if_small(keys: DataFrame) -> DataFrame:
    """Narrow rows that go to every task up to BROADCAST_ROWS, and are joined beyond."""
    kept = stage(keys, "keys")
    return (F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept).alias("r")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of ``near_copies``: that of the smallest doc_id.

    Null ids come last; of rows that share the id the one with the smallest text hash
    stays, and of equal rows one. Texts are not shuffled as long as the rows that go are
    few enough to be known to every task.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "body")
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/llm-members-{uuid.uuid4().hex}"
    with scratch(docs.sparkSession):
        near_copies(docs, **options).write.parquet(path)
    members = docs.sparkSession.read.parquet(path)
    chosen = members.groupBy("root").agg(F.min(order).alias("d")).select("d.id", "d.body")
    # Rows meet by id and text, never by group: a group may hold a third of all rows.
    counted = members.groupBy("id", "body").agg(F.count("*").alias("n")).alias("l")
    stays = chosen.withColumn("stays", F.lit(True)).alias("r")
    named = counted.join(stays, same_document(), "left")
    named = named.select("l.id", "l.body", "l.n", F.coalesce("r.stays", F.lit(False)).alias("stays"))
    named = stage(named, "named")
    # Rows that are there once and stay are neither moved nor looked at.
    texts = keyed(docs).alias("l")
    once = texts.join(sent_if_small(named.filter("not stays or n > 1").select("id", "body")), same_document(), "left_anti")
    repeated = sent_if_small(named.filter("stays and n > 1").select("id", "body"))
    again = texts.join(repeated, same_document(), "left_semi").dropDuplicates(["id", "body"])
    kept = once.unionByName(again)
    return kept.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
