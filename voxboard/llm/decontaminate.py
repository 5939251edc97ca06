"""Find benchmark items inside documents: sketches of the items, then exact shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxboard.llm.common import keyed, lowered, same_document, stage, with_columns, word_list
from voxboard.operators.barrier import compute_once

WORDS = 5
PERCENT = 80
#: A table of item sketches or keys is sent to every task up to this many rows.
BROADCAST_ROWS = 500_000


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table of short rows, marked for broadcast if it has at most ``rows``.

    A larger one is left to a shuffled join, whose large keys Spark splits.
    """
    return F.broadcast(df) if df.count() <= rows else df


def shingles(words: str, n: int, of: Column | None = None) -> Column:
    """All runs of ``n`` words; none if there are fewer words."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: (of or (lambda w: w))(F.slice(words, i, n))
    )
    return F.when(F.size(words) >= n, runs)


def run_hash(run: Column) -> Column:
    return F.xxhash64(run)


def run_text(run: Column) -> Column:
    return F.array_join(run, " ")


def item_shingles(benchmark: DataFrame, n: int, percent: int) -> DataFrame:
    """(item, item_id, size, need, words, run, h, place): the shingles of every item, once each.

    ``size`` is the number of different shingles and ``need`` how many of them make
    up ``percent``. ``place`` ranks them by hash: those up to ``size - need + 1`` are
    the item's MinHash sketch. ``words`` is the length of its shingles, which is less
    than ``n`` for an item that has fewer words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(
        "item_id", F.xxhash64("item_id", text).alias("item"), word_list(lowered(text)).alias("words")
    ).dropDuplicates(["item"])
    items = compute_once(items, {"words": F.col("words")}).filter(F.size("words") > 0)
    short = F.least(F.size("words"), F.lit(n))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("words") - short + 1), lambda i: F.slice("words", i, short)
    )
    each = items.select("item", "item_id", short.alias("n"), F.explode(F.array_distinct(runs)).alias("run"))
    own = W.partitionBy("item")
    sized = each.select(
        "item", "item_id", F.col("n").alias("words"), run_text(F.col("run")).alias("run"),
        run_hash(F.col("run")).alias("h"), F.count("*").over(own).alias("size"),
    )
    return sized.select(
        "*",
        F.expr(f"(size * {percent} + 99) div 100").alias("need"),
        F.row_number().over(own.orderBy("h", "run")).alias("place"),
    )


def contained_items(
    docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """(id, body, item_id, n_shingles, n_found): items of which a document holds enough.

    Words are runs without ASCII blanks, A-Z in lower case. A document contains an item
    if at least ``percent`` of the item's different ``words``-word shingles occur in it;
    an item with fewer words is one shingle of all its words, one without words is
    never contained.

    Items are partitioned by their number of shingles, since it is the item that must
    be covered, however long the document. An item of ``size`` shingles of which
    ``need`` must occur has a sketch of its ``size - need + 1`` smallest hashes: a
    document that contains the item misses at most ``size - need`` of its shingles, so
    it has at least one of the sketch, and no contained item is overlooked. Documents
    with fewer shingles than ``need`` are passed over. Candidates are verified by
    counting the item's shingles, compared as texts, in the document.

    One pass hashes all shingles of all documents where they are read; a second one
    reads candidate documents again. Rows that are equal in id and text give one result.
    """
    items = stage(item_shingles(benchmark, words, percent), "items")
    lengths = sorted(r[0] for r in items.select("words").distinct().collect())
    base = keyed(docs).select("id", "body", "text")
    kind = base.schema["id"].dataType.simpleString()
    empty = F.array().cast("array<bigint>")
    worded = compute_once(base, {"list": word_list(lowered(F.col("text")))}).drop("text")
    hashes = [F.coalesce(shingles("list", n, run_hash), empty) for n in lengths]
    # The hashes of a document are made once, whatever is asked of them.
    hashed = worded.select(
        "id", "body", F.size("list").alias("n"), F.explode(F.concat(empty, *hashes)).alias("h")
    )
    sketch = items.filter("place <= size - need + 1").select("item", "h", (F.col("need") + F.col("words") - 1).alias("least"))
    sketch = stage(sketch, "sketch")
    found = hashed.join(sent_if_small(sketch), "h").filter("n >= least")
    candidates = stage(found.select("id", "body").distinct(), "candidates")

    near = base.alias("l").join(sent_if_small(candidates).alias("r"), same_document(), "left_semi")
    listed = compute_once(near.dropDuplicates(["id", "body"]), {"list": word_list(lowered(F.col("text")))}).drop("text")
    none = F.array().cast("array<string>")
    texts = [F.coalesce(shingles("list", n, run_text), none) for n in lengths]
    runs = listed.select(
        F.col("id").cast(kind).alias("id"), "body",
        F.explode(F.array_distinct(F.concat(none, *texts))).alias("run"),
    )
    matched = runs.join(sent_if_small(items.select("item", "item_id", "run", "size", "need")), "run")
    counts = matched.groupBy("id", "body", "item", "item_id", "size", "need").agg(F.count("*").alias("n_found"))
    return counts.filter("n_found >= need").select(
        "id", "body", "item_id", F.col("size").cast("long").alias("n_shingles"), "n_found"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment), one row per contained item.

    See ``contained_items``. Null texts and empty tables contain nothing; null ids are
    ids like any other.
    """
    return contained_items(docs, benchmark, **options).select(
        F.col("id").alias("doc_id"), "item_id", "n_shingles", "n_found",
        (F.col("n_found") / F.col("n_shingles")).alias("containment"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no benchmark item, with their columns as they are."""
    hits = contained_items(docs, benchmark, **options).select("id", "body").distinct()
    clean = keyed(docs).alias("l").join(hits.alias("r"), same_document(), "left_anti")
    return with_columns(clean, docs, {})
