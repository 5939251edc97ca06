"""Ranked search by words: an inverted index in shards of documents, searched by Block-Max MaxScore."""

from __future__ import annotations

import math
import string
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voxboard.session import ensure_checkpoint_dir

TOP = 50
#: Bytes of text that make a shard, postings of a block, and characters of items searched at once.
SHARD_BYTES = 6 << 20
BLOCK = 64
QUERY_CHARS = 4_000_000
#: tf / (tf + m / 50), in whole numbers; m is 100 for a document of average length.
UNIT, TF_PART, LENGTH_PART = 1_000_000_000, 1000, 20

ALNUM = (string.digits + string.ascii_letters).encode()
BREAKS = bytes(c for c in range(128) if c not in ALNUM)
TO_TERMS = bytes.maketrans(
    BREAKS + string.ascii_uppercase.encode(), b" " * len(BREAKS) + string.ascii_lowercase.encode()
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lowered."""
    return text.translate(TO_TERMS).split() if text else []


@dataclass(frozen=True)
class CorpusStats:
    """Documents with a term, and their terms with repeats."""

    documents: int
    terms: int

    def length_factor(self, lengths: list[int]) -> np.ndarray:
        """m of documents of so many terms; whole numbers of any size on the way."""
        return np.array([50 + 50 * n * self.documents // self.terms for n in lengths], np.int64)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return UNIT * tf // (TF_PART * tf + LENGTH_PART * m)


def corpus_stats(docs: DataFrame) -> CorpusStats:
    """One pass over the texts; a row per batch is added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"n": [sum(map(bool, sizes))], "terms": [sum(sizes)]})

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    found = texts.mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return CorpusStats(found[0] or 0, found[1] or 0)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in as few bytes as they need, seven bits each, and where each begins."""
    widths = np.ones(len(values), np.int64)
    for bits in range(7, 35, 7):
        widths += values >= 1 << bits
    at = np.concatenate(([0], np.cumsum(widths)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        longer = np.flatnonzero(widths > k)
        byte = (values[longer] >> (7 * k)) & 127
        out[at[longer] + k] = byte | np.where(widths[longer] > k + 1, 128, 0)
    return out, at


def unpacked(octets: np.ndarray) -> np.ndarray:
    """The numbers that ``packed`` wrote into these bytes."""
    ends = np.flatnonzero(octets < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        there = starts + k <= ends
        out[there] |= (octets[starts[there] + k].astype(np.int64) & 127) << (7 * k)
    return out


#: A shard as one row: its documents in the order of their ids, its terms separated by
#: blanks, per term its number of documents, per block of postings the last document,
#: the largest impact and where its bytes begin, and the postings: gaps and counts.
PARTS = ("m", "terms", "df", "block_last", "block_max", "block_at", "postings")


class ShardBuilder:
    """Documents that become one shard of the index."""

    def __init__(self, stats: CorpusStats, block: int):
        self.stats, self.block = stats, block
        self.ids: list = []
        self.codes: list[np.ndarray] = []
        self.numbers: dict[bytes, int] = {}
        self.held = 0

    def add(self, doc_id, text: bytes | None) -> None:
        found, numbers = terms_of(text), self.numbers
        if found:
            codes = (numbers.setdefault(t, len(numbers)) for t in found)
            self.codes.append(np.fromiter(codes, np.int32, len(found)))
            self.ids.append(doc_id)
            self.held += len(text)

    def row(self) -> dict:
        # Numbers of documents follow their ids, null last, so ties need no look at ids.
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        lengths = [len(self.codes[i]) for i in order]
        m = self.stats.length_factor(lengths)
        n = len(order)
        doc = np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(np.concatenate([self.codes[i] for i in order]).astype(np.int64) * n + doc, return_counts=True)
        term, doc = pairs // n, pairs % n
        df = np.bincount(term, minlength=len(self.numbers))
        first = np.concatenate(([0], np.cumsum(df)[:-1]))
        place = np.arange(len(doc)) - first[term]
        blocks = np.flatnonzero(place % self.block == 0)
        last = np.concatenate((blocks[1:], [len(doc)])) - 1
        before = np.concatenate(([-1], doc[:-1]))
        gaps = doc - np.where(place == 0, -1, before)
        octets, at = packed(np.column_stack((gaps, tf)).ravel())
        return {
            "ids": [self.ids[i] for i in order],
            "m": m.tobytes(),
            "terms": b" ".join(self.numbers),
            "df": df.astype(np.int32).tobytes(),
            "block_last": doc[last].astype(np.int32).tobytes(),
            "block_max": np.maximum.reduceat(impact(tf, m[doc]), blocks).astype(np.int32).tobytes(),
            "block_at": np.append(at[2 * blocks], at[-1]).tobytes(),
            "postings": octets.tobytes(),
        }


def shard_schema(id_type: T.DataType) -> T.StructType:
    fields = [T.StructField("ids", T.ArrayType(id_type))]
    return T.StructType(fields + [T.StructField(p, T.BinaryType()) for p in PARTS])


def shard_batches(stats: CorpusStats, schema: T.StructType, shard_bytes: int, block: int):
    """A task: (id, text as bytes) to shards of the documents that it reads."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        shard = ShardBuilder(stats, block)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py())
                if shard.held >= shard_bytes:
                    yield pa.RecordBatch.from_pylist([shard.row()], kinds)
                    shard = ShardBuilder(stats, block)
        if shard.ids:
            yield pa.RecordBatch.from_pylist([shard.row()], kinds)

    return run


class Shard:
    """A shard as it is searched: lists are decoded when they are needed, and by blocks."""

    def __init__(self, row: dict, block: int):
        self.block = block
        self.m = np.frombuffer(row["m"], np.int64)
        self.df = np.frombuffer(row["df"], np.int32).astype(np.int64)
        self.last = np.frombuffer(row["block_last"], np.int32).astype(np.int64)
        self.most = np.frombuffer(row["block_max"], np.int32).astype(np.int64)
        self.at = np.frombuffer(row["block_at"], np.int64)
        self.postings = np.frombuffer(row["postings"], np.uint8)
        n_blocks = -(-self.df // block)
        self.end = np.cumsum(n_blocks)
        self.begin = self.end - n_blocks
        self.ids = row["ids"]
        self.decoded = 0
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bound(self, term: int) -> int:
        return int(self.most[self.begin[term] : self.end[term]].max())

    def whole(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term and its impact in them."""
        if term not in self.lists:
            self.lists[term] = self.blocks(term, np.arange(self.begin[term], self.end[term]))
        return self.lists[term]

    def blocks(self, term: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for some blocks of its list, in order; only their bytes are read."""
        self.decoded += len(chosen)
        pieces = [self.postings[self.at[b] : self.at[b + 1]] for b in chosen.tolist()]
        numbers = unpacked(np.concatenate(pieces)).reshape(-1, 2)
        sizes = np.minimum(self.block, self.df[term] - (chosen - self.begin[term]) * self.block)
        # Gaps go on from the last document of the block before.
        base = np.where(chosen > self.begin[term], self.last[chosen - 1], -1)
        run = np.cumsum(numbers[:, 0])
        starts = np.cumsum(sizes) - sizes
        docs = run - np.repeat(run[starts] - numbers[starts, 0] - base, sizes)
        return docs, impact(numbers[:, 1], self.m[docs])

    def search(self, terms: list[tuple[int, int]], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the best documents, given (term, weight) pairs.

        Lists come by falling bound. As long as the lists to come could lift a new
        document to the ``top`` best scores so far, they are essential and read whole.
        The others only add to documents met before: the largest impact in the block
        where a document would stand is looked at first, and the block is decoded only
        if the document can still get there.
        """
        lists = sorted(((w * self.bound(t), t, w) for t, w in terms if w > 0), reverse=True)
        rest = np.append(np.cumsum([b for b, _, _ in lists][::-1])[::-1], 0).astype(np.int64)
        score = np.zeros(len(self.m), np.int64)
        least = 1  # what a document needs; scores so far never fall
        for place, (_, term, weight) in enumerate(lists):
            if rest[place] < least:
                break
            docs, found = self.whole(term)
            score[docs] += weight * found
            if len(score) >= top:
                least = max(least, int(np.partition(score, -top)[-top]))
        else:
            place = len(lists)
        docs = np.flatnonzero((score > 0) & (score + rest[place] >= least))
        score = score[docs]
        for later, (_, term, weight) in enumerate(lists[place:], place + 1):
            low, high = self.begin[term], self.end[term]
            block = low + np.searchsorted(self.last[low:high], docs)
            most = np.where(block < high, weight * self.most[np.minimum(block, high - 1)], 0)
            able = score + most + rest[later] >= least
            docs, score, block = docs[able], score[able], block[able]
            wanted = np.unique(block[block < high])
            if len(wanted):
                there, found = self.blocks(term, wanted)
                spot = np.minimum(np.searchsorted(there, docs), len(there) - 1)
                score = score + np.where(there[spot] == docs, weight * found[spot], 0)
            if len(score) >= top:
                least = max(least, int(np.partition(score, -top)[-top]))
        best = np.lexsort((docs, -score))[:top]
        return docs[best], score[best]


def shard_terms(row_terms: bytes, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which wanted terms a shard has (their places in ``wanted``), and its numbers for them."""
    spot = pc.index_in(pa.array(row_terms.split(), pa.binary()), value_set=wanted)
    own = np.flatnonzero(spot.is_valid().to_numpy(zero_copy_only=False))
    return spot.drop_null().to_numpy(), own


def document_frequency_batches(shared):
    """A task: (terms, df) of shards to (term as its place among those wanted, df)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = pa.array(shared.value, pa.binary())
            total = np.zeros(len(wanted), np.int64)
            for terms, df in zip(batch.column(0), batch.column(1)):
                spot, own = shard_terms(terms.as_py(), wanted)
                total[spot] += np.frombuffer(df.as_py(), np.int32)[own]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    return run


def search_batches(shared, schema: T.StructType, block: int, top: int):
    """A task: shards to (item_id, doc_id, score) of the best documents of each in every shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
        words, weights, items = shared.value
        for batch in batches:
            wanted = pa.array(words, pa.binary())
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                spot, own = shard_terms(row["terms"], wanted)
                number = dict(zip(spot.tolist(), own.tolist()))
                shard, out = Shard(row, block), []
                for item_id, terms in items:
                    held = [(number[t], weights[t]) for t in terms if t in number]
                    docs, scores = shard.search(held, top)
                    out += [(item_id, shard.ids[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds
                )

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """An index written to the shared folder, one row per shard."""

    shards: DataFrame
    stats: CorpusStats
    block: int = BLOCK

    def search(self, items: DataFrame, top: int = TOP, query_chars: int = QUERY_CHARS) -> DataFrame:
        """(item_id, rank, doc_id, score): the ``top`` best documents of each item.

        A document's score sums weight times impact over the item's different terms;
        equal scores rank by ascending doc_id, null last, and documents with score 0 are
        left out. An item without text, or of frequent words only, gives no row. Rows of
        ``items`` with one item_id are one item with all their terms; a null id is an
        item like others. Repeated documents each have a rank of their own.

        Items go in blocks of about ``query_chars`` characters, chosen by a hash of their
        id, so what is sent to the tasks is bounded; each block reads the index once. A
        task searches a shard for all items and gives its ``top`` best of each; those
        heaps are merged by item, cut to ``top`` in every task before they are sent.
        """
        texts = items.select("item_id", F.col("text").cast("string").alias("text"))
        total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
        blocks = -(-total // query_chars)
        kind = T.StructType([
            T.StructField("item_id", items.schema["item_id"].dataType),
            T.StructField("doc_id", self.shards.schema["ids"].dataType.elementType),
            T.StructField("score", T.LongType()),
        ])
        parts = [
            self._block(texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), kind, top)
            for b in range(blocks)
        ]
        nothing = self.shards.sparkSession.createDataFrame([], kind)
        found = reduce(DataFrame.unionByName, parts) if parts else nothing
        best = Window.partitionBy("item_id").orderBy(
            F.desc("score"), F.col("doc_id").asc_nulls_last()
        )
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        return ranked.select("item_id", "rank", "doc_id", "score")

    def _block(self, texts: DataFrame, kind: T.StructType, top: int) -> DataFrame:
        sc = texts.sparkSession.sparkContext
        by_item: dict = {}
        for item_id, text in texts.collect():
            by_item.setdefault(item_id, set()).update(terms_of(text.encode() if text else None))
        words = sorted(set().union(*by_item.values()))
        number = {w: i for i, w in enumerate(words)}
        items = [(k, [number[w] for w in sorted(v)]) for k, v in by_item.items() if v]
        frequencies = self.shards.select("terms", "df").mapInArrow(
            document_frequency_batches(sc.broadcast(words)), "term long, df long"
        )
        weights = [0] * len(words)
        for term, df in frequencies.groupBy("term").agg(F.sum("df")).collect():
            weights[term] = self.stats.weight(df)
        shared = sc.broadcast((words, weights, items))
        return self.shards.mapInArrow(search_batches(shared, kind, self.block, top), kind)


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> LexicalIndex:
    """An index of all ``docs`` (doc_id, text) in the shared folder.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII;
    only A-Z is lowered. Each task cuts the documents it reads into shards of about
    ``shard_bytes`` of text (one document at least), numbers the words of a shard, sorts
    its postings once and writes them with the largest impact of each block: no text is
    shuffled, no word is a key, and a shard that is lost is made again from its input.
    Null and empty texts and texts without a term are not indexed and count nowhere. An
    empty table gives an index of no shard.
    """
    spark = docs.sparkSession
    stats = corpus_stats(docs)
    schema = shard_schema(docs.schema["doc_id"].dataType)
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    path = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    texts.mapInArrow(shard_batches(stats, schema, shard_bytes, block), schema).write.parquet(path)
    return LexicalIndex(spark.read.schema(schema).parquet(path), stats, block)
