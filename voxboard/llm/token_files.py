"""Token ids of documents in ordered binary shards, with a perfect-hash index for access by key."""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxboard.llm.common import keyed
from voxboard.llm.perfect_hash import PerfectHash
from voxboard.session import ensure_checkpoint_dir

END_ID = 2
BLOCK_IDS = 1 << 20
BUCKET_KEYS = 50_000
#: Units whose ids a task keeps.
KEPT_UNITS = 800_000
#: Bytes of text that are encoded together.
ENCODED_BYTES = 6 << 20

# Fixed value: how byte-level tokenizers of this kind cut a text into units.
UNITS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Beyond this, Unicode tables of two libraries may differ; such pieces go to the tokenizer whole.
LATIN = "\u024f"
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it can be seen, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE tokenizer that works on each distinct word once.

    Such a tokenizer starts a new unit at every blank that is followed by something
    else than white space, so texts can be cut before their blanks, the pieces into
    units, and the ids of the units be put together. Arrow numbers the pieces of many
    texts, each different one is looked up once, and numpy lines up their ids. Units
    that were met are kept, up to a bound. Texts with longer runs of white
    space or with a token that the file adds (such as the end of a text), pieces with letters beyond Latin, and files of another kind of tokenizer
    are encoded as they are.
    """

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        cut = rules["pre_tokenizer"] or {}
        self.simple = (
            rules["normalizer"] is None
            and rules["model"]["type"] == "BPE"
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
        )
        # Tokens that are found in a text before it is cut.
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.simple &= not any(t.isspace() or " " in t for t in self.added)
        self.kept = kept
        self.letters = byte_letters()
        self.units: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def unit(self, text: str) -> bytes:
        if len(self.units) >= self.kept:
            self.units.clear()
        spelled = text.encode().decode("latin-1").translate(self.letters)
        found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self.units[text] = found
        return found

    def pieces(self, blank: str, texts: list[str]) -> list[bytes]:
        """Ids of pieces and the blank before each, whatever comes after them."""
        known, unit, out = self.units.get, self.unit, []
        for text in texts:
            # Most pieces are a word, or a word and one mark, and need no cutting.
            if text.isalpha() and (text.isascii() or max(text) <= LATIN):
                whole = blank + text
                ids = known(whole) or unit(whole)
            elif text[-1:] in MARKS and text[:-1].isalpha() and max(text) <= LATIN:
                word, mark = blank + text[:-1], text[-1]
                ids = (known(word) or unit(word)) + (known(mark) or unit(mark))
            elif max(text, default="") <= LATIN:
                ids = b"".join([known(u) or unit(u) for u in UNITS.findall(blank + text)])
            else:
                ids = self.whole(blank + text).tobytes()
            out.append(ids)
        return out

    def holds_added(self, words: pa.Array) -> np.ndarray:
        found = np.zeros(len(words), bool)
        for token in self.added:
            found |= pc.match_substring(words, token).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.simple:
            return [self.whole(t) for t in texts.to_pylist()]
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        names, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        # A blank belongs to the white space around it if there is some on both sides.
        opens = np.array([not p or p[0].isspace() for p in names], bool)
        closes = np.array([not p or p[-1].isspace() for p in names], bool)
        joins = np.zeros(len(codes) + 1, np.int64)
        joins[1:-1] = opens[codes[1:]] & closes[codes[:-1]]
        first = offsets[:-1]
        joins[first] = 0
        joins[:-1] += self.holds_added(words.dictionary)[codes]
        odd = np.add.reduceat(joins, first) > 0 if len(first) else np.zeros(0, bool)
        # The first piece of a text has no blank before it and gets a number of its own.
        table = self.pieces(" ", names) + self.pieces("", [names[c] for c in codes[first]])
        codes = codes.astype(np.int64)
        codes[first] = len(names) + np.arange(len(first))
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begin = np.cumsum(sizes) - sizes
        own = sizes[codes]
        ends = np.cumsum(own)
        total = ends[-1] if len(ends) else 0
        kind = np.int32 if max(total, sizes.sum()) < 1 << 31 else np.int64
        at = np.arange(total, dtype=kind) + np.repeat((begin[codes] - ends + own).astype(kind), own)
        ids = np.frombuffer(b"".join(table), "<u4")[at]
        cuts = np.append(0, ends)[offsets]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.flatnonzero(odd):
            out[i] = self.whole(texts[i].as_py())
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose texts have about ``most`` bytes."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


BLOCK_FIELDS = "shard int, block int, start long, row long, {id}, lengths array<long>, offsets array<long>, width int, payload binary"


def encode_batches(path: str, end_id: int, id_type: pa.DataType, block_ids: int, width: int):
    """A task over (id, text) in order: to blocks of whole documents.

    A block holds the ids of consecutive documents as little-endian integers of
    ``width`` bytes without anything between, at least one document and otherwise
    about ``block_ids`` ids. ``start`` and ``row`` count the ids and documents before
    it in its shard; ``offsets`` and ``lengths`` say where its documents lie.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(path), TaskContext.get().partitionId()
        keys, lengths, parts = [], [], []
        block = start = row = held = 0

        def closed() -> pa.RecordBatch:
            sizes = np.array(lengths, np.int64)
            payload = np.concatenate(parts).astype(f"<u{width}").tobytes()
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([row], pa.int64()),
                pa.array([keys], pa.list_(id_type)),
                pa.array([sizes], pa.list_(pa.int64())),
                pa.array([np.cumsum(sizes) - sizes], pa.list_(pa.int64())),
                pa.array([width], pa.int32()),
                pa.array([payload], pa.binary()),
            ]
            names = ["shard", "block", "start", "row", "ids", "lengths", "offsets", "width", "payload"]
            return pa.RecordBatch.from_arrays(columns, names)

        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in pieces_of(batch, 1, ENCODED_BYTES):
                for key, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1))):
                    keys.append(key)
                    lengths.append(len(ids) + 1)
                    parts += [ids, end]
                    held += len(ids) + 1
                    if held >= block_ids:
                        yield closed()
                        block, start, row = block + 1, start + held, row + len(keys)
                        keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield closed()

    return run


def build_index(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket of keys to its perfect hash and, slot by slot, fingerprint and place."""
    function, slots = PerfectHash.build(rows["h"].to_numpy().view(np.uint64))
    order = np.argsort(slots)
    sizes, packed, rest = function.dump()

    def column(name: str, kind: str) -> bytes:
        return rows[name].to_numpy()[order].astype(kind).tobytes()

    return pd.DataFrame(
        {
            "bucket": [rows["bucket"].iloc[0]],
            "sizes": [sizes],
            "bits": [packed],
            "rest": [rest],
            "prints": [column("f", "<i8")],
            "shards": [column("shard", "<i4")],
            "blocks": [column("block", "<i4")],
            "offsets": [column("offset", "<i8")],
            "lengths": [column("n_tokens", "<i8")],
        }
    )


INDEX_FIELDS = (
    "bucket long, sizes array<long>, bits array<binary>, rest binary, prints binary, "
    "shards binary, blocks binary, offsets binary, lengths binary"
)


def find_places(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Places of the keys of one bucket; keys whose fingerprint differs are not there."""
    names = ["shard", "block", "offset", "n_tokens"]
    if not len(index) or not len(keys):
        return keys.iloc[:0][["id", "copy"]].assign(**{n: np.zeros(0, np.int64) for n in names})
    own = index.iloc[0]
    function = PerfectHash.load(own["sizes"], own["bits"], own["rest"])
    slots = function.find(keys["h"].to_numpy().view(np.uint64))
    prints = np.frombuffer(own["prints"], "<i8")
    good = slots >= 0
    good[good] = prints[slots[good]] == keys["f"].to_numpy()[good]
    out, at = keys.loc[good, ["id", "copy"]], slots[good]
    kinds = {"shard": ("shards", "<i4"), "block": ("blocks", "<i4"), "offset": ("offsets", "<i8")}
    for name, (field, kind) in {**kinds, "n_tokens": ("lengths", "<i8")}.items():
        out[name] = np.frombuffer(own[field], kind)[at].astype(np.int64)
    return out


def digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as they were written: to (shard, block, offset, n_tokens, start, crc) per document."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype("<u4")
            lengths = np.array(r["lengths"], np.int64)
            offsets = np.cumsum(lengths) - lengths
            sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(offsets, lengths)]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, r["shard"], np.int32)),
                    pa.array(np.full(n, r["block"], np.int32)),
                    pa.array(offsets),
                    pa.array(lengths),
                    pa.array(offsets + r["start"]),
                    pa.array(sums, pa.int64()),
                ],
                ["shard", "block", "offset", "n_tokens", "start", "crc"],
            )


def document_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to the ids of each document."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["payload"], f"<u{r['width']}").astype(np.int64)
            ends = np.cumsum(np.array(r["lengths"], np.int64))
            offsets = np.concatenate(([0], ends[:-1]))
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, r["shard"], np.int32)),
                    pa.array(np.full(n, r["block"], np.int32)),
                    pa.array(offsets),
                    pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), ids),
                ],
                ["shard", "block", "offset", "token_ids"],
            )


@dataclass
class TokenFiles:
    """Token files in a folder: ``blocks`` (payloads and directories) and ``index``.

    Documents lie in ascending doc_id order (null first, equal ids by their text's
    hash). A key is a doc_id and a copy number: 0 for the first row of that id, 1 for
    the next. Access by key costs a hash, one bucket and one slot, however many
    documents there are. A key that was never written is told by its 64-bit fingerprint.
    """

    spark: SparkSession
    folder: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    @cached_property
    def shards(self) -> DataFrame:
        """Ids before each shard, and how many copies of its first id lie before it.

        One row per shard, that is per task of the writer, so it is small by nature
        and is worked out at the driver.
        """
        rows = self.blocks().select(
            "shard", "block", "start", F.col("ids")[0].alias("first"),
            F.element_at("ids", -1).alias("last"),
            F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
            F.size(F.filter("ids", lambda x: x.eqNullSafe(F.element_at("ids", -1)))).alias("as_last"),
        )
        per = rows.groupBy("shard").agg(
            F.sum("n").alias("n"),
            F.min_by("first", "block").alias("first"),
            F.max_by("last", "block").alias("last"),
        )
        # Blocks that end with the last id of their shard hold its trailing run.
        tail = (
            rows.join(F.broadcast(per.select("shard", F.col("last").alias("shard_last"))), "shard")
            .filter(F.col("last").eqNullSafe(F.col("shard_last")))
            .groupBy("shard")
            .agg(F.sum("as_last").alias("tail"))
        )
        before, run, made = 0, (object(), 0), []
        for r in sorted(per.join(tail, "shard").select("shard", "n", "first", "last", "tail").collect()):
            copies = run[1] if r["first"] == run[0] else 0
            made.append((r["shard"], before, copies))
            before += r["n"]
            run = (r["last"], r["tail"] + (copies if r["first"] == r["last"] else 0))
        return self.spark.createDataFrame(made, "shard int, before long, copies long")

    def directory(self) -> DataFrame:
        """(id, copy, shard, block, offset, n_tokens) of every document; payloads are not read."""
        starts = self.blocks().select(
            "shard", "block", "row",
            F.posexplode(F.arrays_zip("ids", "lengths", "offsets")).alias("i", "d"),
        )
        rows = starts.select(
            F.col("d.ids").alias("id"), "shard", "block",
            F.col("d.offsets").alias("offset"), F.col("d.lengths").alias("n_tokens"), (F.col("row") + F.col("i")).alias("place"),
        )
        # Equal ids lie side by side: the copy number is the distance to the first one.
        first = rows.groupBy("shard", "id").agg(F.min("place").alias("origin"))
        lead = F.broadcast(self.shards.withColumnRenamed("shard", "s"))
        found = rows.alias("l").join(
            first.alias("r"),
            (F.col("l.shard") == F.col("r.shard")) & F.col("l.id").eqNullSafe(F.col("r.id")),
        ).select("l.*", "r.origin")
        carried = F.when(F.col("origin") == 0, F.col("copies")).otherwise(F.lit(0))
        return found.join(lead, F.col("shard") == F.col("s")).select(
            "id", (F.col("place") - F.col("origin") + carried).alias("copy"),
            "shard", "block", "offset", "n_tokens",
        )

    def buckets(self, rows: int) -> int:
        return max(1, -(-rows // BUCKET_KEYS))

    def write_index(self) -> None:
        n = self.buckets(self.blocks().agg(F.sum(F.size("ids"))).first()[0] or 0)
        rows = hashed(self.directory(), n)
        index = rows.drop("id", "copy").groupBy("bucket").applyInPandas(build_index, INDEX_FIELDS)
        index.withColumn("buckets", F.lit(n)).write.parquet(f"{self.folder}/index")

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(id, copy, shard, block, offset, n_tokens) of the keys (id, copy) that exist."""
        index = self.index()
        head = index.select("buckets").head()
        fields = "id string, copy long, shard int, block int, offset long, n_tokens long"
        asked = hashed(keys.select("id", F.col("copy").cast("long").alias("copy")), head[0] if head else 1)
        # As text, since a null among numbers would make floats of them in the task.
        found = (
            asked.withColumn("id", F.col("id").cast("string"))
            .groupBy("bucket")
            .cogroup(index.drop("buckets").groupBy("bucket"))
            .applyInPandas(find_places, fields)
        )
        return found.withColumn("id", F.col("id").cast(keys.schema["id"].dataType))

    def digests(self, places: DataFrame) -> DataFrame:
        """Position, length and crc32 of the documents at ``places``, from the payloads."""
        fields = "shard int, block int, offset long, n_tokens long, start long, crc long"
        read = self.blocks().select("shard", "block", "start", "lengths", "width", "payload")
        found = read.mapInArrow(digest_batches, fields)
        lead = F.broadcast(self.shards.drop("copies"))
        return (
            places.join(found, ["shard", "block", "offset", "n_tokens"])
            .join(lead, "shard")
            .select(
                "id", "copy", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "crc"
            )
        )

    def read(self, keys: DataFrame) -> DataFrame:
        """(id, copy, token_ids) of the keys that exist."""
        fields = "shard int, block int, offset long, token_ids array<long>"
        read = self.blocks().select("shard", "block", "lengths", "width", "payload")
        places = self.lookup(keys)
        wanted = read.join(places.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
        found = wanted.mapInArrow(document_batches, fields)
        return places.join(found, ["shard", "block", "offset"]).select("id", "copy", "token_ids")


def hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """Two independent hashes of the key, and the bucket that it belongs to."""
    key = [F.col("id").isNull(), F.col("id"), F.col("copy")]
    h = F.xxhash64(*key)
    return rows.withColumns(
        {"h": h, "f": F.xxhash64(F.lit(1), *key), "bucket": F.pmod(F.xxhash64(h), F.lit(buckets))}
    )


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    folder: str | None = None,
    shards: int | None = None,
    block_ids: int = BLOCK_IDS,
) -> TokenFiles:
    """Encode whole texts and write them with their index to ``folder``.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; no
    special tokens are added but ``end_id`` after each document. A null text is an
    empty one and holds the end id alone. The folder must be one that every executor
    reaches; without one, a new folder under the session's checkpoint folder is taken.
    Texts are shuffled once, into ranges of doc_id (and text hash, so that many rows
    of one id are split); an empty table gives files without a block.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs).select("id", "text", "body")
    ordered = texts.repartitionByRange(shards, "id", "body").sortWithinPartitions("id", "body")
    kind = texts.schema["id"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    run = encode_batches(tokenizer, end_id, arrow, block_ids, width)
    blocks = ordered.select("id", "text").mapInArrow(run, BLOCK_FIELDS.format(id=f"ids array<{kind}>"))
    blocks.write.parquet(f"{folder}/blocks")
    files = TokenFiles(spark, folder)
    files.write_index()
    return files


def document_keys(docs: DataFrame) -> DataFrame:
    """(id, copy) of every row: rows of one id are counted, not told apart."""
    counts = docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return counts.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
