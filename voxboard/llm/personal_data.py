"""Personal data by fixed patterns, and terms that give it away, by how often they stand together."""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, same_document, stage, with_columns

KINDS = ("email", "ip", "card", "phone")
#: A term that is replaced by its shape, and one that goes.
ADDED = ("term_general", "term_removed")
#: Words before and after an entity in which it is met.
WINDOW = 8
#: A term discloses an entity from this share of the entity's information on.
THRESHOLD = 0.9
#: Different texts that must hold both, and documents that a rate is drawn to the mean by.
MIN_TEXTS = 3
PRIOR = 2.0
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 200_000
#: Entities and words around them that a task gathers before it hands them on, but for those of one text.
HELD_WORDS = 200_000
#: Documents for each file of what is counted of them and staged on the way, a few rows each.
FILE_DOCS = 25_000
#: Disclosing pairs that are sent to every task; more are joined. Bits of terms that are counted.
BROADCAST_ROWS = 500_000
MAX_BITS = 1 << 27

# Fixed patterns. What may follow a match of digits cannot make an earlier start match,
# so matches begin where a run of digits begins; all of them take time in proportion.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int, str]
#: What a hash stands for besides an entity of a kind, and what a row around an entity is.
TERM, SHAPE = -2, -1
PLAIN, SHAPED, SHAPE_ITSELF = 0, 1, 2


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Local parts go as far left of their sign as they can, but not into the match before."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def in_range(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind as its place in KINDS, start, end, value) of all base matches, by kind and start."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b, text[a:b].lower()) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(in_range(p) for p in m[0].split(".")):
            out.append((1, *m.span(), m[0]))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span(), digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span(), digits))
    return out


def long_hash(kind: int, value: str) -> int:
    """64 bits that name an entity, a term or a shape, as a signed number."""
    found = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), kind + 2)
    return found - (1 << 64) if found >> 63 else found


MARKS = string.punctuation


def term(word: str) -> str:
    """A word in lower case without ASCII marks at its ends."""
    return word.lower().strip(MARKS)


def shape(found: str) -> str | None:
    """What a term is generalised to: its digits no longer tell which; None if it has none."""
    return DIGIT.sub("#", found) if not found.isalpha() and DIGIT.search(found) else None


def contexts(text: str, spans: list[Span], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(entity, term, level, start, end) of the words around each span, but for other spans.

    A word with a digit comes twice, as itself and as its shape.
    """
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    taken = bytearray(len(words))
    places = []
    for kind, a, b, value in spans:
        low, high = bisect_right(ends, a), bisect_left(starts, b)
        taken[low:high] = b"\x01" * (high - low)
        places.append((long_hash(kind, value), low, high))
    for entity, low, high in places:
        for i in (*range(max(0, low - window), low), *range(high, min(len(words), high + window))):
            if taken[i]:
                continue
            word = text[starts[i] : ends[i]]
            if found := term(word):
                # Marks at the ends of the word are no part of the span.
                start = starts[i] + len(word) - len(word.lstrip(MARKS))
                end = start + len(word.strip(MARKS))
                general = shape(found)
                level = PLAIN if general is None else SHAPED
                yield entity, long_hash(TERM, found), level, start, end
                if general is not None:
                    yield entity, long_hash(SHAPE, general), SHAPE_ITSELF, start, end


SCAN = (
    "base_spans array<struct<rank: int, start: bigint, end: bigint, entity: bigint>>, "
    "near array<struct<entity: bigint, term: bigint, level: int, start: bigint, end: bigint>>"
)
SPAN = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("entity", pa.int64())])
NEAR = pa.struct([
    ("entity", pa.int64()), ("term", pa.int64()), ("level", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
])


def scan_batches(window: int, held: int = HELD_WORDS):
    """A task: (id, body, text) to (id, body, base_spans, near), in the order of the texts."""

    def handed(batch: pa.RecordBatch, spans: list, near: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, pa.list_(SPAN)), pa.array(near, pa.list_(NEAR))],
            ["id", "body", "base_spans", "near"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, near, done, words = [], [], 0, 0
            for text in batch.column(2):
                found = base_spans(text := text.as_py())
                spans.append([(k, a, b, long_hash(k, v)) for k, a, b, v in found])
                near.append(list(contexts(text, found, window)) if found else [])
                words += len(found) + len(near[-1])
                if words > held:
                    yield handed(batch.slice(done, len(spans)), spans, near)
                    done, spans, near, words = done + len(spans), [], [], 0
            yield handed(batch.slice(done), spans, near)

    return run


def term_batches(marked, held: int):
    """A task: texts to (term, docs), how many of its documents hold each term or shape.

    Only those whose bit is set in ``marked``; terms are told apart exactly afterwards.
    """

    def handed(counts: Counter, kind: int) -> pa.RecordBatch:
        bits = marked.value
        found = np.array([long_hash(kind, name) for name in counts], np.int64)
        docs = np.fromiter(counts.values(), np.int64, len(counts))
        bit = found % (64 * len(bits))
        some = (bits[bit >> 6] >> (bit & 63)) & 1 == 1
        return pa.RecordBatch.from_arrays([pa.array(found[some]), pa.array(docs[some])], ["term", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, shapes = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0):
                found = {w.strip(MARKS) for w in WORD.findall(text.as_py().lower())}
                found.discard("")
                terms.update(found)
                shapes.update({g for f in found if not f.isalpha() and (g := shape(f)) is not None})
                if len(terms) > held:
                    yield handed(terms, TERM)
                    yield handed(shapes, SHAPE)
                    terms, shapes = Counter(), Counter()
        yield handed(terms, TERM)
        yield handed(shapes, SHAPE)

    return run


def files(total: int) -> int:
    """In how many files what is left of so many documents is staged; a task each would write a few rows."""
    return 1 + total // FILE_DOCS


def bitmap(terms: DataFrame, rows: int) -> np.ndarray:
    """Bits of the hashes of ``terms``: sixteen per term, at most MAX_BITS (16 MB) in all."""
    bits = min(MAX_BITS, max(64, 1 << (16 * rows).bit_length()))
    bit = F.pmod("term", F.lit(bits))
    words = terms.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(term, 64L) as int))").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    for word, mask in words.groupBy("word").agg(F.bit_or("mask")).collect():
        out[word] = mask
    return out


def disclosing(
    texts: DataFrame, scanned: DataFrame, total: int, threshold: float, min_texts: int, held: int
) -> DataFrame:
    """(entity, term): what a term tells of an entity reaches ``threshold`` of all there is to tell.

    An entity in a share p of the documents has -log p bits of information. A term tells
    log(q / p) of them, their pointwise mutual information, where q is the share of the
    term's documents in which the entity is near. Rates of few documents are drawn to p
    by PRIOR documents, and ``min_texts`` different texts must hold both. ``total`` is the
    number of documents.
    """
    near = scanned.select("id", "body", F.inline("near"))
    once = near.select("entity", "term", "id", "body").distinct()
    by_text = once.groupBy("entity", "term", "body").agg(F.count("*").alias("docs"))
    both = by_text.groupBy("entity", "term").agg(F.sum("docs").alias("both"), F.count("*").alias("texts"))
    both = stage(both.filter(F.col("texts") >= min_texts).drop("texts").repartition(files(total)), "together")
    wanted = both.select("term").distinct()
    rows = wanted.count()
    marked = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, rows))
    counted = texts.select("text").mapInArrow(term_batches(marked, held), "term long, docs long")
    docs = counted.groupBy("term").agg(F.sum("docs").alias("docs"))
    entities = scanned.select("id", "body", F.inline("base_spans")).select("id", "body", "entity").distinct()
    holders = entities.groupBy("entity").agg(F.count("*").alias("holders"))
    p = F.col("holders") / F.lit(float(max(1, total)))
    q = (F.col("both") + PRIOR * p) / (F.col("docs") + PRIOR)
    told = both.join(docs, "term").join(holders, "entity")
    return told.filter((p < 1) & (F.log(q / p) >= -F.log(p) * threshold)).select("entity", "term")


def personal_data(
    docs: DataFrame,
    window: int = WINDOW,
    threshold: float = THRESHOLD,
    min_texts: int = MIN_TEXTS,
    held: int = HELD_TERMS,
) -> DataFrame:
    """(id, body, base_spans, spans) of every document; spans are (rank, start, end) by rank and start.

    Ranks are places in KINDS and then in ADDED. Base kinds are fixed patterns, leftmost
    matches without overlap per kind; an address part over 255, a card number that fails
    its check digit and a telephone number of fewer than 9 or more than 15 digits are
    dropped. Their values (an address in lower case, the digits of a number) are the
    entities to protect. Around each of them, ``window`` words to both sides, stand terms:
    words in lower case without marks at their ends, outside base spans. A term that
    discloses an entity beyond ``threshold`` is a span of its own wherever it stands near
    that entity: ``term_general`` if its shape, with ``#`` for digits, does not disclose
    it, else ``term_removed``. Documents without an entity have no span.

    All counts cover all documents. Offsets are code points, ends exclusive. A null text is
    an empty one; repeated rows each give a row and count each as a document, but as one
    text; null ids are documents like others; an empty table gives an empty one.
    """
    texts = keyed(docs).select("id", "body", "text")
    kind = texts.schema["id"].dataType.simpleString()
    scanned = stage(texts.mapInArrow(scan_batches(window), f"id {kind}, body long, {SCAN}"), "entities")
    base = F.transform("base_spans", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    found = scanned.select("id", "body", base.alias("base_spans"))
    total = scanned.count()
    telling = disclosing(texts, scanned, total, threshold, min_texts, held)
    telling = stage(telling.repartition(files(total)), "disclosing")
    small = telling.count() <= BROADCAST_ROWS
    near = scanned.select("id", "body", F.inline("near"))
    hits = near.join(F.broadcast(telling) if small else telling, ["entity", "term"])
    level = F.col("level")
    places = hits.groupBy("id", "body", "start", "end").agg(
        F.bool_or(level != SHAPE_ITSELF).alias("own"),
        F.bool_or(level == SHAPED).alias("shaped"),
        F.bool_or(level == SHAPE_ITSELF).alias("shape_tells"),
    )
    rank = F.when(F.col("shaped") & ~F.col("shape_tells"), len(KINDS)).otherwise(len(KINDS) + 1)
    added = places.filter("own").groupBy("id", "body").agg(F.collect_list(F.struct(rank.alias("rank"), "start", "end")).alias("added"))
    joined = found.alias("l").join(added.alias("r"), same_document(), "left")
    more = F.coalesce("r.added", F.array().cast(found.schema["base_spans"].dataType))
    return joined.select("l.id", "l.body", "l.base_spans", F.sort_array(F.concat("l.base_spans", more)).alias("spans"))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """A text with its spans replaced; of overlapping ones the first, and the longest of those."""
    out, at = [], 0
    for start, end, rank in sorted(((a, -b, k) for k, a, b in spans)):
        if start < at:
            continue
        general = rank == len(KINDS) and DIGIT.sub("#", text[start:-end])
        out += [text[at:start], general or f"[{KINDS[rank] if rank < len(KINDS) else 'term'}]"]
        at = -end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``text`` without what ``personal_data`` finds, and ``spans``, those of the text before.

    Entities become their kind in brackets, terms their shape or ``[term]``; a null text
    becomes an empty one, and a column ``spans`` is replaced.
    """
    found = personal_data(docs, **options).select("id", "body", "spans").dropDuplicates(["id", "body"])
    joined = keyed(docs).alias("l").join(found.alias("r"), same_document()).select("l.*", "r.spans")
    names, place = joined.columns, joined.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(s["rank"], s["start"], s["end"]) for s in x] for x in batch.column(len(names) - 1).to_pylist()]
            made = [replaced(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(place), spans)]
            columns = list(batch.columns)
            columns[place] = pa.array(made, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    done = joined.mapInArrow(run, joined.schema)
    return with_columns(done, docs, {"text": F.col("text"), "spans": F.col("spans")})


def joined_spans(spans: str) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
