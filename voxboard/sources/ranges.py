"""Records of large text files, cut out by byte ranges wherever they begin and end.

Spark deals out a file in ranges and cuts each at a separator of a few bytes. A record
may hold separators of its own (line breaks in quotes, brackets inside brackets), so a
range alone does not know where its first record begins. Each range is therefore scanned
as if it began outside quotes and as if it began inside; what that does to the state is
one short row per range. Folding those rows in the order of the file gives the true state
at each beginning, and a second scan cuts the records. What is left of records that go
over a border is put together by the range in which they begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Piece = bytes
Place = tuple[int, int, int]
#: Files are worked on together up to so many ranges, of which the driver keeps a row each.
GROUP_RANGES = 50_000


@dataclass(frozen=True)
class State:
    """Where a scan stands: inside quotes or not, and how many brackets are open."""

    quoted: bool = False
    depth: int = 0


@dataclass(frozen=True)
class Change:
    """What a range does to a state: quotes after it, brackets it opens, the lowest depth
    that it comes to (0 is where it begins)."""

    quoted: bool
    delta: int = 0
    low: int = 0


def quoted_after(line: str, quoted: bool, sep: str) -> bool:
    """Whether a quoted field is open after a line of delimited text.

    A quote opens only at the beginning of a field; inside, two quotes are one.
    """
    if '"' not in line:
        return quoted
    opening, at = sep + '"', 0
    if not quoted and line.startswith('"'):
        quoted, at = True, 1
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            quoted, at = False, at + 1
        else:
            at = line.find(opening, at)
            if at < 0:
                return False
            quoted, at = True, at + 2


@dataclass(frozen=True)
class DelimitedScan:
    """Records of delimited text; a line break inside quotes does not end one."""

    encoding: str = "UTF-8"
    sep: str = ","

    @property
    def separator(self) -> bytes:
        return "\n".encode(self.encoding)

    def lines(self, block: int, pieces: Iterable[Piece]) -> Iterator[str]:
        """Decoded lines. In wide encodings a separator may seem to lie across two characters."""
        width, held, first = len(self.separator), b"", block == 0
        for piece in pieces:
            held += piece
            if len(held) % width:
                held += self.separator
                continue
            line = held.decode(self.encoding, errors="replace")
            yield line.removeprefix("﻿") if first else line
            held, first = b"", False
        if held:
            raise ValueError("a range ends inside a character")

    def changes(self, block: int, pieces: Iterable[Piece]) -> tuple[Change, Change, None]:
        now, ended = [False, True], [False, False]
        for line in self.lines(block, pieces):
            for q in (0, 1):
                now[q] = quoted_after(line, now[q], self.sep)
                ended[q] |= not now[q]
        return *(Change(q, low=-1 if e else 0) for q, e in zip(now, ended)), None

    def inside(self, state: State) -> bool:
        return state.quoted

    def ends(self, state: State, change: Change) -> bool:
        return change.low < 0

    def cut(self, path: str, block: int, pieces: Iterable[Piece], state: State) -> Iterator[tuple[bytes, bool]]:
        """Texts of records and whether they end here; a text that does not comes last."""
        held, quoted = "", state.quoted
        for line in self.lines(block, pieces):
            quoted = quoted_after(line, quoted, self.sep)
            if quoted:
                held += line + "\n"
            else:
                yield (held + line.removesuffix("\r")).encode(), True
                held = ""
        if quoted:
            yield held.encode(), False


STRING = rb'"(?:[^"\\]++|\\.)*+("?)'
TOKEN = re.compile(STRING + rb"|[\[\]{}]", re.S)
REST = re.compile(STRING[1:], re.S)
OPEN, CLOSE = b"[{", b"]}"


def brackets(data: bytes, quoted: bool) -> tuple[list[tuple[int, int]], bool]:
    """Brackets outside strings (where, which), and whether a string is open at the end."""
    at = 0
    if quoted:
        rest = REST.match(data)
        if not rest[1]:
            return [], True
        at = rest.end()
    found, last = [], b'"'
    for m in TOKEN.finditer(data, at):
        if data[m.start()] == 0x22:
            last = m[1]
        else:
            found.append((m.start(), data[m.start()]))
    return found, not last


def key_before(data: bytes, at: int) -> str | None:
    """The member name whose value begins at ``at``."""
    before = data[:at].rstrip()
    if not before.endswith(b":"):
        return None
    before = before[:-1].rstrip()
    name = before[before.rfind(b'"', 0, len(before) - 1) + 1 : -1]
    return name.decode("utf-8", "replace") if before.endswith(b'"') else None


@dataclass(frozen=True)
class JsonScan:
    """Objects of a JSON document that stand in the list at ``depth`` open brackets.

    ``between`` limits them, per file, to places from one up to another: the list that
    is the value of one member.
    """

    depth: int = 1
    between: dict[str, tuple[Place, Place]] = field(default_factory=dict)
    separator = b"}"

    def scan(self, pieces: Iterable[Piece], quoted: bool) -> Iterator[tuple[bytes, list[tuple[int, int]], bool]]:
        # The byte that ends a piece is part of it.
        for piece in pieces:
            data = piece + b"}"
            found, quoted = brackets(data, quoted)
            yield data, found, quoted

    def changes(self, block: int, pieces: Iterable[Piece]) -> tuple[Change, Change, str | None]:
        """What a range does, and what the document is by its first range."""
        quoted, delta, low = [False, True], [0, 0], [0, 0]
        head, roots = b"", 0
        for piece in pieces:
            data = piece + b"}"
            head = head or data.removeprefix(b"\xef\xbb\xbf").lstrip()[:1]
            for q in (0, 1):
                found, quoted[q] = brackets(data, quoted[q])
                for _, byte in found:
                    roots += q == 0 and byte == 0x7B and delta[0] == 0
                    delta[q] += 1 if byte in OPEN else -1
                    low[q] = min(low[q], delta[q])
        # Objects one after the other are lines.
        form = {b"[": "list", b"{": "lines" if roots > 1 else "object"}.get(head, "other")
        return *map(Change, quoted, delta, low), form if block == 0 else None

    def inside(self, state: State) -> bool:
        return state.depth > self.depth

    def ends(self, state: State, change: Change) -> bool:
        return state.depth + change.low <= self.depth

    def cut(self, path: str, block: int, pieces: Iterable[Piece], state: State) -> Iterator[tuple[bytes, bool]]:
        first, last = self.between.get(path, ((-1, 0, 0), (1 << 62, 0, 0)))
        depth, held = state.depth, [] if self.inside(state) else None
        for number, (data, found, _) in enumerate(self.scan(pieces, state.quoted)):
            begin = 0
            for at, byte in found:
                if byte in OPEN:
                    if byte == 0x7B and depth == self.depth and first < (block, number, at) < last:
                        begin, held = at, []
                    depth += 1
                else:
                    depth -= 1
                    if depth == self.depth and held is not None:
                        yield b"".join([*held, data[begin : at + 1]]), True
                        held = None
            if held is not None:
                held.append(data[begin:])
        if held is not None:
            yield b"".join(held), False

    def members(self, block: int, pieces: Iterable[Piece], state: State) -> Iterator[tuple[str | None, bool, Place]]:
        """Members of the outermost object whose value is a list or an object."""
        depth = state.depth
        for number, (data, found, _) in enumerate(self.scan(pieces, state.quoted)):
            for at, byte in found:
                if byte in OPEN:
                    if depth == 1:
                        yield key_before(data, at), byte == 0x5B, (block, number, at)
                    depth += 1
                else:
                    depth -= 1


Scan = DelimitedScan | JsonScan


def file_groups(spark: SparkSession, paths: list[str], most: int = GROUP_RANGES) -> list[list[str]]:
    """Files in groups of at most so many ranges, or of one file."""
    sizes = spark.read.format("binaryFile").load(paths).select("path", "length").collect()
    length = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    out, held = [], most
    for path, size in sorted(sizes):
        own = size // length + 2
        if held + own > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += own
    return out


def pieces(spark: SparkSession, paths: list[str], scan: Scan) -> DataFrame:
    """(path, block, value): the files between separators, in the ranges they are dealt out in."""
    separator = scan.separator.decode("latin-1")
    lines = spark.read.option("lineSep", separator).text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )


def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[Piece]]]:
    """The pieces of a task, range by range."""

    def rows() -> Iterator[tuple[str, int, Piece]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())

    for key, own in groupby(rows(), key=lambda r: (r[0], r[1])):
        yield key, (r[2] for r in own)


CHANGES = "path string, block long, quoted array<boolean>, delta array<long>, low array<long>, form string, broken boolean"


def changes(spark: SparkSession, paths: list[str], scan: Scan) -> DataFrame:
    """One row per range: what it does to a state outside quotes, and to one inside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), own in ranges(batches):
            broken = False
            try:
                *both, form = scan.changes(block, own)
            except ValueError:
                both, form, broken = [Change(False)] * 2, None, True
            yield pa.RecordBatch.from_pydict(
                {
                    "path": [path], "block": pa.array([block], pa.int64()),
                    "quoted": [[c.quoted for c in both]], "delta": [[c.delta for c in both]],
                    "low": [[c.low for c in both]], "form": pa.array([form], pa.string()), "broken": [broken],
                }
            )

    return pieces(spark, paths, scan).mapInArrow(run, CHANGES)


@dataclass(frozen=True)
class Start:
    """The state in which a range begins and, inside a record, the range where that began."""

    state: State
    owner: int | None


def starts(rows: Iterable, scan: Scan) -> dict[tuple[str, int], Start]:
    """Fold the changes of all ranges in the order of their files."""
    out = {}
    for path, own in groupby(sorted(rows, key=lambda r: (r["path"], r["block"])), key=lambda r: r["path"]):
        state, owner = State(), None
        for r in own:
            out[path, r["block"]] = Start(state, owner)
            change = Change(*(r[c][state.quoted] for c in ("quoted", "delta", "low")))
            after = State(change.quoted, state.depth + change.delta)
            if not scan.inside(after):
                owner = None
            elif not scan.inside(state) or scan.ends(state, change):
                owner = r["block"]
            state = after
    return out


RECORDS = "path string, block long, row long, part long, whole boolean, record binary"


def records(spark: SparkSession, paths: list[str], scan: Scan, known: dict[tuple[str, int], Start]) -> DataFrame:
    """(path, block, row, record): all records, with the range in which they begin.

    Rows count up inside a range. Only pieces of records that go over a border are
    grouped, by the range of their beginning.
    """
    shared = spark.sparkContext.broadcast((scan, known))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, known = shared.value
        for (path, block), own in ranges(batches):
            # All scans read the same files: the ranges depend on how many bytes are read together.
            if (start := known.get((path, block))) is None:
                continue
            out, row = [], 0
            for at, (text, ended) in enumerate(scan.cut(path, block, own, start.state)):
                if at == 0 and start.owner is not None:
                    out.append((path, start.owner, None, block, False, text))
                else:
                    out.append((path, block, row, block, ended, text))
                row += 1
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    found = pieces(spark, paths, scan).mapInArrow(run, RECORDS)
    parts = found.filter("not whole").groupBy("path", "block").agg(
        F.max("row").alias("row"),
        F.array_sort(F.collect_list(F.struct("part", "record"))).alias("parts"),
    )
    glued = F.aggregate("parts", F.lit(b""), lambda text, x: F.concat(text, x["record"]))
    # Without a row it is the rest of something that is no record.
    joined = parts.filter("row is not null").select("path", "block", "row", glued.alias("record"))
    both = found.filter("whole").select("path", "block", "row", "record").unionByName(joined)
    # A character may lie across a border; bytes become text when they are together.
    return both.withColumn("record", F.decode("record", "UTF-8"))


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["path", "block", "row", "part", "whole", "record"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def members(spark: SparkSession, paths: list[str], known: dict[tuple[str, int], Start]) -> DataFrame:
    """(path, key, is_list, block, piece, at): members of the outermost objects of documents."""
    scan = JsonScan()
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), own in ranges(batches):
            if (start := shared.value.get((path, block))) is None:
                continue
            for key, is_list, (_, number, at) in scan.members(block, own, start.state):
                yield pa.RecordBatch.from_pydict(
                    {"path": [path], "key": pa.array([key], pa.string()), "is_list": [is_list],
                     "block": [block], "piece": [number], "at": [at]}
                )

    kind = "path string, key string, is_list boolean, block long, piece long, at long"
    return pieces(spark, paths, scan).mapInArrow(run, kind)
