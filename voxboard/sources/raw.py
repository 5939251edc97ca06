"""Raw review exports: JSON, CSV and TSV files of one folder as one DataFrame.

Every row keeps ``src_file`` (the path) and ``src_pos``, its place in the files,
because the first copy of a review in file order is the one that is kept.

How files are laid out is found out by one pass of Spark over all their lines,
which brings one short row per file to the driver.
"""

from __future__ import annotations

import csv
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.functions.dates import parse_date_number
from voxboard.model import RAW_FIELDS
from voxboard.sources.ranges import (
    DelimitedScan,
    JsonScan,
    changes,
    file_groups,
    members,
    quoted_after,
    records,
    starts,
)

# List-valued keys of wrapped exports and accepted file suffixes.
WRAPPER_KEYS = ["reviews", "data", "results", "items"]
SUFFIXES = (".json", ".csv", ".tsv")
DATE_NAMES = {n.lower() for n in RAW_FIELDS["date"] + RAW_FIELDS["millis"]}
DELIMITERS = ",\t;"
#: Encodings whose records can be cut by byte ranges.
CHARSETS = ("UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE")


def with_position(df: DataFrame) -> DataFrame:
    """Add where in the files a row stands; orders rows inside one file."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("src_pos"),
    )


def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed column names; of equal names the last one counts."""
    last = {name.strip().lstrip("\ufeff").lower(): i for i, name in enumerate(df.columns)}
    if list(last) == df.columns:
        return df
    renamed = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"c{i}").alias(name) for name, i in last.items()])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: union_raw(a, b), parts)


def _as_text(df: DataFrame, name: str) -> Column:
    """A column as text; a number in a date column as the date that it stands for."""
    c = F.col(f"`{name}`")
    if name in DATE_NAMES and isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(parse_date_number(c).cast("string"), c.cast("string"))
    return c.cast("string")


def union_raw(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by column name; a column typed differently on both sides becomes text.

    Epochs are numbers, so a date column that is a number on one side is read as such
    before it becomes text.
    """
    types_a, types_b = dict(a.dtypes), dict(b.dtypes)
    clash = [c for c in types_a if c in types_b and types_a[c] != types_b[c]]
    a = a.withColumns({c: _as_text(a, c) for c in clash}) if clash else a
    b = b.withColumns({c: _as_text(b, c) for c in clash}) if clash else b
    return a.unionByName(b, allowMissingColumns=True)


@dataclass(frozen=True)
class Layout:
    """What all lines of a file say of it."""

    path: str
    encoding: str
    header: str
    multiline: bool
    json_lines: bool

    def delimiter(self) -> str:
        outside = "".join(self.header.split('"')[::2])
        most = max(DELIMITERS, key=outside.count)
        return most if most in outside else ","


def layouts(spark: SparkSession, paths: list[str]) -> list[Layout]:
    """Encoding, header and form of each file, judged by all its bytes.

    A file is UTF-8 if every line is. Otherwise it is UTF-16 if it starts with a byte
    order mark or most lines hold zero bytes, and else Latin-1. A line with an odd
    number of quotes means that some record goes over several lines. A JSON file of
    several lines, each of them an object, can be read line by line.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"),
        "value",
    )
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    filled = F.btrim(value) != ""
    entire = F.btrim(value).startswith("{") & F.btrim(value).endswith("}")
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8(value)).alias("utf8"),
        F.count_if(F.contains(value, F.lit("\0"))).alias("zeros"),
        F.count("*").alias("lines"),
        F.min_by(F.hex(value.cast("binary")), "place").alias("first"),
        F.bool_or(quotes % 2 == 1).alias("odd"),
        (F.bool_and(~filled | entire) & (F.count_if(filled) > 1)).alias("objects"),
    )
    found = []
    for r in facts.toLocalIterator():
        first = bytes.fromhex(r["first"])
        encoding = "UTF-8" if r["utf8"] else "ISO-8859-1"
        if first[:2] in (b"\xff\xfe", b"\xfe\xff"):
            encoding = "UTF-16LE" if first[:1] == b"\xff" else "UTF-16BE"
        elif 2 * r["zeros"] > r["lines"]:
            encoding = "UTF-16LE"
        # The line ends inside the line break of a wide encoding.
        header = first.decode(encoding, errors="ignore").lstrip("\ufeff").rstrip("\r\n\0")
        wide = encoding.startswith("UTF-16")
        found.append(Layout(r["path"], encoding, header, r["odd"] or wide, r["objects"] and not wide))
    return sorted(found, key=lambda x: x.path)


def of(known: dict, paths: list[str]) -> dict:
    """The beginnings of the ranges of some files."""
    wanted = set(paths)
    return {key: start for key, start in known.items() if key[0] in wanted}


def _record_rows(found: DataFrame) -> DataFrame:
    position = F.struct(F.col("block"), F.col("row"))
    return found.select(F.col("path").alias("src_file"), position.alias("src_pos"), "record")


def _chosen_lists(spark: SparkSession, paths: list[str], known: dict) -> dict[str, tuple]:
    """Per file the places between which the list of the first wrapper key that has one stands."""
    by_file = defaultdict(list)
    for r in members(spark, paths, known).collect():
        by_file[r["path"]].append(((r["block"], r["piece"], r["at"]), r["key"], r["is_list"]))
    out = {}
    for path, found in by_file.items():
        found.sort()
        # Of equal keys the last one counts.
        lists = {key: i for i, (_, key, is_list) in enumerate(found) if is_list}
        at = next((lists[k] for k in WRAPPER_KEYS if k in lists), None)
        if at is not None:
            end = found[at + 1][0] if at + 1 < len(found) else (1 << 62, 0, 0)
            out[path] = (found[at][0], end)
    return out


def _elements(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """The review objects of JSON documents, each still as text, and files of JSON lines.

    A document is a list, an object wrapping a list, or one object; whatever is
    no object inside a list is passed over. Lists are cut by byte ranges, however long a
    document or a line of it is; a document that is one object is one row.
    """
    parts, by_line = [], []
    for group in file_groups(spark, paths):
        rows = changes(spark, group, JsonScan()).collect()
        form = {r["path"]: r["form"] for r in rows if r["form"]}
        by_line += [p for p in group if form.get(p) == "lines"]
        lists = [p for p in group if form.get(p) == "list"]
        objects = [p for p in group if form.get(p) == "object"]
        known = starts(rows, JsonScan())
        wrapped = _chosen_lists(spark, group, of(known, objects)) if objects else {}
        if lists:
            parts.append(_record_rows(records(spark, group, JsonScan(), of(known, lists))))
        if wrapped:
            scan = JsonScan(2, wrapped)
            inner = starts([r for r in rows if r["path"] in wrapped], scan)
            parts.append(_record_rows(records(spark, group, scan, inner)))
        if single := [p for p in objects if p not in wrapped]:
            whole = with_position(spark.read.text(single, wholetext=True))
            parts.append(whole.select("src_file", "src_pos", F.col("value").alias("record")))
    found = reduce(DataFrame.unionByName, parts).withColumnRenamed("record", "element") if parts else None
    return found, by_line


def _infer(spark: SparkSession, elements: DataFrame) -> T.StructType:
    strings = getattr(elements.select("element")._jdf, "as")(
        spark._jvm.org.apache.spark.sql.Encoders.STRING()
    )
    return DataFrame(spark._jsparkSession.read().json(strings), spark).schema


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The objects of JSON lines, each still as text; files can be split."""
    rows = with_position(spark.read.text(paths))
    return rows.filter(F.btrim("value").startswith("{")).select(
        "src_file", "src_pos", F.col("value").alias("element")
    )


def scan_json(
    spark: SparkSession,
    paths: str | list[str],
    lines: bool | None = None,
    schema: T.StructType | None = None,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """A list of objects, an object wrapping such a list, or one object per file or line.

    ``lines=True`` reads one object per line. Without it, files that hold one object
    after the other are read line by line, and lists are cut by byte ranges. Every form
    but a single object per file is split over many tasks. Objects that do not fit the
    ``schema`` have nulls, or are an error in ``mode`` FAILFAST.
    """
    files = [paths] if isinstance(paths, str) else list(paths)
    listed, by_line = (None, files) if lines else _elements(spark, files)
    parts = ([_lines(spark, by_line)] if by_line else []) + ([listed] if listed is not None else [])
    if not parts:
        raise ValueError(f"no JSON objects in {paths}")
    elements = reduce(DataFrame.unionByName, parts)
    if schema is None:
        schema = _infer(spark, elements)
    if not schema.fields:
        raise ValueError(f"no JSON objects in {paths}")
    parsed = elements.select("src_file", "src_pos", "element", F.from_json("element", schema, {"mode": mode}).alias("e"))
    columns = []
    for f in schema.fields:
        c = F.col("e")[f.name]
        if f.name.strip().lower() in DATE_NAMES and isinstance(f.dataType, T.StringType):
            # Numbers and texts were mixed: a number is an epoch, a text is not.
            number = F.col("element").rlike(rf'"{re.escape(f.name)}"\s*:\s*-?[0-9]')
            c = F.when(number, F.coalesce(parse_date_number(c.try_cast("double")).cast("string"), c)).otherwise(c)
        columns.append(c.alias(f.name))
    return normalise_headers(parsed.select(*columns, "src_file", "src_pos"))


def scan_csv(
    spark: SparkSession,
    paths: str | list[str],
    encoding: str | None = None,
    sep: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Delimited exports, every column as text.

    Files that agree in encoding, delimiter and header are read in one scan. Files with
    records over several lines, and UTF-16, are cut into records by byte ranges.
    """
    groups: dict[tuple, list[str]] = defaultdict(list)
    for x in layouts(spark, [paths] if isinstance(paths, str) else list(paths)):
        many = x.multiline if multiline is None else multiline
        header = x.header
        if encoding:
            header = header.encode(x.encoding, "ignore").decode(encoding, "ignore")
        groups[(encoding or x.encoding, sep or x.delimiter(), header, many)].append(x.path)
    parts = []
    for (enc, delimiter, header, many), files in groups.items():
        # A header that goes over several lines is left to Spark's reader.
        by_range = many and enc in CHARSETS and not quoted_after(header, False, delimiter)
        if by_range:
            cut, files = _delimited(spark, files, DelimitedScan(enc, delimiter), header)
            parts += cut
        if files:
            df = (
                spark.read.option("header", "true")
                .option("sep", delimiter)
                .option("encoding", enc)
                .option("quote", '"')
                .option("escape", '"')
                .option("multiLine", str(many).lower())
                .option("inferSchema", "false")
                .csv(files)
            )
            parts.append(normalise_headers(with_position(df)))
    return _union(parts)


def _delimited(
    spark: SparkSession, files: list[str], scan: DelimitedScan, header: str
) -> tuple[list[DataFrame], list[str]]:
    """Rows of files cut by byte ranges, and the files in which a range ends inside a character."""
    names = next(csv.reader([header], delimiter=scan.sep))
    # Of equal names the last one counts.
    last = {n.strip().lower() or f"_c{i}": i for i, n in enumerate(names)}
    kinds = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": scan.sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    parts, left = [], []
    for group in file_groups(spark, files):
        rows = changes(spark, group, scan).collect()
        broken = {r["path"] for r in rows if r["broken"]}
        left += sorted(broken)
        if not (whole := [p for p in group if p not in broken]):
            continue
        found = records(spark, group, scan, of(starts(rows, scan), whole))
        # The first record is the header; an empty one is no row.
        rows = _record_rows(found.filter("(block > 0 or row > 0) and record <> ''"))
        parsed = rows.select("src_file", "src_pos", F.from_csv("record", kinds, options).alias("r"))
        parts.append(parsed.select(*[F.col(f"r.c{i}").alias(n) for n, i in last.items()], "src_file", "src_pos"))
    return parts, left


def discover_raw(spark: SparkSession, folder: str) -> list[str]:
    """Export files of a folder, by path; other files are passed over."""
    found = spark.read.format("binaryFile").load(folder).inputFiles()
    return sorted(p for p in found if p.lower().endswith(SUFFIXES))


def scan_raw(
    spark: SparkSession, folder_or_files: str | list[str], json_lines: bool | None = None
) -> DataFrame:
    """All rows of all export files, with their place in the files."""
    if isinstance(folder_or_files, str):
        files = discover_raw(spark, folder_or_files)
    else:
        files = sorted(folder_or_files)
    if not files:
        raise FileNotFoundError(f"no raw export files in {folder_or_files}")
    unknown = [f for f in files if not f.lower().endswith(SUFFIXES)]
    if unknown:
        raise ValueError(f"unsupported export type: {unknown}")
    json_files = [f for f in files if f.lower().endswith(".json")]
    text_files = [f for f in files if not f.lower().endswith(".json")]
    parts = []
    if json_files:
        parts.append(scan_json(spark, json_files, lines=json_lines))
    if text_files:
        parts.append(scan_csv(spark, text_files))
    return _union(parts)


def require_nonempty(df: DataFrame, what: str = "rows") -> DataFrame:
    """An empty input is an error, never an empty report."""
    if df.isEmpty():
        raise ValueError(f"no {what} to work on")
    return df
