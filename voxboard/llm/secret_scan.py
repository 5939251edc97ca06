"""Find secrets in texts: fixed patterns, and runs of high entropy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, with_columns
from voxboard.operators.barrier import compute_once

# Fixed patterns, in the order in which kinds are listed.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE_CHARS = 12


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one alphabet, and how much entropy a window of them may have.

    ``pattern`` finds the candidates, ``alphabet`` lists their characters. Windows
    of ``window`` characters with at least ``bits`` of Shannon entropy are hits, in
    candidates that hold a match of ``needs``.
    """

    kind: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    needs: str = ""


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    # 16 random hexadecimal digits have 3.1 bits on average, numbers and dates less.
    CharacterClass("entropy_hex", r"[0-9A-Fa-f]{16,}", DIGITS + "abcdefABCDEF", 16, 2.9),
    # 20 random base64 characters have 4.1 bits; runs without a digit are words.
    CharacterClass(
        "entropy_base64",
        r"[A-Za-z0-9+/=_-]{20,}",
        DIGITS + LOWER + UPPER + "+/=_-",
        20,
        3.7,
        "[0-9]",
    ),
)

#: Candidates that match one of these are no secrets, whatever their entropy. Repeated groups
#: take all they can and give nothing back: otherwise each repeat stays on Java's stack.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+(?:[-_/=+][0-9]{1,4})*+$",
    r"^(?i:0123456789abcdef|abcdefghijklmnopqrstuvwxyz0123456789).*$",
    r"(?i:example|sample|dummy|placeholder)",
)
SCALE = 1 << 20


@dataclass(frozen=True)
class Entropy:
    """Integer arithmetic of a window: sums of c*log2(c), scaled, so they are exact."""

    rule: CharacterClass
    terms: list[int] = field(init=False)
    limit: int = field(init=False)

    def __post_init__(self):
        w = self.rule.window
        terms = [0, *(round(c * math.log2(c) * SCALE) for c in range(1, w + 1))]
        object.__setattr__(self, "terms", terms)
        # H = log2(w) - sum / w >= bits
        object.__setattr__(self, "limit", math.floor(w * (math.log2(w) - self.rule.bits) * SCALE))


def running_totals(lengths: Column, block: int = 256) -> Column:
    """Sum of the elements before each one; two levels, so long arrays stay cheap."""

    def before(values: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("s"))

        def add(acc: Column, x: Column) -> Column:
            return F.struct(
                F.concat(acc["out"], F.array(acc["s"])).alias("out"), (acc["s"] + x).alias("s")
            )

        return F.aggregate(values, start, add)["out"]

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    count = F.size(lengths)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((count - 1) / block).cast("int")),
        lambda b: F.slice(lengths, b * block + 1, block),
    )
    offsets = before(F.transform(blocks, total))
    return F.flatten(
        F.zip_with(blocks, offsets, lambda b, o: F.transform(before(b), lambda v: v + o))
    )


def located(df: DataFrame, name: str, pattern: str, found: Column | None = None) -> DataFrame:
    """Add ``name``: start (code points) and text of all leftmost matches, in order."""
    found = F.col("text").rlike(pattern) if found is None else found
    none = F.array().cast("array<string>")
    df = compute_once(df, {"hit": found})
    df = compute_once(
        df,
        {
            "m": F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none),
            "gaps": F.when(F.col("hit"), F.split("text", pattern, -1)).otherwise(none),
        },
    )
    # There is a gap before each match and one after the last.
    both = F.zip_with("gaps", "m", lambda g, m: F.length(g).cast("long") + F.coalesce(F.length(m), F.lit(0)))
    df = compute_once(df, {"lengths": both})
    df = compute_once(df, {"starts": F.when(F.col("hit"), running_totals(F.col("lengths")))})
    place = F.zip_with(
        F.zip_with("starts", "gaps", lambda s, g: s + F.length(g)),
        "m",
        lambda s, m: F.struct(s.alias("start"), m.alias("match")),
    )
    kept = F.filter(place, lambda x: x["match"].isNotNull())
    empty = F.array().cast("array<struct<start:bigint,match:string>>")
    return compute_once(df, {name: F.when(F.col("hit"), kept).otherwise(empty)}).drop(
        "hit", "m", "gaps", "lengths", "starts"
    )


def window_span(candidate: Column, rule: CharacterClass) -> Column:
    """First start and last end of the windows with enough entropy, or nulls.

    The window slides by one character at a time: the count of the character that
    enters goes up by one, that of the character that leaves goes down by one, and
    the sum of c*log2(c) changes by those two terms alone.
    """
    own = Entropy(rule)
    terms = F.array(*[F.lit(t).cast("long") for t in own.terms])
    w, size = rule.window, len(rule.alphabet)
    # instr() counts from 1; 0 stands for no character leaving.
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(rule.alphabet), c))
    leaving = F.concat(F.array_repeat(F.lit(0), w), codes)
    steps = F.filter(
        F.arrays_zip(codes.alias("a"), leaving.alias("b")), lambda s: s["a"].isNotNull()
    )
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("n"),
        F.lit(0).cast("long").alias("s"),
        F.lit(0).cast("int").alias("i"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def term(n: Column) -> Column:
        return F.element_at(terms, n + 1)

    def slide(acc: Column, x: Column) -> Column:
        # The leaving character goes first, so no count exceeds the window.
        out = F.when(x["b"] > 0, F.element_at(acc["n"], F.greatest(x["b"], F.lit(1)))).otherwise(0)
        less = F.when(x["b"] > 0, term(out - 1) - term(out)).otherwise(F.lit(0).cast("long"))
        held = F.element_at(acc["n"], x["a"]) - F.when(x["a"] == x["b"], 1).otherwise(0)
        s = acc["s"] + less + term(held + 1) - term(held)
        n = F.transform(
            acc["n"],
            lambda v, k: v
            + F.when(k + 1 == x["a"], 1).otherwise(0)
            - F.when(k + 1 == x["b"], 1).otherwise(0),
        )
        end = acc["i"] + 1
        good = (end >= w) & (s <= own.limit)
        return F.struct(
            n.alias("n"),
            s.alias("s"),
            end.alias("i"),
            F.when(good, F.coalesce(acc["first"], end - w)).otherwise(acc["first"]).alias("first"),
            F.when(good, end).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        steps, start, slide, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"))
    )


def span(kind: str, rank: int, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("long").alias("start"),
        F.lit(rank).alias("rank"),
        end.cast("long").alias("end"),
        F.lit(kind).alias("kind"),
    )


def whole(name: str, kind: str, rank: int) -> Column:
    return F.transform(name, lambda x: span(kind, rank, x["start"], x["start"] + F.length(x["match"])))


def entropy_spans(windows: Column, kind: str, rank: int) -> Column:
    hits = F.filter(windows, lambda x: x["w"]["first"].isNotNull())
    return F.transform(
        hits, lambda x: span(kind, rank, x["at"] + x["w"]["first"], x["at"] + x["w"]["last"])
    )


def secret_scan(
    docs: DataFrame,
    classes: tuple[CharacterClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """Add ``base_spans`` and ``spans``: arrays of (start, rank, end, kind), by start and rank.

    Base kinds are ``assign`` (a name, a sign and a value of 12 characters or more;
    leftmost matches first, short values dropped afterwards), ``access`` and ``hex``.
    Runs of each class in ``classes`` that ``allowed`` does not suppress are searched
    with a sliding window; a hit spans from its first to its last window of enough
    entropy. Base spans are never suppressed. Offsets are code points, ends exclusive.

    One pass over the rows without a shuffle: a text is scanned where it was read, in
    time that grows with its length. A null text is an empty one and has no spans; an empty
    table gives an empty one; repeated rows each give a row. Spans that begin together are
    ordered by kind, and one run of characters may be a span of several kinds.
    """
    df = keyed(docs)
    df = located(df, "assign", ASSIGN)
    df = located(df, "access", ACCESS, F.col("text").contains("AKIA"))
    df = located(df, "hex", HEX)
    df = compute_once(
        df,
        {
            "assign": F.filter(
                "assign",
                lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_VALUE_CHARS,
            )
        },
    )
    for rule in classes:
        df = located(df, rule.kind, rule.pattern)
        doubtful = F.filter(
            rule.kind,
            lambda x: x["match"].rlike(rule.needs)
            & ~F.array_max(F.array(*[x["match"].rlike(a) for a in allowed])),
        )
        windows = F.transform(
            doubtful, lambda x: F.struct(x["start"].alias("at"), window_span(x["match"], rule).alias("w"))
        )
        df = compute_once(df, {rule.kind: F.when(F.size(rule.kind) > 0, windows)})
    base = F.concat(whole("assign", "assign", 0), whole("access", "access", 1), whole("hex", "hex", 2))
    more = [
        entropy_spans(F.coalesce(F.col(r.kind), F.array().cast(df.schema[r.kind].dataType)), r.kind, i)
        for i, r in enumerate(classes, 3)
    ]
    df = compute_once(df, {"base_spans": F.sort_array(base)})
    df = compute_once(df, {"spans": F.sort_array(F.concat("base_spans", *more))})
    return with_columns(df, docs, {"base_spans": F.col("base_spans"), "spans": F.col("spans")})


def joined(spans: str) -> Column:
    """``kind:start:end`` of all spans, separated by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def sql_twin(
    classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> str:
    """The same result as SQL over ``documents``, each window counted anew.

    That engine folds case beyond ASCII, so names are spelled in both cases, and knows no
    groups that give nothing back, nor needs them.
    """
    names = ["password", "passwd", "secret", "token", "apikey"]
    spelled = ["".join(f"[{c}{c.upper()}]" for c in n) for n in names]
    spelled[-1] = spelled[-1].replace("[kK]", "_?[kK]", 1)
    value = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [("assign", f"(?:{'|'.join(spelled)}){value}"), ("access", ACCESS), ("hex", HEX)]
    patterns += [(c.kind, c.pattern) for c in classes]

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS rank, {quoted(kind)} AS kind, regexp_extract_all(text, {quoted(p)}) AS found, "
        f"string_split_regex(text, {quoted(p)}) AS gaps FROM texts"
        for rank, (kind, p) in enumerate(patterns)
    )
    plain = [a.replace("++", "+").replace("*+", "*") for a in allowed]
    barred = " OR ".join(f"regexp_matches(f, {quoted(a)})" for a in plain)
    windows = []
    for rank, rule in enumerate(classes, 3):
        own, w = Entropy(rule), rule.window
        needed = f"regexp_matches(f, {quoted(rule.needs)})"
        total = (
            f"list_sum(list_transform(list_distinct(chars[i + 1:i + {w}]), lambda ch: "
            f"{own.terms}[len(list_filter(chars[i + 1:i + {w}], lambda x: x = ch)) + 1]))"
        )
        windows.append(
            f"SELECT doc_id, rank, kind, start + min(i) AS start, start + max(i) + {w} AS stop FROM ("
            f"SELECT *, unnest(range(0, len(chars) - {w} + 1)) AS i FROM ("
            f"SELECT *, string_split(f, '') AS chars FROM placed WHERE rank = {rank} AND {needed} AND NOT ({barred})))"
            f" WHERE {total} <= {own.limit} GROUP BY doc_id, rank, kind, start"
        )
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), runs AS ({found}),
each AS (SELECT doc_id, rank, kind, gaps, found, unnest(found) AS f, generate_subscripts(found, 1) AS i
         FROM runs WHERE len(found) > 0),
placed AS (SELECT doc_id, rank, kind, f, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM each),
base AS (SELECT doc_id, rank, kind, start, start + length(f) AS stop FROM placed WHERE rank IN (1, 2) OR
  (rank = 0 AND length(regexp_extract(f, {quoted(patterns[0][1])}, 1)) >= {ASSIGN_VALUE_CHARS})),
spans AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(windows)}),
b AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1,
             count(*) FILTER (rank = 2) AS n2, {joined} AS s FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {joined} AS s FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id"""
