"""Text expressions. Whole texts in, no Python in the hot path.

``WORD`` and ``SPACE`` spell out what a word character and a blank are, because
Java's ``\\w``, ``\\s`` and ``\\b`` follow the JDK version and flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxboard.model import MAX_QUOTE_WORDS

WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = rf"(?<!{WORD})"
NOT_WORD_AFTER = rf"(?!{WORD})"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
# The same set for trim functions, which take characters and no pattern.
SPACE_CHARS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ELLIPSIS = "…"

# Token, quote-mark, document-address and romanised-Hindi patterns.
ASCII_TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z]+)?"
OPEN_QUOTES = "\"'“‘"
CLOSE_QUOTES = "\"'”’"
DOCUMENT_ID = r"(?:docs\.google\.com/document/d/|/d/)([a-zA-Z0-9_-]+)"
ROMANISED_HINDI = (
    r"hai|hain|nahi|nahin|kya|kyun|ke|ki|ka|ko|se|me|mein|aur|ore|"
    r"bahut|bhot|app\s+bhot|karne|karte|gaya|gaya|tha|thi|ho\s+gya|"
    r"please\s+fix|mat\s+download"
)


def whole_words(alternatives: str) -> str:
    """Case-insensitive pattern matching any alternative as whole words.

    A look at the first letter turns most positions away before the costlier
    look behind; every piece between bars counts, so the set is never too small.
    """
    firsts = {piece[:1].lower() for piece in alternatives.split("|")}
    ahead = f"(?=[{''.join(sorted(firsts))}])" if all(f.isalpha() for f in firsts) else ""
    return rf"(?iU){ahead}{NOT_WORD_BEFORE}(?:{alternatives}){NOT_WORD_AFTER}"


def strip_ws(c: Column) -> Column:
    """Strip every kind of white space from both ends; plain ``trim`` strips blanks only."""
    return F.trim(c, F.lit(SPACE_CHARS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip_ws(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return blank_to_null(c).isNull()


def word_count(c: Column) -> Column:
    """Runs of word characters, any script."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD + "++")), F.lit(0))


def count_words(c: Column) -> Column:
    """ASCII tokens, a contraction counting once."""
    return F.coalesce(F.regexp_count(c, F.lit(ASCII_TOKEN)), F.lit(0))


def english_signal(c: Column) -> Column:
    """Share of Latin letters minus 0.08 per romanised-Hindi token, floor 0."""
    # Counting what is left is far cheaper than gathering single characters.
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))
    # U+0130 and U+212A lower-case into a-z and therefore count as Latin.
    others = F.length(F.regexp_replace(c, r"[\P{L}A-Za-z\u0130\u212a]+", ""))
    hits = F.regexp_count(c, F.lit(whole_words(ROMANISED_HINDI)))
    share = F.try_divide(letters - others, letters)
    return F.greatest(F.lit(0.0), share - F.lit(0.08) * hits)


def truncate_words(c: Column, max_words: int = MAX_QUOTE_WORDS) -> Column:
    """First words joined by single blanks plus an ellipsis; short text unchanged.

    Both patterns stop after ``max_words``, however long the text.
    """
    longer = c.rlike(rf"^{SPACE}*+(?:{NOT_SPACE}++{SPACE}++){{{max_words}}}{NOT_SPACE}")
    head = F.regexp_extract(
        c, rf"^{SPACE}*+((?:{NOT_SPACE}++{SPACE}++){{{max_words - 1}}}{NOT_SPACE}++)", 1
    )
    joined = F.regexp_replace(F.regexp_replace(head, SPACE + "+", " "), r"[,.;:]+$", "")
    return F.when(longer, F.concat(joined, F.lit(ELLIPSIS))).otherwise(strip_ws(c))


def unwrap_quotes(c: Column) -> Column:
    """Strip, then drop one pair of wrapping quote marks if both ends have one."""
    s = strip_ws(c)
    wrapped = (
        (F.length(s) >= 2)
        & F.substring(s, 1, 1).isin(list(OPEN_QUOTES))
        & F.substring(s, -1, 1).isin(list(CLOSE_QUOTES))
    )
    return F.when(wrapped, strip_ws(F.substr(s, F.lit(2), F.length(s) - 2))).otherwise(s)


def normalise_needle(c: Column) -> Column:
    """The part of a quote that has to occur in a review, word for word."""
    return strip_ws(F.regexp_replace(unwrap_quotes(c), rf"(?:…|\.\.\.){SPACE}*$", ""))


def collapse_ws(c: Column) -> Column:
    """White space runs as single blanks, for whitespace-tolerant matching."""
    return F.regexp_replace(strip_ws(c), SPACE + "+", " ")


def lines_of(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def slug(c: Column, fallback: str = "report") -> Column:
    base = F.regexp_replace(
        F.regexp_replace(F.lower(strip_ws(c)), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""
    )
    return F.substring(F.coalesce(F.nullif(base, F.lit("")), F.lit(fallback)), 1, 80)


def document_id(c: Column) -> Column:
    """Document id out of a document address, or the value itself."""
    raw = F.coalesce(strip_ws(c), F.lit(""))
    found = F.regexp_extract(raw, DOCUMENT_ID, 1)
    return F.coalesce(F.nullif(found, F.lit("")), raw)


def shorten_id(c: Column) -> Column:
    return (
        F.when(c.isNull() | (c == ""), "—")
        .when(F.length(c) <= 14, c)
        .otherwise(F.concat(F.substring(c, 1, 12), F.lit(ELLIPSIS)))
    )


def snippet_id(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 12), F.lit(ELLIPSIS))


def section_text(title: Column, body: Column, fallback: str = "Weekly Review") -> Column:
    """Heading, blank line, body: what is appended to a running document."""
    heading = strip_ws(F.when(F.coalesce(title, F.lit("")) == "", F.lit(fallback)).otherwise(title))
    return F.concat(heading, F.lit("\n\n"), F.coalesce(strip_ws(body), F.lit("")), F.lit("\n"))
