"""Raw rows to reviews, with the reason for every row that is rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxboard.functions.dates import parse_review_date
from voxboard.functions.ids import opaque_id
from voxboard.functions.numbers import coerce_rating
from voxboard.functions.text import blank_to_null, is_blank, strip_ws
from voxboard.model import RAW_FIELDS
from voxboard.operators.barrier import compute_once

WRONG_PACKAGE = "wrong_package"
EMPTY_TEXT = "empty_text"
BAD_DATE = "bad_date"
SHORT_TEXT = "short_text"
NON_ENGLISH = "non_english"


def _present(df: DataFrame, names: list[str]) -> list[tuple[Column, T.DataType]]:
    by_name = {c.strip().lower(): c for c in df.columns}
    found = dict.fromkeys(by_name[n.lower()] for n in names if n.lower() in by_name)
    return [(F.col(f"`{c}`"), df.schema[c].dataType) for c in found]


def _filled(c: Column, dtype: T.DataType) -> Column:
    return (c != "") if isinstance(dtype, T.StringType) else c.isNotNull()


def first_present(df: DataFrame, names: list[str]) -> Column:
    """First non-blank value, as text, among synonymous columns."""
    values = [F.when(_filled(c, t), c.cast("string")) for c, t in _present(df, names)]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def first_date(df: DataFrame) -> Column:
    """The parsed first non-blank date column.

    A date that is present but unreadable wins over a readable epoch column
    further down the list, and the row is rejected.
    """
    out = None
    for c, dtype in _present(df, RAW_FIELDS["date"] + RAW_FIELDS["millis"]):
        value = parse_review_date(c, dtype)
        test = _filled(c, dtype)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast("date") if out is None else out


def promote_title(text: Column, title: Column) -> tuple[Column, Column]:
    """A review with a title only has its title as text."""
    blank = is_blank(text)
    return F.when(blank, title).otherwise(text), F.when(blank, F.lit(None)).otherwise(title)


def classify_rows(df: DataFrame, product_id: str | None = None) -> DataFrame:
    """Normalised columns plus ``reason``, null for rows that are usable.

    With ``product_id`` rows of other products are rejected and rows without a
    product pass; without it every row keeps the product it names.
    """
    place = [c for c in ("src_file", "src_pos") if c in df.columns]
    raw = df.select(
        blank_to_null(first_present(df, RAW_FIELDS["package"])).alias("package"),
        first_present(df, RAW_FIELDS["text"]).alias("raw_text"),
        first_present(df, RAW_FIELDS["title"]).alias("raw_title"),
        first_date(df).alias("date"),
        coerce_rating(first_present(df, RAW_FIELDS["rating"])).alias("rating"),
        blank_to_null(first_present(df, RAW_FIELDS["language"])).alias("language"),
        *place,
    )
    text, title = promote_title(F.col("raw_text"), F.col("raw_title"))
    # Values that the reject test and all later filters read.
    rows = compute_once(
        raw.select("package", text.alias("text"), title.alias("raw_title"), "date", "rating", "language", *place),
        {"text": strip_ws(F.col("text")), "date": F.col("date"), "rating": F.col("rating")},
    )
    wrong = (F.col("package") != product_id) if product_id is not None else F.lit(False)
    reason = (
        F.when(F.coalesce(wrong, F.lit(False)), WRONG_PACKAGE)
        .when(F.coalesce(F.col("text"), F.lit("")) == "", EMPTY_TEXT)
        .when(F.col("date").isNull(), BAD_DATE)
    )
    product = F.col("package") if product_id is None else F.lit(product_id)
    return rows.select(
        product.alias("product_id"),
        opaque_id(F.col("date"), F.col("rating"), F.col("text"), F.col("raw_title")).alias("id"),
        F.lit("play").alias("source"),
        "rating",
        blank_to_null(F.col("raw_title")).alias("title"),
        "text",
        "date",
        "language",
        *place,
        reason.alias("reason"),
    )


def normalise(df: DataFrame, product_id: str | None = None) -> DataFrame:
    rows = classify_rows(df, product_id)
    return rows.filter(F.col("reason").isNull()).drop("reason")


def filter_product(df: DataFrame, product_id: str, package: str = "package") -> DataFrame:
    named = blank_to_null(F.col(package))
    return df.filter(named.isNull() | (named == product_id))


def product_presence(df: DataFrame, product_id: str, package: str = "package") -> DataFrame:
    """One row: is any product named at all, and is the wanted one among them."""
    named = blank_to_null(F.col(package))
    named = F.when(named != "None", named)
    return df.agg(
        F.coalesce(F.bool_or(named.isNotNull()), F.lit(False)).alias("any_named"),
        F.coalesce(F.bool_or(named == product_id), F.lit(False)).alias("target_named"),
    )


def require_product(df: DataFrame, product_id: str) -> DataFrame:
    """Refuse an export that names products, none of them the wanted one."""
    named = df.select(first_present(df, RAW_FIELDS["package"]).alias("package"))
    seen = product_presence(named, product_id).first()
    if seen.any_named and not seen.target_named:
        raise ValueError(f"export does not include {product_id}")
    return df


def reject_counts(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per group and reject reason; ``accepted`` for usable rows."""
    return classified.groupBy(
        *keys, F.coalesce(F.col("reason"), F.lit("accepted")).alias("reason")
    ).agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
