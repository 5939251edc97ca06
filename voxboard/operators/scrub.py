"""Personal data out of review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.functions.privacy import pii_kinds, redact_pii
from voxboard.operators.barrier import compute_once


def scrub(df: DataFrame) -> DataFrame:
    """Redact title and text; drop rows that have no text left. Idempotent."""
    names = [c for c in ("title", "text") if c in df.columns]
    clean = compute_once(df, {c: redact_pii(F.col(c)) for c in names})
    return clean.filter(F.col("text").isNotNull()).select(*df.columns)


def pii_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with personal data left, and its kinds."""
    return compute_once(df, {"kinds": pii_kinds(F.col(text))}).filter(F.size("kinds") > 0)
