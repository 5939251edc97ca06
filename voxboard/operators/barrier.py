"""Costly expressions that are computed once, whatever is filtered later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that later filters then read as plain values.

    A filter on a computed column is pushed below the projection with a copy of
    the expression, so every regular expression in it runs once more per filter.
    Values that come out of a generator stay above it. They are not pruned
    either, so this belongs where the columns are needed, or ahead of a staged
    table.
    """
    kept = [c for c in df.columns if c not in columns]
    fields = [c.alias(name) for name, c in columns.items()]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))
