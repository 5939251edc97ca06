"""Joins of review tables with per-group tables."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, where null matches null.

    A product, week or theme that is missing is a group like any other. The keys
    come first, then the other columns of both sides.
    """
    names = list(on)
    marks = [f"__on_{i}" for i in range(len(names))]
    rest = [c for c in right.columns if c not in names]
    marked = right.select(
        *[F.col(f"`{c}`").alias(m) for c, m in zip(names, marks)], *[F.col(f"`{c}`") for c in rest]
    )
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(m)) for c, m in zip(names, marks)])
    joined = left.join(marked, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    own = [c for c in left.columns if c not in names]
    return joined.select(*[F.col(f"`{c}`") for c in [*names, *own, *rest]])


BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000


def measured_small(df: DataFrame, max_bytes: int, max_rows: int) -> bool:
    """Count the rows and the characters of a kept table; one row comes back."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    size = df.agg(F.count("*").alias("rows"), F.sum(F.length(text)).alias("chars")).first()
    return size.rows <= max_rows and (size.chars or 0) * 4 <= max_bytes


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a table that has few rows per group.

    Spark cannot tell beforehand how few rows an aggregate leaves and would
    shuffle the reviews, texts and all, by a possibly hot key. The small side is
    computed and measured first: within the bounds it is broadcast and the
    reviews stay where they are; beyond them it is an ordinary join, whose hot
    keys adaptive execution splits.
    """
    kept = small.persist(StorageLevel.MEMORY_AND_DISK)
    if measured_small(kept, max_bytes, max_rows):
        return join_on(big, F.broadcast(kept), on, how)
    return join_on(big, kept, on, how)
