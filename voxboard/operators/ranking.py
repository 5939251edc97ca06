"""Exact ranks that never need a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxboard.operators.joins import join_on

#: Rows that one bucket of ``order_buckets`` is meant to hold.
BUCKET_ROWS = 50_000
#: Buckets at most, values that their bounds are taken from, and bounds looked at together.
MAX_BUCKETS = 4096
SAMPLE_VALUES = 100_000
STRIDE = 64


def top_ranked(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    rank: str = "rn",
) -> DataFrame:
    """First k rows per group, with their rank.

    For a k that Spark takes for small it cuts each group before the shuffle
    (WindowGroupLimit). Where k may be large, rank with ``group_rank``.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_ranked(df, keys, order, 1, "__rn").drop("__rn")


def bucket_offsets(df: DataFrame, keys: list[str], buckets: list[str]) -> DataFrame:
    """Rows in earlier buckets and in the whole group, one row per bucket."""
    counts = df.groupBy(*keys, *buckets).agg(F.count("*").alias("__n"))
    group = W.partitionBy(*keys)
    before = group.orderBy(*buckets).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *keys,
        *buckets,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(group).alias("group_size"),
    )


def group_rank(
    df: DataFrame,
    keys: list[str],
    buckets: dict[str, Column],
    order: list[Column],
    rank: str = "rn",
) -> DataFrame:
    """Rank of every row in its group, and the group size.

    ``buckets`` are coarse leading sort keys: ordering by them and then by
    ``order`` must be the wanted order. Rows are ranked inside their bucket and
    moved up by the size of the buckets before it, so the largest thing one task
    sorts is a bucket, and only one count per bucket is ever brought together.
    """
    names = list(buckets)
    keyed = df.withColumns(buckets)
    offsets = bucket_offsets(keyed, keys, names)
    inside = W.partitionBy(*keys, *names).orderBy(*order)
    return (
        join_on(keyed, offsets, [*keys, *names])
        .withColumn(rank, F.col("__before") + F.row_number().over(inside))
        .drop("__before", *names)
    )


def splitters(df: DataFrame, text: str) -> list[str]:
    """Values that part those of a text column into runs of about ``BUCKET_ROWS``.

    They are quantiles of the values with the smallest hashes, of which ``SAMPLE_VALUES``
    come to the driver at most: for ids of any form, whatever they begin with. Where rows
    are so many that ``MAX_BUCKETS`` do not do, the buckets grow.
    """
    c = F.col(text).cast("string")
    rows = df.agg(F.count(c)).first()[0]
    wanted = min(MAX_BUCKETS, -(-rows // BUCKET_ROWS))
    if wanted <= 1:
        return []
    h = F.pmod(F.xxhash64(c), F.lit(1 << 31))
    near = df.select(c.alias("v"), h.alias("h")).filter(F.col("h") < F.lit((1 << 31) * 1.2 * SAMPLE_VALUES / rows))
    found = sorted(r["v"] for r in near.orderBy("h", "v").limit(SAMPLE_VALUES).collect() if r["v"] is not None)
    return sorted({found[len(found) * k // wanted] for k in range(1, wanted)})


def order_buckets(df: DataFrame, text: str) -> Column:
    """Number of the bucket of a value, in the order of the values; null comes first.

    Two levels, as a value is held against one splitter in sixty-four and then against
    the ones between two of those.
    """
    c, cuts = F.col(text).cast("string"), splitters(df, text)
    if not cuts:
        return F.lit(0)

    def below(values: list[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v <= c))

    groups = [cuts[i : i + STRIDE] for i in range(0, len(cuts), STRIDE)]
    if len(groups) == 1:
        return F.coalesce(below(cuts), F.lit(0))
    which = below([g[0] for g in groups])
    listed = F.array(*[F.array(*[F.lit(v) for v in g]) for g in groups])
    own = F.size(F.filter(F.get(listed, F.greatest(which, F.lit(1)) - 1), lambda v: v <= c))
    return F.coalesce(F.when(which == 0, 0).otherwise((which - 1) * STRIDE + own), F.lit(0))
