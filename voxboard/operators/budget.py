"""Rolling request and token budgets over a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Calls and tokens per minute, and the share of them to be used.
REQUESTS_PER_MINUTE = 30
TOKENS_PER_MINUTE = 8000
SAFETY_FACTOR = 0.85
WINDOW_MICROS = 60_000_000


def rolling_budget(
    calls: DataFrame,
    key: str = "provider",
    rpm: int = REQUESTS_PER_MINUTE,
    tpm: int = TOKENS_PER_MINUTE,
    safety: float = SAFETY_FACTOR,
) -> DataFrame:
    """Requests and tokens of the last 60 seconds up to each call.

    A window over a whole provider would put a busy one into a single task. The
    log is cut into minutes instead: every call also goes to the next minute as
    context, so each minute holds all a 60-second look-back can reach.
    """
    copies = calls.select("*", F.unix_micros(F.col("ts").cast("timestamp")).alias("__t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("__ahead"))
    placed = copies.withColumn("__minute", F.floor(F.col("__t") / F.lit(WINDOW_MICROS)) + F.col("__ahead"))
    by = W.partitionBy(key, "__minute").orderBy("__t")
    look_back = by.rangeBetween(-WINDOW_MICROS, 0)
    rolled = placed.select(
        "*",
        F.count("*").over(look_back).alias("requests_60s"),
        F.sum("tokens").over(look_back).alias("tokens_60s"),
    ).filter(F.col("__ahead") == 0)
    return rolled.select(
        *calls.columns,
        "requests_60s",
        "tokens_60s",
        (F.col("requests_60s") > max(1, int(rpm * safety))).alias("over_requests"),
        (F.col("tokens_60s") > int(tpm * safety)).alias("over_tokens"),
    )
