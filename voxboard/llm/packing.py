"""Pack documents into windows of a fixed length, apart from what must not meet."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxboard.llm.common import keyed, lowered, stage, word_list
from voxboard.operators.barrier import compute_once

CAPACITY = 2048
#: Documents that are packed together. More make fuller bins and longer tasks.
UNIT_DOCUMENTS = 4096
FIELDS = "id string, body long, copy long, piece long, start long, length long, bin long"


class Bins:
    """Open bins by residual, each with bitmaps of the sources and clusters in it.

    ``lists[r]`` holds the numbers of the bins with ``r`` left, in order, and bit
    ``r`` of ``occupied`` says whether there are any. The successor of a size is the
    lowest set bit from there on.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.lists: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.occupied = 0
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def successors(self, size: int):
        """Residuals of at least ``size`` that some bin has, the tightest first."""
        rest = self.occupied >> size
        at = size
        while rest:
            step = (rest & -rest).bit_length()
            at += step
            yield at - 1
            rest >>= step

    def place(self, size: int, source: int, cluster: int) -> int:
        """Number of the tightest bin without the source or cluster, or of a new one."""
        for left in self.successors(size):
            for number in self.lists[left]:
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    own = self.lists[left]
                    own.pop(bisect_left(own, number))
                    if not own:
                        self.occupied ^= 1 << left
                    break
            else:
                continue
            break
        else:
            number, left = len(self.residual), self.capacity
            self.residual.append(left)
            self.sources.append(0)
            self.clusters.append(0)
        left -= size
        self.residual[number] = left
        self.sources[number] |= source
        self.clusters[number] |= cluster
        insort(self.lists[left], number)
        self.occupied |= 1 << left
        return number


def bitmaps(values: pd.Series) -> list[int]:
    """A bit for each value; none for nulls and for values that occur once, which cannot conflict."""
    codes, _ = pd.factorize(values)
    n = np.bincount(codes[codes >= 0], minlength=1)
    codes = np.where((codes >= 0) & (n[codes] > 1), codes, -1)
    numbers: dict[int, int] = {}
    return [0 if c < 0 else 1 << numbers.setdefault(c, len(numbers)) for c in codes.tolist()]


def pack_unit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(left=rows["size"] % capacity, full=rows["size"] // capacity)
        # Longest remainder first; the rest of the order makes runs alike.
        rows = rows.sort_values(["left", "body", "id", "copy"], ascending=[False, True, True, True])
        bins, out, closed = Bins(capacity), [], []
        sources, clusters = bitmaps(rows["source"]), bitmaps(rows["cluster"])
        keys = zip(rows["id"], rows["body"], rows["copy"], rows["left"], rows["full"])
        for (doc, body, copy, left, full), source, cluster in zip(keys, sources, clusters):
            closed += [(doc, body, copy, i, i * capacity, capacity) for i in range(full)]
            if left:
                number = bins.place(int(left), source, cluster)
                out.append((doc, body, copy, full, full * capacity, left, number))
        out += [(*c, len(bins.residual) + i) for i, c in enumerate(closed)]
        made = pd.DataFrame(out, columns=["id", "body", "copy", "piece", "start", "length", "bin"])
        made["bin"] += int(rows["unit"].iloc[0]) << 32
        return made

    return run


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    size: str | None = None,
    source: str | None = "source",
    cluster: str | None = None,
    unit_documents: int = UNIT_DOCUMENTS,
) -> DataFrame:
    """(doc_id, text_hash, copy, piece, start, length, bin), one row per piece of a document.

    A document has ``size`` tokens (a column; by default its words and one end). It is
    cut into pieces of ``capacity`` tokens, each a bin of its own, and a remainder,
    which goes to the tightest bin with room that holds no document of the same
    ``source`` and none of the same duplicate ``cluster`` (columns; by default equal
    words). Longest remainders go first; among bins equally tight the older one wins.
    Nulls conflict with nothing. Without such a bin a new one is opened.

    Documents are dealt by a hash of id, text and copy into units of about
    ``unit_documents``, whatever their source, and each unit has bins of its own, so
    a task holds a bounded number of short rows and no text. Rows that are equal are
    told apart by ``copy``. Sizes below one take no room: such documents have no row.
    """
    base = keyed(docs)
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    words = F.size("words").cast("long")
    base = compute_once(base, {"words": word_list(lowered(F.col("text")))})
    copies = F.when(words > 0, F.xxhash64("words"))
    if cluster:
        given = F.col(f"in_{at[cluster.lower()]}")
        own = F.when(given.isNotNull(), F.xxhash64(given))
    # Ids travel as text: in a task's data frame a null would turn numbers into floats.
    rows = base.select(
        F.col("id").cast("string").alias("id"), "body",
        (F.col(f"in_{at[size.lower()]}").cast("long") if size else words + 1).alias("size"),
        (F.col(f"in_{at[source.lower()]}") if source else F.lit(None)).cast("string").alias("source"),
        (own if cluster else copies).alias("cluster"),
    )
    # Equal rows are counted in the tasks that read them and numbered afterwards.
    counted = rows.filter("size > 0").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    table = stage(counted, "sizes")
    n = table.agg(F.sum("n")).first()[0] or 0
    units = max(1, -(-n // unit_documents))
    each = table.select(
        *rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    ).withColumn("unit", F.pmod(F.xxhash64("id", "body", "copy"), F.lit(units)))
    packed = each.groupBy("unit").applyInPandas(pack_unit(capacity), FIELDS)
    return packed.select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("body").alias("text_hash"),
        *packed.columns[2:],
    )
