"""Exact ranks over ordered buckets, for ids of any form."""

import hashlib

import pytest

from voxboard.operators import ranking

FORMS = {
    "hex": lambda i: hashlib.md5(str(i).encode()).hexdigest(),
    "padded": lambda i: f"user-{i:012d}",
    "two families": lambda i: f"{'a' * 30}{i:06d}" if i % 2 else f"user-0000{i:06d}",
    "plain numbers": lambda i: str(i * 7919),
}


@pytest.mark.parametrize("form", FORMS)
def test_buckets_are_even_and_ordered(spark, monkeypatch, form):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    monkeypatch.setattr(ranking, "STRIDE", 8)
    ids = [FORMS[form](i) for i in range(8000)]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    rows = [(r.id, r.b) for r in df.withColumn("b", ranking.order_buckets(df, "id")).collect()]
    assert [b for _, b in sorted(rows)] == sorted(b for _, b in rows)
    sizes = {}
    for _, b in rows:
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) <= 2 * len(rows) / len(sizes) and len(sizes) > 60


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 5)
    rows = [("g", f"x{i % 40:03d}", i) for i in range(80)] + [("h", None, 0), ("h", "a", 1), (None, "a", 2)]
    df = spark.createDataFrame(rows, "k string, id string, n int")
    from pyspark.sql import functions as F

    got = ranking.group_rank(df, ["k"], {"b": ranking.order_buckets(df, "id")}, [F.col("id"), F.col("n")])
    found = {(r.k, r.id, r.n): (r.rn, r.group_size) for r in got.collect()}
    for key in ("g", "h", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        assert [found[r] for r in own] == [(i + 1, len(own)) for i in range(len(own))]


def test_one_value_everywhere(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 5)
    df = spark.createDataFrame([("same",)] * 50, "id string")
    assert {r.b for r in df.select(ranking.order_buckets(df, "id").alias("b")).collect()} == {1}
    assert ranking.splitters(df.limit(0), "id") == []
