"""Committed tables: replays, half-written batches, earlier states, two writers, folders put together."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from voxboard.sources import artifacts, manifest
from voxboard.sources.manifest import CommittedTable
from voxboard.streaming.late import late_table, routed

SCHEMA = T.StructType([T.StructField("k", T.LongType())])


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], SCHEMA)


def values(df):
    return sorted(r.k for r in df.collect())


def test_batches_are_added_once(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert table.read().count() == 0 and table.versions() == []
    assert table.commit(rows(spark, 1, 2), "a", 0) and table.commit(rows(spark, 3), "b", 5)
    assert not table.commit(rows(spark, 1, 2), "a", 0) and not table.commit(rows(spark, 9), "b", 4)
    assert table.commit(rows(spark, 4), "a", 1, {"note": "x"})
    assert values(table.read()) == [1, 2, 3, 4] and values(table.read(0)) == [1, 2]
    again = CommittedTable(spark, str(tmp_path / "t"), SCHEMA).manifest()
    assert again.version == 2 and again.batches == {"a": 1, "b": 5} and again.notes == {"note": "x"}


def test_a_half_written_batch_is_not_seen(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.commit(rows(spark, 1), "a", 0)
    rows(spark, 7).write.parquet(str(tmp_path / "t/data/a-1-lost"))
    assert values(table.read()) == [1]
    table.commit(rows(spark, 2), "a", 1)
    assert values(table.read()) == [1, 2]
    assert table.remove_unused() == ["data/a-1-lost"] and values(table.read()) == [1, 2]


def test_two_writers_cannot_make_one_version(spark, tmp_path):
    one, two = (CommittedTable(spark, str(tmp_path / "t"), SCHEMA) for _ in range(2))
    seen = two.manifest()
    one.commit(rows(spark, 1), "a", 0)
    two.manifest = lambda version=None: seen
    with pytest.raises(RuntimeError):
        two.commit(rows(spark, 2), "b", 0)
    assert values(one.read()) == [1] and len(one.versions()) == 1


def test_many_folders_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MAX_PARTS", 3)
    table = CommittedTable(spark, str(tmp_path / "t"), SCHEMA)
    for k in range(6):
        table.commit(rows(spark, k), "a", k)
    assert len(table.manifest().parts) == 3 and values(table.read()) == [0, 1, 2, 3, 4, 5]
    assert values(table.read(2)) == [0, 1, 2]


def test_snapshots(spark, tmp_path):
    path, folder = str(tmp_path / "ledger"), str(tmp_path / "snapshots")
    run = spark.createDataFrame([("p", "2024-W01", 3)], "product_id string, week_key string, review_count long")
    assert artifacts.append_run(run, path)
    first = artifacts.write_snapshot(spark, path, folder)
    artifacts.append_run(run.replace(3, 4), path)
    artifacts.write_snapshot(spark, path, folder)
    (tmp_path / "snapshots/version=000000000009").mkdir()  # begun and not ended
    assert sorted(r.review_count for r in artifacts.read_snapshot(spark, folder).collect()) == [3, 4]
    assert [r.review_count for r in artifacts.read_snapshot(spark, folder, first).collect()] == [3]


def test_late_rows(spark, tmp_path):
    def batch(*days):
        return spark.createDataFrame([(d,) for d in days], "date date")

    day = dt.date
    table = late_table(spark, str(tmp_path / "late"), batch(day(2024, 1, 1)).schema)
    write = routed(table, days=7)
    write(batch(day(2024, 1, 3), day(2023, 1, 1)), 0)
    for _ in range(2):  # the second time it is a replay
        # The week of 2023-12-25 ends on 31 December, after 27 December; the one before does not.
        write(batch(day(2023, 12, 26), day(2023, 12, 24), None, day(2024, 2, 1)), 1)
    write(batch(day(2024, 1, 20), day(2024, 1, 23)), 2)
    got = {(r.date, r.late, r.behind) for r in table.read().collect()}
    assert got == {
        (day(2024, 1, 3), False, None), (day(2023, 1, 1), False, None), (day(2023, 12, 26), False, None),
        (day(2023, 12, 24), True, 3), (None, False, None), (day(2024, 2, 1), False, None),
        (day(2024, 1, 20), True, 4), (day(2024, 1, 23), False, None),
    }
