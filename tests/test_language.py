"""The trigram detector on held-out documents, and on awkward texts."""

from collections import Counter, defaultdict

import pytest

from voxboard.operators.language import detect_language, fit_profiles, trigrams

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return fit_profiles(docs.filter("doc_id % 5 <> 0")).cache()


def test_held_out_accuracy_of_each_language(spark, profiles):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 = 0").select("doc_id", "text", "lang")
    found = detect_language(docs.select("doc_id", "text"), profiles, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    right, seen = Counter(), Counter()
    for r in found.collect():
        seen[r.lang] += 1
        right[r.lang] += r.lang == r.lang_pred
    assert set(seen) == {"en", "de", "es", "fr"}
    assert all(right[k] >= 0.95 * n for k, n in seen.items()), (right, seen)


def test_trigrams(spark):
    rows = spark.createDataFrame([(1, "Ab, c!"), (2, None), (3, ""), (4, "12 ."), (5, "É")], "id long, text string")
    got = defaultdict(list)
    for r in trigrams(rows, ["id"]).collect():
        got[r.id].append(r.gram)
    assert {k: sorted(v) for k, v in got.items()} == {1: [" ab", " c ", "ab ", "b c"], 5: [" é "]}


def test_awkward_texts(spark, profiles):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "日本語のテキスト"), (5, "the thing and the other with this " * 20_000)]
    got = {r.id: (r.lang_pred, r.share) for r in detect_language(spark.createDataFrame(rows, "id long, text string"), profiles, "id").collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(None, 0.0)] * 4 and got[5][0] == "en"
    empty = spark.createDataFrame([], "id long, text string")
    assert detect_language(empty, profiles, "id").count() == 0
