"""Each stage of the pipeline against a plain computation on its own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from tests.llm.test_decontaminate import by_pairs
from tests.llm.test_packing import check
from tests.llm.test_near_copies import groups
from voxboard.llm.common import documents

SF = "/root/testdata/sf0.01"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def shared_lines_gone(docs):
    keys, strip = defaultdict(set), " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    for doc, text in docs.items():
        for line in text.split("\n"):
            keys[key(line)].add(doc)
    gone = {k: max(d) for k, d in keys.items() if len(k) >= 40 and len(d) >= 5}
    return {
        doc: "\n".join(x for x in text.split("\n") if gone.get(key(x), doc) == doc) for doc, text in docs.items()
    }


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """What went into each stage and what came out, read back as the next one reads it."""
    docs, out = documents(spark, SF), {}
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns(results):
    for name, (given, made) in list(results.items())[:-1]:
        assert made.dtypes == given.dtypes, name


def test_language(results):
    given, made = map(texts, results["language_id"])
    # All documents are in one of the four languages.
    assert made == {d: t for d, t in given.items() if re.search(r"[^\W\d_]", t)}


def test_lines(results):
    given, made = results["line_dedup"]
    assert texts(made) == shared_lines_gone(texts(given))
    assert all(r.n_chars == len(r.text) for r in made.collect())


def test_near_copies(results):
    given, made = map(texts, results["simhash"])
    rows = sorted(given.items())
    first = {rows[min(g)][0] for g in groups(rows)}
    assert made == {d: given[d] for d in first} and len(made) < len(given)


def test_benchmark(spark, results):
    given, made = map(texts, results["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {hit[0] for hit in by_pairs(list(given.items()), items)}
    assert dirty and made == {d: t for d, t in given.items() if d not in dirty}


def test_packing(results):
    given, made = results["packing"]
    docs = {r.doc_id: r for r in given.collect()}
    sizes = [(d, len(r.text.encode().split()) + 1) for d, r in docs.items()]
    check(made.collect(), sizes, [lambda k: docs[k[0]].source], 2048)


def test_run(spark, results):
    made = results["packing"][1]
    rows = P.run(spark, SF)
    assert rows.columns == made.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, made.collect()))


def test_empty_documents(spark, tmp_path):
    docs = documents(spark, SF).limit(0)
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() == 0
