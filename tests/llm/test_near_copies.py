"""Near copies against the similarity of all pairs, and what the pipeline leaves."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as P
from voxboard.llm import near_copies as N
from voxboard.llm.common import documents
from voxboard.llm.simhash import keep_one


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def groups(rows):
    """Sets of row numbers joined by similar pairs."""
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(sets[i], sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = defaultdict(set)
    for i, x in enumerate(label):
        out[x].add(i)
    return list(out.values())


def made_rows():
    rnd = random.Random(7)
    words = [f"W{i}é" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one\x0bTwo"), (5, "a b c d e")]
    for size, edits in [(100, 1), (100, 2), (200, 1), (200, 4), (1000, 18), (1000, 60), (60, 3)] * 4:
        base = rnd.choices(words, k=size)
        for k in range(3):
            copy = list(base)
            for place in rnd.sample(range(size), edits * bool(k)):
                copy[place] = rnd.choice(words)
            rows.append((len(rows) + 1, " ".join(copy)))
    return [*rows, rows[-1], (None, rows[-1][1]), (None, "no id " * 9), (None, "no id " * 9)]


def test_against_all_pairs(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for group in groups(rows):
        ids = [rows[i] for i in group if rows[i][0] is not None]
        want.append(min(ids, key=lambda r: r[0]) if ids else rows[min(group)])
    got = [tuple(r) for r in N.without_near_copies(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # Four bits of four-word fingerprints leave many of these.
    assert keep_one(docs).count() > len(got) + 10


def test_pairs_that_the_first_members_miss():
    """A bucket whose centre is like nobody, and two pairs beside it that only meet each other."""
    from tests.conftest import SPARK as spark

    a, b = list(range(100)), list(range(1000, 1100))
    sets = {0: list(range(5000, 5100)), 1: a, 2: [*a[5:], 7], 3: b, 4: [*b[5:], 8], 9: list(range(6000, 6100))}
    rows = [(1, k, len(v)) for k, v in sets.items()]
    buckets = spark.createDataFrame(rows, "key long, cls long, size long")
    found = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>")
    assert {tuple(r) for r in N.similar_classes(buckets, found, 80).collect()} == {(2, 1), (4, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_prefix_pairs_lose_nothing(spark, seed):
    """Copies of one template with many own shingles, in random groups: all that are alike are found."""
    rnd = random.Random(seed)
    sets, roots = {}, {}
    for k in range(120):
        size = rnd.choice([1, 4, 5, 9, 60, 100])
        base = [rnd.randrange(8) * 10_000 + i for i in range(size)] if k % 3 else list(range(size))
        for i in rnd.sample(range(size), rnd.randint(0, size // 8)):
            base[i] = 1_000_000 * (k + 1) + i
        sets[k] = sorted(set(base))
        roots[k] = rnd.choice([0, 0, 0, k])
    members = spark.createDataFrame([(k, len(v), roots[k]) for k, v in sets.items()], "cls long, size long, root long")
    frame = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>")
    found = {tuple(r) for r in N.prefix_pairs(members, frame, 80).collect()}
    want = {
        (a, b) for a in sets for b in sets
        if a < b and roots[a] != roots[b] and similar(set(sets[a]), set(sets[b]))
    }
    assert len(want) > 20 and want <= found
    every = sum(roots[a] != roots[b] for a in sets for b in sets if a < b)
    assert len(found) < every / 3 and all(roots[a] != roots[b] for a, b in found)


def test_a_template_does_not_cost_the_square(spark):
    """Unlike copies of one template: all pairs are candidates of the bands, hardly any of the prefixes."""
    rnd = random.Random(3)
    template = list(range(150))
    sets = {}
    for k in range(400):
        own = list(template)
        for i in rnd.sample(range(150), 25):
            own[i] = 1_000_000 * (k + 1) + i
        sets[k] = own
    members = spark.createDataFrame([(k, 150, k) for k in sets], "cls long, size long, root long")
    frame = spark.createDataFrame(list(sets.items()), "cls long, shingles array<long>")
    assert N.prefix_pairs(members, frame, 80).count() == 0


def test_pipeline_leaves_none(spark):
    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    kept = {r.doc_id: shingles(r.text) for r in P.one_of_each_group(spark, docs, sf).collect()}
    before = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids = sorted(kept)
    assert not [1 for i, a in enumerate(ids) for b in ids[i + 1 :] if similar(kept[a], kept[b])]
    # Whatever went is like something that stays, or joined to it.
    assert set(kept) < set(before) and len(before) - len(kept) > 50


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert N.without_near_copies(docs).count() == 0


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    from voxboard.llm.common import scratch, stage

    def there(df):
        return Path(df.inputFiles()[0].removeprefix("file:")).exists()

    kept = stage(spark.range(3), "kept")
    with scratch(spark):
        outer = stage(spark.range(3), "outer")
        with scratch(spark):
            inner = stage(spark.range(3), "inner")
            path = Path(inner.inputFiles()[0].removeprefix("file:"))
            assert path.exists()
        assert not path.exists() and there(outer)
        path = Path(outer.inputFiles()[0].removeprefix("file:"))
    assert not path.exists() and there(kept)
