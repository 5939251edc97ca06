"""Packing against a search of all bins, and what every packing must hold."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxboard.llm.common import documents
from voxboard.llm.packing import Bins, pack


@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 4)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tightest_compatible_bin(items):
    bins, plain = Bins(20), []
    for size, source, cluster in items:
        got = bins.place(size, 1 << source, 1 << cluster)
        fits = [
            (b[0], i) for i, b in enumerate(plain) if b[0] >= size and source not in b[1] and cluster not in b[2]
        ]
        if fits:
            want = min(fits)[1]
        else:
            want = len(plain)
            plain.append([20, set(), set()])
        plain[want][0] -= size
        plain[want][1].add(source)
        plain[want][2].add(cluster)
        assert got == want
        assert bins.residual == [b[0] for b in plain]


def check(rows, sizes, groups, capacity):
    """Pieces cover their documents, bins hold no more than they may and no conflict."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        key = (r.doc_id, r.text_hash, r.copy)
        pieces[key].append((r.start, r.length, r.piece))
        bins[r.bin].append((r.length, key))
    left = sorted(str((k[0], sum(p[1] for p in v))) for k, v in pieces.items())
    assert left == sorted(str(s) for s in sizes)
    for v in pieces.values():
        v.sort()
        assert [p[2] for p in v] == list(range(len(v)))
        assert all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:])) and v[0][0] == 0
    for v in bins.values():
        assert sum(n for n, _ in v) <= capacity
        for group in groups:
            found = [g for _, k in v if (g := group(k)) is not None]
            assert len(found) == len(set(found))
    return bins


def test_documents(spark):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in documents(spark, sf).collect()}
    sizes = [(d, len(r.text.encode().split()) + 1) for d, r in docs.items()]
    source = lambda k: docs[k[0]].source
    words = lambda k: docs[k[0]].text.lower().split() and tuple(docs[k[0]].text.lower().split())
    bins = check(QUERIES["op8_packing"](spark, sf).collect(), sizes, [source, words], 2048)
    fill = sum(n for _, n in sizes) / len(bins) / 2048
    assert fill > 0.9


@pytest.mark.parametrize("unit", [20, 4096])
def test_odd_rows(spark, unit):
    rnd = random.Random(4)
    rows = [((1 << 60) + 1, "large", None, 1), (1, None, "a", 1), (2, "", None, 2), (3, "w " * 99, "a", 3), (4, "w " * 100, "a", 4), (5, "w " * 1000, "b", 5)]
    rows += [(7, "same copy here", "hot", 6)] * 60 + [(None, "no id", "hot", 6)] * 5
    rows += [(100 + i, "x " * rnd.randrange(250), rnd.choice("abc"), i) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    sizes = [(d, len((t or "").split()) + 1) for d, t, _, _ in rows]
    by_id = {d: (s, (t or "").split()) for d, t, s, _ in rows}
    groups = [lambda k: by_id[k[0]][0], lambda k: tuple(by_id[k[0]][1]) or None]
    out = pack(df, capacity=100, unit_documents=unit)
    check(out.collect(), sizes, groups, 100)
    assert out.columns == ["doc_id", "text_hash", "copy", "piece", "start", "length", "bin"]
    # With columns of the caller, and without conflicts.
    own = pack(df.selectExpr("*", "bin * 10 n", "bin dup"), capacity=100, size="n", source=None, cluster="dup")
    check(own.collect(), [(d, 10 * b) for d, _, _, b in rows if b > 0], [], 100)
    assert pack(df.limit(0)).count() == 0
