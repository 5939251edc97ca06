"""SimHash groups against a plain computation over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voxboard.llm import simhash as S
from voxboard.llm.common import documents


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """Smallest id reachable, by flooding over all pairs."""
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and (fps[i] ^ fps[j]).bit_count() <= 4:
                    label[i] = label[j]
                    changed = True
    ids = {}
    for (doc, _), part in zip(rows, label):
        if doc is not None:
            ids[part] = min(ids.get(part, doc), doc)
    return [(doc, f"{fp:016x}", ids.get(part)) for (doc, _), fp, part in zip(rows, fps, label)]


def made_rows():
    rnd = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one\x0btwo"), (6, "a b c d"), (7, "a b É é")]
    n = 10
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([30, 120, 600, 3000]))
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [rows[-1], (None, rows[-1][1]), (None, "only null " * 9), (None, "only null " * 9)]
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = made_rows()
    data = [(d, t, "x", 1) for d, t in rows]
    return rows, spark.createDataFrame(data, "doc_id long, text string, fp string, root int").repartition(3)


def test_groups(made):
    rows, df = made
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(df).collect()]
    want = groups(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({w[2] for w in want}) < len({w[1] for w in want})


def test_keep_one(made):
    rows, df = made
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    want = {g[2] for g in groups(rows)}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    from voxboard.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = [tuple(r) for r in QUERIES["op10_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted(groups(rows))


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=12), st.data())
@settings(max_examples=60, deadline=None)
def test_links_join_what_is_near(base, data):
    fps = set(base)
    for f in base:
        for _ in range(3):
            flips = data.draw(st.lists(st.integers(0, 63), max_size=6))
            for b in flips:
                f ^= 1 << b
            fps.add(f)
    fps = np.array(sorted(fps), np.uint64)
    pairs = S.links(np.zeros(len(fps), np.int64), fps, S.reference_fingerprints(8), 4)
    label = {int(f): int(f) for f in fps}

    def flood(edges):
        out = dict(label)
        for _ in fps:
            for a, b in edges:
                out[a] = out[b] = min(out[a], out[b])
        return out

    near = [(int(a), int(b)) for a in fps for b in fps if a < b and (int(a) ^ int(b)).bit_count() <= 4]
    assert flood([(int(a), int(b)) for a, b in pairs]) == flood(near)
    assert all((int(a) ^ int(b)).bit_count() <= 64 for a, b in pairs)


def test_empty(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain(spark):
    """Components that only hang together by a chain of links."""
    from voxboard.llm.graph import components

    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(tuple(r) for r in components(edges).collect())
    assert got == {**{i: 0 for i in range(1, n + 1)}, 1001: 1000}
