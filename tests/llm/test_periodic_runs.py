"""Runs against all lags of all places, collapsed texts, awkward documents, long repeats."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from voxboard.llm.common import documents
from voxboard.llm.periodic_runs import collapse, periodic, periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words, min_words=24, min_periods=3):
    """Every lag compared at every place; the smallest lag of each stretch is its period."""
    n, found = len(words), {}
    for p in range(1, n // min_periods + 1):
        i = p
        while i < n:
            first = i
            while i < n and words[i] == words[i - p]:
                i += 1
            length = i - first + p
            if i > first and length >= max(min_words, min_periods * p):
                found.setdefault((first - p, length), p)
            i += 1
    return sorted([(s, n, p) for (s, n), p in found.items()], key=lambda r: (r[0], r[2]))


def dropped(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("seed", range(8))
def test_runs_against_all_lags(seed):
    rnd, seen = random.Random(seed), 0
    for _ in range(150):
        n, kinds = rnd.randint(0, 150), rnd.choice([1, 2, 3, 5, 30])
        words = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 9 else 0):
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 3))
            for i in range(a + p, min(n, a + rnd.randint(p, n))):
                words[i] = words[i - p]
        got = periodic(np.array(words, np.int64))
        assert got == brute(words)
        seen += len(got)
        assert periodic(np.array(words, np.int64), 8, 4) == brute(words, 8, 4)
    assert seen > 20


def test_borders():
    def runs(text):
        return periodic(np.array([ord(c) for c in text], np.int64))

    assert runs("a" * 23) == [] and runs("a" * 24) == [(0, 24, 1)]
    assert runs("x" + "abcdefghi" * 3) == [(1, 27, 9)]
    assert runs("abcdefghi" * 3 + "x") == [(0, 27, 9)]
    assert runs(("abcdefghi" * 3)[:-1]) == []
    # The period of a period counts, not its multiples.
    assert runs("ab" * 30) == [(0, 60, 2)]
    # Two runs that overlap, and one inside another's period.
    inner = "z" * 24 + "abc"
    assert runs(inner * 3) == brute(inner * 3)
    assert len(runs(inner * 3)) == 4


def test_long_texts_cost_little_more_than_their_words():
    begin = time.time()
    for words in (np.zeros(300_000, int), np.tile(np.arange(1000), 300), np.tile([0] * 500 + [1], 600)):
        assert periodic(words)[0][0] == 0
    assert time.time() - begin < 20


def test_awkward_documents(spark):
    rep = "p q r s t u v w x " * 4
    rows = [
        (1, None, 7), (2, "", 7), (3, " \t\x0b\x0c\r\n ", 7), (4, "one", 7), (5, rep, 7), (5, rep, 7),
        (None, "head " + rep + "tail", 7), (6, "é\U0001f600\x1c a\xa0b " * 30, 7), (7, "w " * 100_000, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "runs"]
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.text, [tuple(x) for x in r.runs]))
    assert got[1] == got[2] == got[3] == [("", [])] and got[4] == [("one", [])]
    assert got[5] == [("p q r s t u v w x", [(0, 36, 9)])] * 2
    assert got[None] == [("head p q r s t u v w x tail", [(1, 36, 9)])]
    assert got[6][0][0].split(" ") == ["é\U0001f600\x1c", "a\xa0b"]
    assert got[7] == [("w", [(0, 100_000, 1)])]
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, min_periods=2)


def test_query_against_brute_force(spark):
    from voxboard.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    planted = 0
    for r in QUERIES["op13_periodic_runs"](spark, SF).collect():
        words = (texts[r.doc_id] or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000 and h % 10:
            continue  # too long to compare at every lag
        runs = brute(words) if n <= 3000 else collapse(b" ".join(words), 24, 3)[1]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(dropped(words, runs))).hexdigest()
        planted += bool(runs)
    assert planted > 10
