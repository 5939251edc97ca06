"""Repeated passages against a table of all windows."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from voxboard.llm import repeats as R
from voxboard.llm.common import documents


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def union(starts, n):
    out = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + n
        else:
            out.append([s, s + n])
    return out


def by_windows(rows, n):
    """Spans per row, and which windows are the first of their kind, by dictionaries."""
    places = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    for r in order:
        w = words(rows[r][1])
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((r, i))
    repeated, later = defaultdict(list), defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for k, (r, i) in enumerate(found):
                repeated[r].append(i)
                if k:
                    later[r].append(i)
    out = []
    for r, starts in repeated.items():
        cut = union(later[r], n)
        for a, b in union(starts, n):
            out.append((rows[r][0], a, b, sum(min(b, y) - max(a, x) for x, y in cut if x < b and y > a)))
    return out


def made(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["É", " x"]
    passages = [rnd.choices(vocab, k=k) for k in (49, 50, 51, 55, 60, 75, 120, 400)]
    # Passages with a common middle and other ends, where a neighbour may share less than another.
    middle = rnd.choices(vocab, k=45)
    passages += [rnd.choices(vocab, k=rnd.randrange(8)) + middle + rnd.choices(vocab, k=rnd.randrange(8)) for _ in range(8)]
    rows = [(None, None), (1, ""), (2, "few words"), (3, "same " * 49), (4, "Same " * 60), (5, "x " * 500)]
    for d in range(10, 130):
        text = rnd.choices(vocab, k=rnd.randrange(200))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            p = rnd.choice(passages)
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + p + text[at:]
        rows.append((d, rnd.choice([" ", "\n", " \t"]).join(text)))
    base = rnd.choices(vocab, k=300)
    for d in range(200, 215):  # near copies
        copy = list(base)
        for _ in range(4):
            copy[rnd.randrange(300)] = rnd.choice(vocab)
        rows.append((d, " ".join(copy).upper() if d % 2 else " ".join(copy)))
    rows += [(None, rows[-1][1])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, at int, key string")
    for parts, options in ((1, {}), (7, {}), (3, {"window": 5, "gram": 2})):
        got = R.repeated_spans(df.repartition(parts), **options).collect()
        assert sorted(str((r.doc_id, r.start, r.end, r.n_later)) for r in got) == sorted(map(str, by_windows(rows, 50)))


def test_query(spark):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = [(r.doc_id, r.start, r.end, r.n_later) for r in QUERIES["op3_repeats"](spark, sf).collect()]
    want = by_windows(rows, 50)
    assert len(want) > 20
    assert sorted(got) == sorted(want)


def test_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (2, "w " + text)], "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.start, r.end, r.n_later) for r in R.repeated_spans(df).collect())
    assert got == [(1, 0, 80, 0), (1, 0, 80, 80), (2, 1, 81, 80)]
    kept = sorted(R.drop_repeats(df).collect())
    assert [r.text for r in kept if r.doc_id == 2] == ["w "]
    assert any(r.text == text for r in kept if r.doc_id == 1)


def test_cut(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"start {passage} end", 5), (2, f"other\n{passage}\nlast line", 6), (3, None, 7), (4, passage, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in R.drop_repeats(df).collect()}
    assert got[1].text == rows[0][1] and got[3].text == "" and got[4].text == ""
    assert got[2].text == "other\nlast line" and got[2].spans == 6


def test_minimisers_depend_on_content():
    rnd = np.random.default_rng(0)
    scores = rnd.integers(0, 1 << 60, 300).astype(np.uint64)
    whole = set(R.minimisers(scores, 10).tolist())
    part = set((R.minimisers(scores[100:200], 10) + 100).tolist())
    assert part <= whole
    assert all(any(p in whole for p in range(i, i + 10)) for i in range(291))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.repeated_spans(df).count() == 0 and R.drop_repeats(df).count() == 0
