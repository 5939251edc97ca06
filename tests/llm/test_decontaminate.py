"""Contained benchmark items against a count of shingles over all pairs."""

import random
import re

import pytest

from voxboard.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def by_pairs(docs, items):
    out = set()
    for item, text in items:
        w = words(text)
        if not w:
            continue
        n = min(5, len(w))
        own = runs(w, n)
        for doc, body in docs:
            hit = len(own & runs(words(body), n))
            if hit * 100 >= len(own) * 80:
                out.add((doc, item, len(own), hit))
    return out


def made():
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(300)] + ["É", "é", "Ab"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([1, 3, 5, 6, 12, 40, 90])))) for i in range(30)]
    items += [(90, "same same same same same same same"), (91, None), (92, " \n"), (93, "Two Words"), (None, "no id here at all now")]
    docs = [(1, None), (2, ""), (3, "two\twords"), (4, "TWO"), (5, "same " * 50), (None, "x no id here at all now y")]
    for k in range(150):
        base = rnd.choices(vocab, k=rnd.choice([2, 20, 200, 1500]))
        _, text = rnd.choice(items)
        part = (text or "").upper().split()
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if part:
                part[rnd.randrange(len(part))] = "changed"
        at = rnd.randrange(len(base))
        docs.append((100 + k, " ".join(base[:at] + part + base[at:])))
    docs += [docs[-1], (100, "another text of the same id")]
    return docs, items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = made()
    d = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in docs], "doc_id long, text string, item_id int, h string, run int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, body string")
    return docs, items, d, b


def test_contained(tables):
    docs, items, d, b = tables
    got = [tuple(r)[:4] for r in D.contaminated(d, b).collect()]
    assert len(got) == len(set(got))
    assert set(got) == by_pairs(docs, items)
    assert any(2 <= n != hit for _, _, n, hit in got)


def test_shuffled_joins(tables, monkeypatch):
    docs, items, d, b = tables
    monkeypatch.setattr(D, "sent_if_small", lambda df, rows=0: df)
    assert {tuple(r)[:4] for r in D.contaminated(d, b).collect()} == by_pairs(docs, items)


def test_clean_documents_stay(tables):
    docs, items, d, b = tables
    dirty = {(doc, text) for doc, text in docs for item in items if by_pairs([(doc, text)], [item])}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    got = sorted(str((r.doc_id, r.text)) for r in kept.collect())
    assert got == sorted(str(x) for x in docs if x not in dirty)


def test_empty(tables):
    _, _, d, b = tables
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b.limit(0)).count() == 0
    assert D.decontaminate(d, b.limit(0)).count() == d.count()
