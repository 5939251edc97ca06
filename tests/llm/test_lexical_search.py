"""Ranked search against scores of all documents, codecs, skipped blocks, awkward rows."""

import math
import random
import re

import numpy as np
import pytest

from voxboard.llm.lexical_search import CorpusStats, Shard, ShardBuilder, build_index, packed, terms_of, unpacked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    """docs: (id, text) rows; items: item -> text. Every document is scored for every item."""
    bags = [(d, plain_terms(t)) for d, t in docs]
    bags = [(d, t) for d, t in bags if t]
    n_docs, total = len(bags), sum(len(t) for _, t in bags)
    out = {}
    for item, text in items.items():
        rows = []
        weight = {}
        for term in set(plain_terms(text)):
            df = sum(term in t for _, t in bags)
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for d, t in bags:
            m = 50 + 50 * len(t) * n_docs // total
            score = 0
            for term, w in weight.items():
                if tf := t.count(term):
                    score += w * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                rows.append((-score, d is None, d if d is not None else 0))
        out[item] = [(d if not none else None, -s) for s, none, d in sorted(rows)[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r.item_id), r["rank"])):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.mark.parametrize("text", ["", "A-b_C9", "Éa éA ab\x00cd", "x" * 50 + "\x7f[`{", "日本 語 x\x85y"])
def test_terms(text):
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_packed_numbers_come_back():
    rnd = np.random.default_rng(5)
    values = np.concatenate([rnd.integers(0, 1 << b, 50) for b in range(1, 32)] + [[0, 127, 128, 16383, 16384]])
    octets, at = packed(values)
    assert (unpacked(octets) == values).all() and at[-1] == len(octets)
    part = octets[at[100] : at[200]]
    assert (unpacked(part) == values[100:200]).all()
    assert len(unpacked(packed(np.zeros(0, np.int64))[0])) == 0


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for i in range(n)], rnd


@pytest.mark.parametrize("seed", range(4))
def test_shards_against_all_scores(seed):
    docs, rnd = corpus(seed)
    stats = CorpusStats(len(docs), sum(len(t.split()) for _, t in docs))
    builder = ShardBuilder(stats, 8)
    for d, t in docs:
        builder.add(d, t.encode())
    row = builder.row()
    number = {t: i for i, t in enumerate(row["terms"].split())}
    shard = Shard(row, 8)
    everything = skipped = 0
    for _ in range(30):
        text = " ".join(f"w{rnd.randrange(120)}" for _ in range(rnd.randint(1, 12)))
        want = brute(docs, {0: text}, 5)[0]
        terms = [(number[t.encode()], stats.weight(int(shard.df[number[t.encode()]]))) for t in set(text.split()) if t.encode() in number]
        shard = Shard(row, 8)
        at, scores = shard.search(terms, 5)
        assert [(shard.ids[i], s) for i, s in zip(at.tolist(), scores.tolist())] == want
        full = sum(int(shard.end[t] - shard.begin[t]) for t, _ in terms)
        everything += full
        skipped += full - shard.decoded
    # Blocks of lists that cannot lift a document any more stay packed.
    assert skipped > everything / 10


def test_search(spark):
    docs, rnd = corpus(9, 300)
    docs += [(7, docs[7][1]), (1000, None), (1001, ""), (1002, " .,-\n"), (None, docs[3][1]), (1003, "w1 " * 30_000)]
    items = {i: " ".join(f"W{rnd.randrange(120)}." for _ in range(rnd.randint(1, 15))) for i in range(12)}
    items |= {100: "w0 w0 w0", 101: "nowhere", 103: "w7 " * 40}
    rows = [(k, v) for k, v in items.items()] + [(102, None), (100, "w0"), (103, "w8")]
    items[103] += " w8"
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, score string, rank int")
    asked = spark.createDataFrame(rows, "item_id long, text string")
    want = {k: v for k, v in brute(docs, items, 20).items() if v}
    for options, query_chars in (({}, 4_000_000), ({"shard_bytes": 2000, "block": 4}, 60)):
        index = build_index(frame.repartition(3), **options)
        df = index.search(asked, 20, query_chars)
        assert df.columns == ["item_id", "rank", "doc_id", "score"]
        assert found(df) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert build_index(docs.limit(0)).search(items).count() == 0
    assert build_index(docs).search(items.limit(0)).count() == 0
    # A word in every document weighs nothing as the corpus grows, but something in one of one.
    assert found(build_index(docs).search(items)) == brute([(1, "a b")], {1: "a"}, 50)
