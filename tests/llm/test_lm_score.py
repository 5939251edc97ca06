"""Language model against plain counts, numeric gradients and a step-by-step recurrence."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxboard.llm import gru as G
from voxboard.llm import lm_score as L
from voxboard.llm.common import documents


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows, held):
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, x in rows:
        own = tokens(x)
        score = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        out.append((d, held(d), len(own), sum(counts[t] > 0 for t in own), n, score))
    return out


def crc_held(d):
    return d is None or zlib.crc32(str(d).encode()) % 10 == 0


def same(got, want):
    key = lambda r: (str(r[0]), r[1:5], round(r[5], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)


def test_query(spark):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = QUERIES["op2_lm_score"](spark, sf).collect()
    same([tuple(r)[:6] for r in got], base(rows, crc_held))
    held = [r for r in got if r.held_out]
    per = lambda name, rs: sum(r[name] for r in rs) / sum(r.n_tokens for r in rs)
    # Held-out documents are far likelier than by single-word counts.
    assert per("score", held) > per("base_score", held) + 0.5
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("head", [0, 3, 10_000])
def test_odd_rows(spark, head):
    rows = [(i, t) for i, t in enumerate(["A b c", "b B É", None, "", " \n\x0b", "end of x y z", "rare" * 9] * 9)]
    rows += [(3, rows[3][1]), (None, "b c d"), (None, None), (70, "x\x1cy new words here b" * 3), (99, "b c " * 30_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, classes int")
    got = L.lm_score(df, head_words=head, rounds=1).collect()
    same([tuple(r)[:6] for r in got], base(rows, crc_held))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_probabilities_add_up(spark):
    """Over all words and one unseen word of each class the shares add up to one."""
    texts = ["a b c da ea fa " * 3 + "ga ha", "b b c zz yy", "da da a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    data = df.selectExpr("cast(text as binary) as text")
    counts = L.stage(
        data.mapInArrow(L.count_batches, "h long, ending int, n long")
        .groupBy("h").agg({"ending": "min", "n": "sum"}).toDF("h", "ending", "n"), "test",
    )
    own = L.learn_vocabulary(counts, 3, 100, 6, 2)
    words = sorted({w for t in texts for w in t.encode().split()})
    hashes, ending = L.word_hashes(words), L.endings(words)
    kind, n = own.class_of(hashes, ending), own.head_count(hashes)
    assert own.tokens == sum(len(t.split()) for t in texts) + 3 and own.words == len(words) + 1
    for c in range(3, 6):
        inside = n[kind == c]
        if len(inside):
            seen = sum((x - own.discount) / own.total[c] for x in inside)
            assert seen + 10 ** own.unseen_log10()[c] == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "only held out"), (None, None)], "doc_id long, text string")
    got = L.lm_score(df).collect()
    assert [r.train_tokens for r in got] == [0, 0] and all(math.isfinite(r.score) for r in got)
    assert L.lm_score(df.limit(0)).count() == 0


def test_gradient():
    rnd = np.random.default_rng(0)
    model = G.Gru.start(np.ones(5) / 5, 4, kind=np.float64)
    x, y = rnd.integers(0, 6, (7, 3)), rnd.integers(0, 5, (7, 3))
    keep, weight = (rnd.random((7, 3)) > 0.3) * 1.0, rnd.random((7, 3))
    state = rnd.normal(size=(3, 4))
    _, gradient, _ = model.gradient(x, y, keep, weight, state)
    flat, slope = model.flat(), gradient.flat()

    def loss(at, by):
        moved = flat.copy()
        moved[at] += by
        return model.filled(moved).gradient(x, y, keep, weight, state)[0]

    for i in range(len(flat)):
        assert (loss(i, 1e-5) - loss(i, -1e-5)) / 2e-5 == pytest.approx(slope[i], abs=1e-7)


def test_state_goes_on_until_the_text_ends():
    rnd = np.random.default_rng(1)
    model = G.Gru.start(rnd.random(7), 5, kind=np.float64)
    texts = [rnd.integers(0, 7, n).astype(np.int16) for n in (1, 2, 40, 333, 7, 90)]

    def plain(text):
        h, x, total = np.zeros(5), 7, 0.0
        for y in text:
            a = model.input[x] + model.bias
            b = h @ model.recurrent
            z, r = (1 / (1 + np.exp(-(a + b)[k : k + 5])) for k in (0, 5))
            n = np.tanh(a[10:] + r * b[10:])
            h = (1 - z) * n + z * h
            logits = h @ model.output + model.output_bias
            total += logits[y] - np.log(np.exp(logits).sum())
            x = y
        return total / np.log(10)

    for steps in (1, 16, 1000):
        got = G.log10_likelihoods(model, texts, steps)
        assert got == pytest.approx([plain(t) for t in texts])


def test_training_learns_a_pattern():
    rnd = np.random.default_rng(2)
    texts = [np.tile(rnd.permutation(6), 30).astype(np.int16) for _ in range(64)]
    model = G.Gru.start(np.ones(6))
    before = G.log10_likelihoods(model, texts).mean()
    optimiser = G.Adam(len(model.flat()), 0.02)
    for _ in range(25):
        model, _ = G.train(model, texts, optimiser)
    assert G.log10_likelihoods(model, texts).mean() > 0.5 * before
