"""Language models against a direct computation, and accuracy on held-out documents."""

from collections import Counter

import numpy as np
import pytest

from voxboard.llm import language_id as L
from voxboard.llm.common import documents


def by_definition(texts, order, alphabet):
    """Interpolated Kneser-Ney probability of a character after a context, by dictionaries."""
    counts = Counter()
    for t in texts:
        s = (0,) * (order - 1) + tuple(t)
        counts.update(s[i : i + order] for i in range(len(t)))
    tables = {order: counts}
    for m in range(order - 1, 0, -1):
        tables[m] = Counter(g[1:] for g in tables[m + 1])

    def probability(gram, m):
        if m == 0:
            return 1 / (L.LETTERS + 2)
        gram, table = gram[len(gram) - m :], tables[m]
        once, twice = (sum(c == k for c in table.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        below = probability(gram, m - 1)
        if not after:
            return below
        return max(table[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * below

    return probability


def test_probabilities():
    texts = {"a": ["ababa c", "abc abc"], "b": ["zzab", "zyx zyx z"]}
    alphabet = np.array(sorted(ord(c) for c in "abcxyz"), np.uint32)
    models = L.CharacterModels(["a", "b"], alphabet, 3)
    coded = {n: [models.codes(t.encode()) for t in ts] for n, ts in texts.items()}
    counts = {}
    for n, ts in coded.items():
        keys, c = np.unique(np.concatenate([L.grams(t, 3) for t in ts]), return_counts=True)
        counts[n] = (keys, c.astype(float))
    models.fit(counts)
    want = {n: by_definition([t.tolist() for t in ts], 3, alphabet) for n, ts in coded.items()}
    for text in ("abc", "zzz yx", "q ab", "cab zy"):
        codes = models.codes(text.encode())
        got = models.probability(L.grams(codes, 3), 3)
        padded = (0, 0, *codes.tolist())
        for i in range(len(codes)):
            for l, n in enumerate(("a", "b")):
                assert got[i, l] == pytest.approx(want[n](padded[i : i + 3], 3))
    # Probabilities of all characters after a context add up to one.
    for context in ((0, 0), (1, 2), (6, 6), (255, 3)):
        keys = np.array([context[0] << 16 | context[1] << 8 | c for c in range(256)], np.uint64)
        assert models.probability(keys, 3).sum(axis=0) == pytest.approx([1, 1])


def test_letters():
    assert L.letters("Ab  ÉŒ1,x".encode()).tolist() == [ord(c) if c != " " else 0 for c in "ab éœ x"]
    assert L.letters(b"").tolist() == [] and not L.letters(b"12 3").any()


@pytest.fixture(scope="module")
def models(spark):
    return L.fit_language_models(L.labelled_documents(documents(spark, "/root/testdata/sf0.01")))


def test_held_out_accuracy(spark, models):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op9_language_id"](spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in documents(spark, sf).collect()}
    assert got.keys() == truth.keys()
    held = [d for d, r in got.items() if r.held_out]
    assert len(held) > 100
    assert sum(got[d].lang_pred == truth[d] for d in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) == 0


def test_rejection_and_odd_rows(spark, models):
    rnd = np.random.default_rng(1)
    noise = " ".join("".join(rnd.choice(list("qxzjkvwpbf"), 7)) for _ in range(200))
    greek = "αβγδε ζηθικ λμνξο " * 20
    rows = [(1, None), (2, ""), (3, "12 -- 3"), (4, noise), (5, greek), (6, "the and of that with " * 30)]
    rows += [(6, rows[-1][1]), (None, "der die und nicht ein " * 9), (8, "the and " * 300_000)]
    df = spark.createDataFrame([(d, t, "en", 1) for d, t in rows], "doc_id long, text string, lang_pred string, in_0 int")
    out = L.language_id(df, models)
    assert out.columns == ["doc_id", "text", "in_0", "lang_pred", "score", "cross_entropy", "rejected"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in out.collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [g[2] for g in got[3:5]] == [True, True]
    assert got[5:7] == [(6, "en", False)] * 2 and got[7][:2] == (None, "de") and got[8] == (8, "en", False)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    models = L.fit_language_models(L.labelled_documents(df))
    got = [(r.lang_pred, r.rejected) for r in L.language_id(df, models).collect()]
    assert got == [("und", False), ("und", True)]
    assert L.language_id(df.limit(0), models).count() == 0


def test_learns_from_the_right_rows_only(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    import zlib

    ids = {r.id for r in L.labelled_documents(docs).collect()}
    assert ids == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}


def test_every_language_and_letter_is_learned(spark):
    """Seventy languages with scripts of their own, all letters of which lie beyond the first 254."""
    rnd = np.random.default_rng(4)
    scripts = {f"l{k:02}": [chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(70)}

    def text(own):
        return " ".join("".join(rnd.choice(own, 3)) for _ in range(60))

    rows = [(f"{lang}-{i}", lang, text(own)) for lang, own in scripts.items() for i in range(6 + (lang < "l64"))]
    models = L.fit_language_models(spark.createDataFrame(rows, "id string, lang string, text string"))
    assert models.languages == sorted(scripts) and len(models.alphabet) == 2800
    assert len(set(models.codes("".join(sum(scripts.values(), [])).encode()).tolist())) == 2800
    fresh = [text(own).encode() for own in scripts.values()]
    assert models.predict(fresh)[0].to_pylist() == sorted(scripts)
    # Probabilities of all characters after a context, the other letters included, add up to one.
    context = models.codes(rows[0][2][:3].encode()).tolist()
    last = [*range(2801), (1 << models.width) - 1]
    keys = [context[0] << 48 | context[1] << 32 | context[2] << 16 | c for c in last]
    assert models.probability(np.array(keys, np.uint64), 4).sum(axis=0) == pytest.approx([1] * 70)


def test_widest_alphabet():
    alphabet = np.arange(1, 70_001, dtype=np.uint32)
    models = L.CharacterModels(["a"], alphabet, L.ORDER)
    assert (models.width, models.order, models.kinds) == (21, 3, 70_002)
