"""Rule statistics against plain counts, the forest against its definition, verdicts on labels."""

import re
from collections import Counter

import numpy as np
import pytest

from voxboard.llm import quality_rules as Q
from voxboard.llm.common import documents


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)]


TEXTS = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a a", "x\nx \nx\n\n\nx", "é\U0001f600 ### $$$ <b>|",
    "a\x0bb\x0cc\rd\x1ce\x85f\xa0g", "w " * 70, " ".join(f"w{i}" for i in range(60)),
    " ".join(f"u{i % 900}" for i in range(50_000)), "l1 two\n" * 40 + "other words here",
]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    got, rules = Q.statistics(None if text is None else text.encode())
    assert got == counts(text)
    assert len(rules) == len(Q.RULES) and all(np.isfinite(rules))


def test_query(spark):
    from voxboard.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc, r in got.items():
        want = counts(texts[doc])
        assert [r[c] for c in Q.COUNTS] == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[d], r.kept) for d, r in got.items() if d in labels and not r.base_failed]
    good = [k for q, k in judged if q == 1]
    bad = [k for q, k in judged if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_forest_paths():
    rnd = np.random.default_rng(3)
    rows = np.concatenate((rnd.normal(size=(300, 2)), [[9.0, 9.0]]))
    forest = Q.IsolationForest.fit(rows, 50, 64)

    def path(t, row):
        node = 0
        while forest.column[t, node] >= 0:
            node = 2 * node + 1 + (row[forest.column[t, node]] > forest.cut[t, node])
        return forest.depth[t, node]

    scores = forest.scores(rows)
    for i in (0, 17, 300):
        mean = np.mean([path(t, rows[i]) for t in range(50)])
        assert scores[i] == pytest.approx(2 ** (-mean / Q.average_path(64)))
    assert scores.argmax() == 300
    assert Q.average_path(2) == 1 and Q.average_path(1) == 0
    same = Q.IsolationForest.fit(np.zeros((5, 2)), 3, 128)
    assert len(set(same.scores(np.zeros((4, 2))))) == 1
    # Values that differ in the last bit leave no room for a cut between them.
    near = np.array([[1.0], [np.nextafter(1.0, 2)]])
    assert Q.IsolationForest.fit(near, 20, 2).depth.max() == 1


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert Q.calibrated_threshold(scores, good, 0.001) == pytest.approx(0.55)
    assert Q.calibrated_threshold(scores, ~good, 0.001) == pytest.approx(0.9)
    assert Q.calibrated_threshold(scores, good & False, 0.001) == np.inf


def test_odd_tables(spark):
    rows = [(i, t, 5, "r") for i, t in enumerate(TEXTS)] * 2 + [(None, TEXTS[10], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, rules string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality_rules(docs, none).collect()
    assert len(got) == len(rows)
    # Without a label nothing but the base rules rejects.
    assert all(r.kept != r.base_failed for r in got)
    assert Q.quality_rules(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(10, 1), (10, 1), (None, 0), (11, None), (99, 0)], "doc_id long, quality int")
    assert len(Q.quality_rules(docs, labels).collect()) == len(rows)


def odd_texts(rnd, kind):
    words = ["".join(rnd.choice(list("abcdefghijklmnop"), 5)) for _ in range(100)]
    if kind == "repeats":
        # Three times the same run of 15 words: 45% in repeated windows, less than the base rule's half.
        words = (words[:15] + words[20:38]) + (words[:15] + words[40:59]) + (words[:15] + words[60:78])
    if kind == "lines":
        return "\n".join([" ".join(words[i : i + 5]) for i in range(0, 100, 5)] + [words[0]] * 20)
    if kind == "signs":
        for i in range(0, 90, 10):
            words[i], words[i + 1], words[i + 2] = "#abc", "ABCD", "1234"
    return " ".join(words)


@pytest.mark.parametrize("kind", ["repeats", "lines", "signs"])
def test_labels_tell_odd_texts_apart(spark, kind):
    rnd = np.random.default_rng(2)
    rows = [(i, odd_texts(rnd, kind if i % 20 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 20 != 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = Q.quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert not any(r.base_failed for r in made)
    assert {r.doc_id for r in made if not r.kept and r.doc_id % 20 == 0} == set(range(0, 400, 20))
    assert sum(r.kept for r in made if r.doc_id % 20) > 375


def test_band_is_that_of_good_rows():
    rows = np.array([[8.5, 0.0], [9.5, 0.02]])
    low, high = Q.good_band(rows, 0.001)
    assert low.tolist() == [8.5, 0] and high.tolist() == [9.5, 0.02]
    assert Q.beyond(np.array([[9.0, 0.09]]), (low, high)).tolist() == [[0, pytest.approx(0.07)]]
    assert Q.good_band(rows[:0], 0.001) is None and Q.beyond(rows, None) is rows


def test_every_row_counts(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, odd_texts(rnd, ["", "signs", "repeats"][i % 3 if i % 7 == 0 else 0])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marks = [(i, int(i % 7 != 0)) for i in range(0, 300, 2)] + [(2, 1), (301, 1), (None, 1), (1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    stats = Q.rule_statistics(docs).drop("text").cache()
    # Few trees of few leaves, yet no row is left out of any of them.
    trees, leaves, loss = 4, 8, 0.2
    forest = Q.fit_quality(stats, labels, trees=trees, tree_rows=leaves, max_loss=loss)
    made = {r.doc_id: r.rules for r in stats.collect()}
    known = [(made[i], q) for i, q in marks if i in made and q is not None]
    values, good = np.array([v for v, _ in known]), np.array([q == 1 for _, q in known])
    band = Q.good_band(values[good], loss)
    assert [b.tolist() for b in forest.band] == [b.tolist() for b in band]
    every = Q.beyond(np.array([made[i] for i in range(300)]), band)
    assert forest.norm == Q.average_path(300)

    def compare(t, node, level, part):
        low, high = part.min(axis=0), part.max(axis=0)
        if level == 3 or len(part) < 2 or not (high > low).any():
            assert forest.column[t, node] == -1
            assert forest.depth[t, node] == level + Q.average_path(len(part))
            return 1
        c, cut = forest.column[t, node], forest.cut[t, node]
        draw = np.random.default_rng([0, t, node])
        assert c == draw.choice(np.flatnonzero(high > low))
        assert cut == min(draw.uniform(low[c], high[c]), np.nextafter(high[c], low[c]))
        left = part[:, c] <= cut
        return compare(t, 2 * node + 1, level + 1, part[left]) + compare(t, 2 * node + 2, level + 1, part[~left])

    assert sum(compare(t, 0, 0, every) for t in range(trees)) > trees
    scores = forest.scores(Q.beyond(values, band))
    assert forest.threshold == Q.calibrated_threshold(scores, good, loss)
    again = Q.fit_quality(stats.repartition(2), labels, trees=trees, tree_rows=leaves, max_loss=loss)
    assert (again.cut == forest.cut).all() and (again.depth == forest.depth).all()
    assert again.threshold == forest.threshold
