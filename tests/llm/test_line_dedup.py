"""Line dedup against dictionaries, on documents made to be awkward."""

import random
from collections import defaultdict

import pytest

from voxboard.llm.line_dedup import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def expected(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    keeper = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [i for i, x in enumerate(lines) if key(x) in keeper and keeper[key(x)] != doc]
        out.append((doc, len(lines), gone, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def made():
    rnd = random.Random(3)
    common = [f"common line number {i}, É\U0001f600 with enough characters in it" for i in range(12)]
    edge = ["x" * 39, "x" * 40, "é" * 40, "Y" * 40]
    rows = [(None, None), (None, common[0]), (1, ""), (2, "\n\n"), (3, "\n".join(common * 3))]
    for d in range(10, 60):
        lines = rnd.choices([*common, *edge, "short", "", f"own line of document {d} that nobody else has at all"], k=rnd.randrange(12))
        lines = [rnd.choice([x, x.upper(), "\t " + x, x + " \r", x + "\x0b"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    rows += [(20, "another text\n" + common[1]), rows[-1], rows[-1], (70, "z" * 200_000 + "\n" + common[2])]
    rows.append((80, "\n".join(f"line {i} of a very long document with very many lines" for i in range(30_000)) + "\n" + common[3]))
    return rows


@pytest.mark.parametrize("options", [{}, {"min_chars": 39, "min_docs": 2}, {"min_docs": 1000}])
def test_lines(spark, options):
    rows = made()
    df = spark.createDataFrame([(d, t, 1, "p", 2) for d, t in rows], "doc_id long, text string, pos int, line string, h1 int")
    got = line_dedup(df.repartition(5), **options)
    assert got.columns == ["doc_id", "pos", "line", "h1", "text", "n_lines", "n_dropped", "dropped"]
    found = [(r.doc_id, r.n_lines, r.dropped, r.text) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected(rows, **options)))
    assert all(r.n_dropped == len(r.dropped) for r in got.collect())


def test_empty(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
