"""Base spans against the plain patterns, disclosing terms against counts, awkward documents."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import pyarrow as pa
import pytest

from voxboard.llm import personal_data as P
from voxboard.llm.common import documents

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checked(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(PLAIN)
        for m in re.finditer(PLAIN[kind], text or "")
        if checked(kind, m[0])
    ]


def spans(text):
    return [s[:3] for s in P.base_spans(text or "")]


CASES = [
    "", "a@b", "a@b.c", "x a.b+c@d-e.f.g, h", "a@b@c.d", "a@b.c@d.e", "@b.c@d.e", "é@b.cé", "1.2.3.4", "1.2.3.4.5.6.7.8",
    "256.1.1.1", "0001.000.255.09", "1.2.3.4444 9.9.9.9", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
    "4111  1111 1111 1111", "+1 (743) 555-3824", "+1 2", "+12345678", "+123456789", "+1234567890123456", "++49 30 1234567)",
    "+4 (((", "0" * 13, "0" * 20, "1 2 3 4", "٣@b.c +٣٣٣٣٣٣٣٣٣٣", "a@b.c" * 50,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert spans(text) == plain_spans(text)


def test_base_spans_of_random_texts():
    rnd = random.Random(4)
    hits = 0
    for _ in range(4000):
        text = "".join(rnd.choices(["a", "@", ".", "+", "-", " ", "(", "1", "4111", "25", "\n", "é", "111", "0"], k=rnd.randint(0, 60)))
        assert spans(text) == plain_spans(text)
        hits += len(spans(text))
    assert hits > 300


def test_long_runs_take_time_in_proportion():
    begin = time.time()
    for part in ("a", "1", "a@", "1.", "+1", "1 ", "+1(", "a@b.", "@"):
        P.base_spans(part * 500_000)
    assert time.time() - begin < 30


def brute(rows, window=P.WINDOW, threshold=P.THRESHOLD, min_texts=P.MIN_TEXTS):
    """Spans of every row by dictionaries of documents and texts."""
    near, holders, docs, places = defaultdict(set), defaultdict(set), defaultdict(set), []
    seen = defaultdict(set)
    for r, (_, text) in enumerate(rows):
        text = text or ""
        key = (_, text)
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for a, b in words:
            t = text[a:b].lower().strip(P.MARKS)
            if t:
                docs[t].add(r)
                if re.search("[0-9]", t):
                    docs["shape " + re.sub("[0-9]", "#", t)].add(r)
        found = plain_spans(text)
        inside = [any(a < e and s < b for _, s, e in found) for a, b in words]
        for kind, s, e in found:
            value = text[s:e].lower() if kind == 0 else text[s:e] if kind == 1 else re.sub("[^0-9]", "", text[s:e])
            holders[kind, value].add(key)
            touched = [i for i, (a, b) in enumerate(words) if a < e and s < b]
            for i in range(touched[0] - window, touched[-1] + window + 1):
                if 0 <= i < len(words) and not inside[i]:
                    a, b = words[i]
                    t = text[a:b].lower().strip(P.MARKS)
                    if t:
                        a += len(text[a:b]) - len(text[a:b].lstrip(P.MARKS))
                        b = a + len(text[a : words[i][1]].strip(P.MARKS))
                        names = [t] + (["shape " + re.sub("[0-9]", "#", t)] if re.search("[0-9]", t) else [])
                        for name in names:
                            near[(kind, value), name].add(key)
                            seen[(kind, value), name].add(text)
                        places.append((r, a, b, (kind, value), names))
    n = len(rows)

    def tells(entity, name):
        # A repeated row is one document where it stands by an entity, a document each where it is counted.
        p = len(holders[entity]) / n
        both = len(near[entity, name])
        if len(seen[entity, name]) < min_texts or p >= 1:
            return False
        q = (both + P.PRIOR * p) / (len(docs[name]) + P.PRIOR)
        return math.log(q / p) >= -math.log(p) * threshold

    flags = defaultdict(lambda: [False, False, False])
    for r, a, b, entity, names in places:
        f = flags[r, a, b]
        if tells(entity, names[0]):
            f[0], f[1] = True, f[1] or len(names) > 1
        f[2] |= len(names) > 1 and tells(entity, names[1])
    out = [set(plain_spans(text)) for _, text in rows]
    out = [sorted((k, a, b) for k, a, b in s) for s in out]
    for (r, a, b), (own, shaped, shape_tells) in flags.items():
        if own:
            out[r].append((4 if shaped and not shape_tells else 5, a, b))
    return [sorted(s) for s in out]


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        text = rnd.choices(words, k=rnd.randint(3, 25))
        if i % 10 == 0:  # the same person, with a name and a customer number of their own
            text[2:2] = ["Quentin,", "nr-4711", "mail", "q@example.org", "tel", "+49 30 1234567", "Zebra!"]
        if i % 7 == 0:
            text[1:1] = ["nr-" + str(1000 + i), f"{rnd.choice('ab')}@example.org", "mail"]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_disclosing_terms_against_counts(spark, seed):
    rows = corpus(seed)
    rows += [(1, None), (2, ""), (None, rows[0][1]), (3, rows[10][1]), rows[20], (5, "x " * 100_000 + "q@example.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    for r in P.personal_data(docs).collect():
        got[r.id].append([tuple(s) for s in r.spans])
        assert [s for s in got[r.id][-1] if s[0] < 4] == [tuple(s) for s in r.base_spans]
    want = defaultdict(list)
    for (doc, _), s in zip(rows, brute(rows)):
        want[doc].append(s)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    kinds = {s[0] for v in want.values() for x in v for s in x}
    assert {0, 3, 4, 5} <= kinds
    # Words that everybody uses tell nothing.
    texts = dict(rows)
    told = {texts[d][a:b] for d, v in want.items() if d == 20 for x in v for k, a, b in x if k > 3}
    assert told == {"Quentin", "nr-4711", "Zebra", "tel"}


def test_the_sql_says_the_same(spark):
    import duckdb
    import pandas as pd

    from voxboard.llm.queries import PERSONAL_DATA_SQL, QUERIES  # noqa: F401

    rows = [*corpus(5), (900, None), (901, "Ünïcödé 1.2.3.4 (q@example.org) 4111 1111 1111 1111")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    cur = con.execute(PERSONAL_DATA_SQL)
    names = [d[0] for d in cur.description]
    want = {r[0]: dict(zip(names, r)) for r in cur.fetchall()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in P.personal_data(docs).select("id", P.joined_spans("spans").alias("spans")).collect():
        assert r.spans == want[r.id]["spans"]
    assert sum("term_" in w["spans"] for w in want.values()) >= 20


def test_words_around_entities_are_handed_on_in_parts():
    texts = [" ".join(f"word{i} 10.0.{i}.{j}" for j in range(40)) for i in range(200)]
    texts[7:7] = ["", "nothing here"]
    n = len(texts)
    batch = pa.record_batch([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["id", "body", "text"])
    whole = pa.Table.from_batches(list(P.scan_batches(8, held=10**9)([batch])))
    parts = list(P.scan_batches(8, held=1000)([batch, batch.slice(0, 0)]))
    most = max(len(x) for x in whole["near"].to_pylist())
    assert len(parts) > 10 and all(len(p["near"].flatten()) <= 1000 + most for p in parts)
    assert pa.Table.from_batches(parts).equals(whole) and whole["id"].to_pylist() == list(range(n))


def test_few_rows_are_staged_in_few_files(spark, monkeypatch):
    staged, stage = {}, P.stage

    def kept(df, name):
        out = stage(df, name)
        staged[name] = out
        return out

    monkeypatch.setattr(P, "stage", kept)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame(corpus(0), "doc_id long, text string")
        assert P.personal_data(docs).count() == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("together", "disclosing"):
        assert staged[name].count() >= 3 and len(staged[name].inputFiles()) == 1


def test_sanitised(spark):
    rows = corpus(0)
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    found = {r.doc_id: r.text for r in P.sanitised(docs).collect()}
    assert len(found) == 300
    assert "[term], nr-#### mail [email] [term] [phone] [term]!" in found[20]
    assert found[1] == rows[1][1]
    assert P.replaced("a 1.2.3.4 b", [(1, 2, 9), (3, 4, 9)]) == "a [ip] b"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.personal_data(docs).count() == 0 and P.sanitised(docs).count() == 0


def test_query(spark):
    from voxboard.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    hits = 0
    for r in QUERIES["op12_personal_data"](spark, SF).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == i for s in base) for i in range(4)]
        line = ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans.startswith(line)
        assert base or not r.spans
        hits += len(base)
    assert hits > 5
