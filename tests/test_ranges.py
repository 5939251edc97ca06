"""Records cut by byte ranges, against the csv and json modules over whole files."""

import csv
import io
import json
import random

import pytest

from voxboard.sources import raw
from voxboard.sources.ranges import DelimitedScan, JsonScan, Change, State, quoted_after, starts


def dealt(data: bytes, separator: bytes, size: int):
    """(block, pieces) of each range: a line belongs to the range in which it begins, or at whose end."""
    out, pos = {}, 0
    lines, at = [], 0
    while at < len(data):
        end = data.find(separator, at)
        end = len(data) if end < 0 else end
        lines.append((at, data[at:end]))
        at = end + len(separator)
    for block in range(0, max(1, len(data)), size):
        own = [x for a, x in lines if (a == 0 if block == 0 else False) or block < a <= block + size]
        if own:
            out[block] = own
    return out


def cut(scan, data, size, path="f"):
    """All records, as the two scans and the folding in between give them."""
    blocks = dealt(data, scan.separator, size)
    rows = []
    for block, pieces in blocks.items():
        *both, form = scan.changes(block, pieces)
        rows.append({"path": path, "block": block, **{c: [getattr(x, c) for x in both] for c in ("quoted", "delta", "low")}})
    known, parts, out = starts(rows, scan), {}, []
    for block, pieces in blocks.items():
        start = known[path, block]
        for at, (text, ended) in enumerate(scan.cut(path, block, pieces, start.state)):
            if at == 0 and start.owner is not None:
                # Of a list inside the list there is no beginning.
                parts.setdefault(start.owner, []).append(text)
            elif ended:
                out.append(((block, at), text))
            else:
                parts[block] = [text]
                out.append(((block, at), None))
    return [t.decode() if t is not None else b"".join(parts[b]).decode() for (b, _), t in sorted(out, key=lambda x: x[0])]


@pytest.mark.parametrize("encoding", ["UTF-8", "UTF-16LE"])
@pytest.mark.parametrize("seed", range(4))
def test_delimited_records(seed, encoding):
    rnd = random.Random(seed)
    for _ in range(60):
        rows = [
            ["".join(rnd.choices(["a", "b", '"', "\n", "\r\n", ";", " ", "é", "ਅ"], k=rnd.randint(0, 8))) for _ in range(3)]
            for _ in range(rnd.randint(1, 12))
        ]
        text = io.StringIO()
        csv.writer(text, delimiter=";", lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
        data = text.getvalue().encode(encoding)
        for size in (2, 6, 14, 40, 1000):
            found = cut(DelimitedScan(encoding, ";"), data, size)
            assert [next(csv.reader(io.StringIO(r, newline=""), delimiter=";")) for r in found if r] == [r for r in rows if r]


def test_quotes():
    assert not quoted_after('a "b, c', False, ",") and quoted_after('a,"b, c', False, ",")
    assert not quoted_after('"a ""b"" c",d', False, ",") and quoted_after('x""', True, ",")
    assert not quoted_after('x"""', True, ",") and quoted_after('","', False, ",") is False
    assert quoted_after('a" ,"b', True, ",") and not quoted_after('"a"b",c', False, ",")


def test_a_separator_across_two_characters():
    # U+0A05 and U+0100 hold the bytes of a line break between them.
    text = 'a;b\n"ਅĀx";1\nnext;2\n'
    assert cut(DelimitedScan("UTF-16LE", ";"), text.encode("utf-16-le"), 1000) == ["a;b", '"ਅĀx";1', "next;2"]
    with pytest.raises(ValueError):
        list(DelimitedScan("UTF-16LE", ";").lines(10, [b"a"]))


def values(rnd, depth=0):
    kind = rnd.randint(0, 6 if depth < 3 else 3)
    if kind <= 3:
        return rnd.choice(["", 'q"}{[]\\', "é,:", "}" * 3, 1.5, None, True])
    if kind == 4:
        return [values(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {rnd.choice(["a", "}", 'k"', "data"]): values(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}


@pytest.mark.parametrize("seed", range(4))
def test_list_elements(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        doc = [values(rnd) for _ in range(rnd.randint(0, 12))]
        data = json.dumps(doc, indent=rnd.choice([None, 1]), ensure_ascii=rnd.random() < 0.5).encode()
        for size in (3, 17, 50, 5000):
            found = [json.loads(x) for x in cut(JsonScan(), data, size)]
            assert found == [x for x in doc if isinstance(x, dict)]


def test_forms():
    def form(text):
        return JsonScan().changes(0, text.split(b"}"))[2]

    assert form(b"\xef\xbb\xbf [1]") == "list" and form(b'{"a": "}{"}\n') == "object"
    assert form(b'{"a": 1}\n{"b": 2}\n') == "lines" and form(b"3") == "other"
    scan = JsonScan()
    assert scan.inside(State(False, 2)) and scan.ends(State(True, 3), Change(False, 0, -2))


@pytest.fixture
def small_ranges(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


LONG = "line one\nline \"two\", with };[ marks\r\nline three é " * 30


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "utf-16-le", "latin-1"])
def test_one_file_in_many_ranges(spark, tmp_path, small_ranges, encoding):
    rows = [[f"r{i}", LONG if i % 7 == 3 else f"a{i}\nb", "" if i % 2 else "x"] for i in range(40)]
    with open(tmp_path / "m.csv", "w", encoding=encoding, newline="") as out:
        csv.writer(out).writerows([["Id", "text", "date"], *rows])
    df = raw.scan_csv(spark, str(tmp_path / "m.csv"))
    assert df.columns == ["id", "text", "date", "src_file", "src_pos"]
    got = [[r.id, r.text, r.date or ""] for r in df.orderBy("src_pos").collect()]
    assert got == rows
    assert df.select("src_pos.block").distinct().count() > 5


@pytest.mark.parametrize("indent", [None, 2])
def test_json_in_many_ranges(spark, tmp_path, small_ranges, indent):
    rows = [{"id": i, "text": LONG if i % 9 == 4 else f"t}}{i}", "more": {"data": [{"x": 1}, [2]]}} for i in range(60)]
    wrapped = {
        "meta": {"reviews": [{"id": -1}], "n": {"a": {}}}, "items": [{"id": -2}], "reviews": None,
        "data": [*rows[:30], 7, [{"id": -3}], None], "tail": [{"id": -4}],
    }
    for name, doc in (("a", rows[30:]), ("b", wrapped), ("c", {"id": 99, "text": "single", "reviews": 3}), ("d", []), ("e", 5)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent))
    (tmp_path / "f.json").write_text('{"id": 100, "text": "line"}\n{"id": 101}\n')
    df = raw.scan_raw(spark, str(tmp_path))
    got = {r.id: r.text for r in df.collect()}
    want = {r["id"]: r["text"] for r in rows} | {99: "single", 100: "line", 101: None}
    assert got == want and df.count() == len(want)
    assert [r.id for r in df.filter("src_file like '%a.json'").orderBy("src_pos").collect()] == list(range(30, 60))
    blocks = df.groupBy("src_file").agg({"src_pos.block": "approx_count_distinct"}).collect()
    assert max(r[1] for r in blocks) > 5


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    (tmp_path / "x.csv").write_text('text,date\n"' + LONG.replace('"', '""') * 3 + '",2026-09-01\nlast,2026-09-02')
    got = raw.scan_csv(spark, str(tmp_path / "x.csv")).orderBy("src_pos").collect()
    assert [r.text for r in got] == [LONG * 3, "last"]
