"""Exports in every form, written from known rows and read back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from voxboard.operators.intake import classify_rows
from voxboard.sources import clean, raw


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_a_late_latin_1_byte(spark, tmp_path):
    rows = "".join(f"plain words {i},2026-09-01\n" for i in range(2000))
    path = write(tmp_path / "late.csv", f"text,date\n{rows}café très bon,2026-09-02\n", "latin-1")
    assert raw.scan_csv(spark, path).filter("date = '2026-09-02'").first().text == "café très bon"


def test_a_long_header_and_its_neighbour(spark, tmp_path):
    names = [f"column_number_{i}" for i in range(600)]
    a = write(tmp_path / "a.csv", ",".join([*names, "text"]) + "\n" + "," * 600 + "first\n")
    b = write(tmp_path / "b.csv", ",".join([*names, "title"]) + "\n" + "," * 600 + "second\n")
    got = raw.scan_csv(spark, [a, b])
    assert {(r.text, r.title) for r in got.collect()} == {("first", None), (None, "second")}


def test_records_over_several_lines(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'text;date\n"one\nrecord; still";2026-09-01\nplain;2026-09-02\n')
    assert {r.text for r in raw.scan_csv(spark, path).collect()} == {"one\nrecord; still", "plain"}
    plain = write(tmp_path / "p.csv", "text,date\na b,2026-09-01\n")
    assert [x.multiline for x in raw.layouts(spark, [path, plain])] == [True, False]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "x.tsv", "text\tdate\ncafé\t2026-09-01\n", encoding)
    row = raw.scan_csv(spark, path).first()
    assert (row.text, row.date) == ("café", "2026-09-01")


def test_epochs_beside_written_dates(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps([{"text": "a number", "timestamp": 1788300000000}]))
    write(tmp_path / "b.csv", "text,timestamp\na text,2026-09-02\nno date,1788300000000\n")
    lines = [{"text": "line one", "timestamp": 1788300000}, {"text": "line two", "timestamp": "2026-09-03"}]
    write(tmp_path / "c.json", "\n".join(map(json.dumps, lines)) + "\n")
    got = {r.text: (r.date, r.reason) for r in classify_rows(raw.scan_raw(spark, str(tmp_path))).collect()}
    assert got == {
        "a number": (dt.date(2026, 9, 1), None),
        "a text": (dt.date(2026, 9, 2), None),
        "no date": (None, "bad_date"),
        "line one": (dt.date(2026, 9, 1), None),
        "line two": (dt.date(2026, 9, 3), None),
    }


def test_files_of_one_name(spark, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "x.csv", f"text,date\nfrom {folder},2026-09-01\n")
    df = raw.scan_raw(spark, [str(tmp_path / f / "x.csv") for f in ("two", "one")])
    assert [r.text for r in df.orderBy("src_file", "src_pos").collect()] == ["from one", "from two"]


@pytest.fixture
def cleaned(spark):
    rows = [(f"p{i % 2}", f"play-{i}", "play", 1.0, None, f"text {i}", dt.date(2024, 3, 1 + i), "en") for i in range(20)]
    return spark.createDataFrame(
        rows, "product_id string, id string, source string, rating double, title string, text string, date date, language string"
    )


def test_a_second_week_leaves_the_first(spark, cleaned, tmp_path):
    path = str(tmp_path / "clean")
    early, late = cleaned.filter("date < '2024-03-11'"), cleaned.filter("date >= '2024-03-11'")
    clean.write_clean(early, path)
    clean.write_clean(late, path)
    clean.write_clean(late, path)
    back = clean.scan_clean(spark, path)
    assert back.select(cleaned.columns).exceptAll(cleaned).count() == 0 and back.count() == 20


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_round_trip_of_the_cleaned_table(spark, cleaned, tmp_path, fmt):
    path = str(tmp_path / "corpus")
    clean.write_clean(cleaned.drop("product_id"), path, fmt=fmt)
    back = clean.scan_clean(spark, path)
    wanted = [c for c in cleaned.columns if c != "product_id"]
    assert sorted(map(str, back.select(wanted).collect())) == sorted(map(str, cleaned.select(wanted).collect()))


def test_csv_mirror(spark, cleaned, tmp_path):
    path = str(tmp_path / "mirror")
    clean.write_csv(cleaned, path)
    back = clean.scan_clean(spark, path)
    wanted = [c for c in cleaned.columns if c != "product_id"]
    assert sorted(map(str, back.select(wanted).collect())) == sorted(map(str, cleaned.select(wanted).collect()))


def test_malformed_input_is_an_error(spark, tmp_path):
    path = write(tmp_path / "bad.json", '{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        clean.scan_clean(spark, path).collect()
    write(tmp_path / "unknown.txt", "x")
    with pytest.raises(ValueError):
        clean.scan_clean(spark, str(tmp_path / "unknown.txt"))


def test_personal_columns(cleaned):
    assert "user_name" not in clean.keep_columns(cleaned.withColumn("user_name", F.lit("x"))).columns
