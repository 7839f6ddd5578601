"""The CSV reader against Python's own, whatever the splits."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.sources import csv_rows

HEAD = ",".join(csv_rows.HEADER)


def written(rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows([list(csv_rows.HEADER), *rows])
    return out.getvalue()


def read(spark, path):
    return [tuple(r) for r in csv_rows.read_rows(spark, str(path)).orderBy("row_number").collect()]


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["a", "żółw", 'say "x"', "two\nlines", "three\n\n\nlines", ",", '"', '""', "\r\nx", "", " pad ", "'", "5\" pipe", "\n", "x" * 300]
    return [[f"{i}" if k == 1 else "".join(rng.choices(words, k=rng.randrange(3))) for k in range(7)] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(keep, ("700", "0", "3"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_split(spark, tmp_path, small_splits, end):
    """Many splits of 700 bytes, so that many records and whole runs of splits lie in open fields."""
    rows = some_rows(300, end)
    rows[50][2] = "long\n" * 900  # several splits inside one field
    (tmp_path / "a.csv").write_text(written(rows, end), encoding="utf-8", newline="")
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path / "a.csv"))
    assert lines.rdd.getNumPartitions() > 30
    assert read(spark, tmp_path / "a.csv") == [(i + 1, *r) for i, r in enumerate(rows)]


def test_files_in_the_order_of_their_names(spark, tmp_path, small_splits):
    parts = [some_rows(n, n) for n in (40, 1, 0, 200)]
    for name, rows, quoting in zip("dbca", parts, (0, 1, 1, 1), strict=True):
        (tmp_path / f"{name}.csv").write_text("﻿" * (name == "c") + written(rows, quoting=quoting) + "\n" * (name == "b"), encoding="utf-8", newline="")
    (tmp_path / "empty.csv").write_text("")
    want = parts[3] + parts[1] + parts[2] + parts[0]
    assert read(spark, tmp_path) == [(i + 1, *r) for i, r in enumerate(want)]


def test_odd_files(spark, tmp_path):
    cases = {
        f"{HEAD}\n": [],
        f"{HEAD}": [],
        f"\n\r\n{HEAD}\n\na,b\n\n\nc,d,e,f,g,h,i,j\n": [("a", "b", "", "", "", "", ""), ("c", "d", "e", "f", "g", "h", "i")],
        f'{HEAD}\na,"never closed\nb,c\n\nd': [("a", "never closed\nb,c\n\nd", "", "", "", "", "")],
        f'{HEAD}\r\n"a\r\nb",c\r\n': [("a\r\nb", "c", "", "", "", "", "")],
        f'{HEAD}\n5" pipe,6" "x",7\nnext,row\n': [('5" pipe', '6" "x"', "7", "", "", "", ""), ("next", "row", "", "", "", "", "")],
    }
    for i, (text, want) in enumerate(cases.items()):
        (tmp_path / f"{i}.csv").write_text(text, encoding="utf-8", newline="")
        assert read(spark, tmp_path / f"{i}.csv") == [(n + 1, *r) for n, r in enumerate(want)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        csv_rows.read_rows(spark, str(tmp_path / "bad.csv"))


FIELDS = st.lists(st.one_of(st.text(alphabet='ab,"\n', max_size=6).map(lambda t: '"' + t.replace('"', '""') + '"'), st.text(alphabet='ab', max_size=3).flatmap(lambda a: st.sampled_from([a, a + '"x' if a else a]))), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(FIELDS, min_size=1, max_size=5))
def test_lines_tell_records_apart(records):
    """A field is open behind a line just where Python's reader needs more lines."""
    records = [f for f in records if f != [""]]
    text = "\n".join(",".join(f) for f in records)
    opened, count = False, 0
    for line in text.split("\n") if records else []:
        count += not opened and line != ""
        opened = csv_rows.ends_open(line, opened)
    assert not opened and count == len([r for r in csv.reader(io.StringIO(text, newline="")) if r])


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """64 MB with line breaks in every row: as many tasks as splits, in both passes."""
    row = 'name,"XX-{}","a\nb ""c""",lab,"5\nszt",1,' + "x" * 200 + "\n"
    with open(tmp_path / "big.csv", "w") as out:
        out.write(HEAD + "\n")
        for i in range(260_000):
            out.write(row.format(i))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        rows = csv_rows.read_rows(spark, str(tmp_path / "big.csv"))
        assert rows.rdd.getNumPartitions() >= 12
        wrong = rows.filter("sku <> concat('XX-', row_number - 1) OR manufacturer <> 'a\nb \"c\"' OR package <> '5\nszt'")
        assert wrong.count() == 0 and rows.count() == 260_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
