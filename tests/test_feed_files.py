"""CSV files against Python's csv reader, with breaks in quotes on the borders of splits."""

import csv
import io
import random

import pytest

from merchframe.sources.feed_files import file_dialects, leaves_quotes_open, scan_feed_csv
from pyspark.sql import functions as F

PIECES = ["a", "word", "5\" pipe", "x,y", "p;q", "1|2", "tab\tbed", "say \"hi\"", "one\ntwo", "\n\n", "\"", "\"\"", "", "é",
          "line\n\"quoted\"\nend", "long " * 9]


def write(path, rows, delimiter, quoting=csv.QUOTE_MINIMAL, encoding="utf-8"):
    text = io.StringIO()
    csv.writer(text, delimiter=delimiter, lineterminator="\n", quoting=quoting).writerows(rows)
    path.write_bytes(text.getvalue().encode(encoding))
    return text.getvalue()


def expected(text, delimiter):
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(keys, (str(size), "1"))]
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("size, files", [(90, 2), (400, 4), (1 << 20, 8)])
def test_random_files_match_the_reader(spark, tmp_path, small_splits, size, files):
    r, want = random.Random(size), {}
    for n, d in enumerate(([",", "\t", "|", ";"] * 2)[-files:]):
        # A steady number of plain columns lets the delimiter win; the last column holds anything.
        rows = [["k", str(i), "v", "w", r.choice(PIECES)] for i in range(60)]
        text = write(tmp_path / f"f{n}.csv", rows, d, csv.QUOTE_ALL if n % 2 else csv.QUOTE_MINIMAL)
        want[f"f{n}.csv"] = expected(text, d)
    small_splits(size)
    got = scan_feed_csv(spark, str(tmp_path))
    rows = got.select(F.element_at(F.split("feed_id", "/"), -1).alias("f"), "pos", "cells").orderBy("f", "pos").collect()
    assert len({(x.f, x.pos) for x in rows}) == len(rows)
    for name, cells in want.items():
        assert [x.cells for x in rows if x.f == name] == cells, name


def test_loose_quotes_and_an_open_end(spark, tmp_path, small_splits):
    text = 'Name,Note\n5" pipe,a "b" c\n"x"y,"z""\nq",w\n\n"" ,""\nlast,"never closed\nrest, of file\n'
    (tmp_path / "a.csv").write_text(text)
    for size in (8, 20, 1 << 20):
        small_splits(size)
        got = [x.cells for x in scan_feed_csv(spark, str(tmp_path)).orderBy("pos").collect()]
        want = expected(text.rstrip("\n"), ",")
        assert got == want


def test_a_cell_longer_than_many_splits(spark, tmp_path, small_splits):
    rows = [["a", "b"], ["k", "\n".join(f"line {i}, \"{i}\"" for i in range(150))], ["c", "d"], ["e", "\n" * 20], ["f", "g"]]
    text = write(tmp_path / "a.csv", rows, ",")
    small_splits(128)
    got = [x.cells for x in scan_feed_csv(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == expected(text, ",") == rows


def test_many_quotes_need_no_stack(spark):
    line = "x," + '"' + '""' * 200_000
    df = spark.createDataFrame([(line, ",")], "line string, d string").select(
        leaves_quotes_open(F.col("line"), F.col("d"), False), leaves_quotes_open(F.col("line"), F.col("d"), True))
    assert tuple(df.first()) == (True, False)


def test_encodings_and_empty_files(spark, tmp_path):
    write(tmp_path / "latin.csv", [["Näme", "x"], ["café\nbar", "y"]], ";", encoding="latin-1")
    write(tmp_path / "utf.csv", [["Näme", "x"], ["café", "y"]], "\t")
    (tmp_path / "mark.csv").write_bytes(b"\xef\xbb\xbfa,b\r\n1,2\r\n")
    (tmp_path / "empty.csv").write_text("")
    rows = scan_feed_csv(spark, str(tmp_path)).select(F.element_at(F.split("feed_id", "/"), -1).alias("f"), "pos", "cells")
    got = {}
    for x in rows.orderBy("f", "pos").collect():
        got.setdefault(x.f, []).append(x.cells)
    assert got == {"latin.csv": [["Näme", "x"], ["café\nbar", "y"]], "utf.csv": [["Näme", "x"], ["café", "y"]],
                   "mark.csv": [["a", "b"], ["1", "2"]]}
    assert file_dialects(spark, str(tmp_path)).where("not valid_utf8").count() == 1


def test_many_files_are_one_plan(spark, tmp_path):
    for n in range(100):
        write(tmp_path / f"f{n:03}.csv", [["a", "b"], [str(n), "x\ny"]], [",", "|"][n % 2])
    assert scan_feed_csv(spark, str(tmp_path)).count() == 200
