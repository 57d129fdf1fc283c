"""CSV records found in parallel: against the standard library's reader."""

import csv
import io
import random

import pytest

from vocspark.sources import csv_records as cr
from vocspark.sources import ingest as ing

PIECES = ["a", "é", "x y", '"', '""', ",", "\n", "\r\n", " ", "5\" tall", "ﬁ", "0"]


def _field(r):
    s = "".join(r.choice(PIECES) for _ in range(r.randrange(0, 9)))
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') or r.random() < 0.3 else s


def _by_library(text):
    rows = [x for x in csv.reader(io.StringIO(text, newline="")) if any(f.strip() for f in x) or len(x) > 1]
    return rows[0], rows[1:]


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("seed", range(4))
def test_records_of_many_splits(spark, tmp_path, tiny_splits, seed):
    r = random.Random(seed)
    lines = ["k,one,two"] + [f"{i},{_field(r)},{_field(r)}" for i in range(60)]
    text = "\n".join(lines) + "\n"
    p = tmp_path / "u.csv"
    p.write_bytes(text.encode())
    assert cr.csv_lines(spark, str(p)).select("split").distinct().count() > 10
    head, rows = _by_library(text)
    got = ing.read_csv_items(spark, str(p))
    assert got.columns == head
    assert sorted(tuple(f or "" for f in x) for x in got.collect()) == sorted(map(tuple, rows))


def test_stray_quotes_open_nothing(spark, tmp_path, tiny_splits):
    p = tmp_path / "s.csv"
    p.write_text('text,n\n5" tall and 6" wide,1\n"a ""b""\nc",2\n"open",3\n', encoding="utf-8")
    assert sorted(map(tuple, ing.read_csv_items(spark, str(p)).collect())) == [
        ('5" tall and 6" wide', "1"), ('a "b"\nc', "2"), ("open", "3")]


def test_one_record_over_many_splits(spark, tmp_path, tiny_splits):
    long = "\n".join(f"line {i} with, commas" for i in range(200))
    p = tmp_path / "l.csv"
    p.write_text(f'n,text\n1,short\n2,"{long}"\n3,last\n', encoding="utf-8")
    assert {x.n: x.text for x in ing.read_csv_items(spark, str(p)).collect()} == {"1": "short", "2": long, "3": "last"}


def test_malformed_bytes_are_dropped(spark, tmp_path):
    p = tmp_path / "b.csv"
    raw = [b"gr\xfcn \xe2\x28 ok", b"\xc3", "kept � \U0010ffff1 \U0010ffff".encode(), b"\xf0\x9f\x98\x80 \xf0\x9f\x98 end",
           "mixed �\U0010ffff0".encode() + b"\xff", b"plain"]
    p.write_bytes(b"text,n\n" + b"".join(x + b",%d\n" % i for i, x in enumerate(raw)))
    got = {int(x.n): x.text or "" for x in ing.read_csv_items(spark, str(p)).collect()}
    assert got == {i: x.decode("utf-8", "ignore") for i, x in enumerate(raw)}
    t = tmp_path / "b.txt"
    t.write_bytes(b"\n".join(raw))
    assert {x.text for x in ing.read_txt_items(spark, str(t)).collect()} == {
        x.decode("utf-8", "ignore").strip() for x in raw} - {""}


def test_headers_and_empty_files(spark, tmp_path):
    def extracted(name, text):
        p = tmp_path / name
        p.write_bytes(text.encode())
        return ing.extract_feedback(spark, str(p))

    for name, text in (("e.csv", ""), ("n.csv", "\n\n"), ("h.csv", "No.,Text\n")):
        assert extracted(name, text).count() == 0
    assert {x.text for x in extracted("d.csv", "No.,What they said.\n1,a long opinion\n2,another one\n").collect()} \
        == {"a long opinion", "another one"}
    assert {(x.text, x.segment) for x in extracted("m.csv", "﻿text,a.city\r\ngood,Oslo\r\n\r\n").collect()} == {("good", "Oslo")}
    p = tmp_path / "t.csv"
    p.write_text("text,text,\na,b,c\nd\ne,f,g,h\n", encoding="utf-8")
    got = ing.read_csv_items(spark, str(p))
    assert got.columns == ["text", "text.1", "Unnamed: 2"]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "b", "c"), ("d", None, None), ("e", "f", "g")]


def test_files_of_a_folder_drop_their_headers(spark, tmp_path):
    for i, head in enumerate(("text,n\n", "text,n\n", "")):
        (tmp_path / f"p{i}.csv").write_text(f"{head}item {i},{i}\n", encoding="utf-8")
    assert sorted(x.text for x in ing.read_csv_items(spark, str(tmp_path)).collect()) == ["item 0", "item 1", "item 2"]
