"""CSV folders: headers from first bytes, one plan for many headers, files split where their quotes allow."""

import os
import random

import pytest

from strata.operators import cleaning as CL


def test_two_thousand_headers_are_one_bounded_plan(spark, tmp_path):
    rng = random.Random(1)
    for i in range(2000):
        names = [f"x{i}", "id", "name"] + [f"y{j}" for j in range(i % 3)]
        rng.shuffle(names)
        (tmp_path / f"f{i}.csv").write_text(",".join(names) + "\n" + ",".join(f"{n}-{i}" for n in names) + "\n")
    rows, stats = CL.clean_csv_dir(spark, str(tmp_path), ["id", "name"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and plan.count("FileScan text") == 0
    got = {(r.id, r.name) for r in rows.collect()}
    assert got == {(f"id-{i}", f"name-{i}") for i in range(2000)}
    assert stats.where("status = 'ok' AND rows_out = 1").count() == 2000


@pytest.mark.parametrize("head,whole,want", [
    (b"a,b\n1,2", False, "a,b"), (b"\n \r\na,b\r\n1", False, "a,b"), (b'"a\n""x""",b\n1', False, '"a\n""x""",b'),
    (b"\xef\xbb\xbfid,\xc3\xa9\n", False, "id,é"), (b"a,b", False, None), (b"a,b", True, "a,b"), (b'"a,b\n', False, None), (b"\n\n", True, "")])
def test_first_record(head, whole, want):
    assert CL.first_record(head, whole) == want


def test_header_with_line_feed_and_long_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"first\nname",id\nx,1\n"y\nz",2\n')
    long = [f"column_{i}" for i in range(20_000)] + ["id"]
    (tmp_path / "long.csv").write_text(",".join(long) + "\n" + "," * 20_000 + "7\n")
    rows, stats = CL.clean_csv_dir(spark, str(tmp_path), ["id", "first\nname"])
    assert sorted((r["id"], r["first\nname"]) for r in rows.collect()) == [("1", "x"), ("2", "y\nz"), ("7", None)]
    assert {os.path.basename(r.file): r.columns_in for r in stats.collect()} == {"a.csv": 2, "long.csv": 20_001}


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1\n2,b,extra,more\n\n3,c\n")
    (tmp_path / "b.csv").write_text("z,z2,z3,name,id\n,,,n\n,,,m,9\n")
    rows, stats = CL.clean_csv_dir(spark, str(tmp_path), ["id", "name"])
    assert sorted((r.id or "", r.name or "") for r in rows.collect()) == [("", "n"), ("1", ""), ("2", "b"), ("3", "c"), ("9", "m")]
    assert {os.path.basename(r.file): r.rows_in for r in stats.collect()} == {"a.csv": 3, "b.csv": 2}


def test_large_files_are_split_unless_a_line_end_is_quoted(spark, tmp_path):
    lines = [f'{i},"say ""hi"" {i}",{"x" * (i % 50)}' for i in range(3000)]
    (tmp_path / "plain.csv").write_text("id,name,pad\n" + "\n".join(lines) + "\n")
    lines[1700] = '1700,"two\nlines",x'
    (tmp_path / "quoted.csv").write_text("id,name,pad\n" + "\n".join(lines) + "\n")
    (tmp_path / "small.csv").write_text('id,name\n5,"a\nb"\n')
    files = CL.csv_files(spark, str(tmp_path), split_bytes=4000)
    assert {os.path.basename(r.path): r.whole for r in files.collect()} == {"plain.csv": False, "quoted.csv": True, "small.csv": True}
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, _ = CL.clean_csv_dir(spark, str(tmp_path), ["id", "name"])
        got = rows.collect()
        scans = rows.where(f"file LIKE '%/plain.csv'").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 6001 and scans > 4
    assert {r.name for r in got if r.id == "1700"} == {'say "hi" 1700', "two\nlines"}


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_quotes_counted_in_chunks_match_a_scan(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    want = {}
    for i in range(25):
        text = "".join(rng.choice('ab,"\n\n') for _ in range(rng.randrange(1, 60)))
        (tmp_path / f"f{i}.csv").write_text(text)
        inside = [text[:k].count('"') % 2 for k, c in enumerate(text) if c == "\n"]
        want[f"f{i}.csv"] = any(inside)
    files = spark.createDataFrame([(str(tmp_path / n), os.path.getsize(tmp_path / n)) for n in want], "path string, length long")
    assert {os.path.basename(r.path): r.quoted for r in CL.quoted_line_ends(files, chunk).collect()} == want


def test_unreadable_file_is_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "ok.csv").write_text("id\n1\n")
    (tmp_path / "endless.csv").write_text('"' + "x" * 200_000)
    monkeypatch.setattr(CL, "HEADER_BYTES", 100_000)
    head = next(CL._read_headers([__import__("pyarrow").RecordBatch.from_pydict(
        {"path": [str(tmp_path / "endless.csv"), str(tmp_path / "gone.csv")], "length": [200_001, 5]})]))
    assert head.column("names").to_pylist() == [None, None]
