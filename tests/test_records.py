"""Parallel splitting of quoted CSV: the same rows and rejects as the one-task reader, whatever the blocks."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files as A
from ledgerline.sources import records as R

SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture()
def small_blocks(spark):
    for k, v in zip(SPLITS, ("150", "1", "64")):
        spark.conf.set(k, v)
    yield
    for k in SPLITS:
        spark.conf.unset(k)


def one_task(spark, path, names):
    """(rows, rejects) of Spark's own multi-line reader, a task per file."""
    schema = ", ".join(f"`{n}` string" for n in [*names, A.CORRUPT])
    options = A.CSV_OPTIONS | {"enforceSchema": "true", "columnNameOfCorruptRecord": A.CORRUPT, "columnPruning": "false"}
    rows = spark.read.schema(schema).options(**options).csv(path).collect()
    return sorted(repr(tuple(r)[:-1]) for r in rows if r[A.CORRUPT] is None), sorted(r[A.CORRUPT] for r in rows if r[A.CORRUPT] is not None)


def many_tasks(spark, path):
    rows, rejects = A.read_upload_with_rejects(spark, path)
    return sorted(repr(tuple(r)) for r in rows.collect()), sorted(r.record for r in rejects.collect())


VALUES = ["a", "", " ", "x y", '"q"', '"a,b"', '"two\nlines"', '"say ""hi"""', '"\n\n"', '""', '" lead"', 'mid"quote', 'end"', "é日本", '"a""\n""b"', '"x" ', "#", "'", '"l1\nl2,\n""l3"', " \"no\""]


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\n"), (4, "\r\n")])
def test_same_rows_and_rejects_as_one_task(spark, tmpdir_path, small_blocks, seed, end):
    rng = random.Random(seed)
    text = ["h1,h2,h3"] + [",".join(rng.choice(VALUES) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) for _ in range(220)] + ["", "last,line,here"]
    path = f"{tmpdir_path}/up.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(end.join(text).replace("\n", end).replace("\r\r", "\r") + (end if seed % 2 else ""))
    scan = spark.read.option("lineSep", "\n").text(path)
    assert scan.rdd.getNumPartitions() > 10
    want, got = one_task(spark, path, ["h1", "h2", "h3"]), many_tasks(spark, path)
    assert got[0] == want[0] and len(got[0]) > 60
    assert sorted(x.replace("\r\n", "\n").strip("\n") for x in want[1]) == sorted(x.strip("\n") for x in got[1])


def test_a_value_over_many_blocks(spark, tmpdir_path, small_blocks):
    path = f"{tmpdir_path}/long.csv"
    value = "\n".join(f'line ""{i}"", more' for i in range(200))
    with open(path, "w") as f:
        f.write(f'﻿Id,"No\nte"\n1,"{value}"\n2,plain\n3,"{value}"\n')
    rows, rejects = A.read_upload_with_rejects(spark, path)
    assert rows.columns == ["Id", "No\nte"] and rejects.count() == 0
    want = value.replace('""', '"')
    assert sorted(tuple(r) for r in rows.collect()) == [("1", want), ("2", "plain"), ("3", want)]


def test_an_unclosed_quote_takes_the_rest(spark, tmpdir_path, small_blocks):
    path = f"{tmpdir_path}/open.csv"
    with open(path, "w") as f:
        f.write("a,b\n1,2\n3,\"open\n" + "4,5\n" * 100)
    rows, rejects = A.read_upload_with_rejects(spark, path)  # the file's last line break is not part of the value
    assert sorted(map(tuple, rows.collect())) == [("1", "2"), ("3", ("open\n" + "4,5\n" * 100)[:-1])] and rejects.count() == 0


def test_faults_of_one_upload_are_told(spark, tmpdir_path):
    path = f"{tmpdir_path}/bad.csv"
    with open(path, "w") as f:
        f.write("A,B\n1,2\n3,4,SURPLUS\n5\n")
    rows, rejects = A.read_upload_with_rejects(spark, path)
    assert [tuple(r) for r in rows.collect()] == [("1", "2")] and sorted(r.record for r in rejects.collect()) == ["3,4,SURPLUS", "5"]
    with pytest.raises(ValueError, match="number of fields"):
        A.read_upload(spark, path)


def test_many_files_and_names_with_blanks(spark, tmpdir_path, small_blocks):
    for i in range(30):
        with open(f"{tmpdir_path}/up load {i}%.csv", "w") as f:
            f.write((["Invoice No.,Amount", "Amount,Invoice No."][i % 2] + f"\n{i},{i}\n") if i % 10 else ("\n" if i else ""))
    rows, rejects = A.read_folder_with_rejects(spark, tmpdir_path)
    assert sorted(int(r.INVOICE_NO) for r in rows.collect()) == [i for i in range(30) if i % 10]
    assert sorted((r.reason, r.path.rsplit("/", 1)[-1]) for r in rejects.collect()) == [("empty file", f"up load {i}%.csv") for i in (0, 10, 20)]


@pytest.mark.parametrize("line, out, inside", [
    ("a,b", False, True), ('"a,b', True, True), ('a,"b"', False, False), ('a"b', False, False), ('"', True, False), ('""', False, True), ('"a"",', True, True),
    ('x,"y""z",w', False, True), ('","', False, True), ('"a"b"c,"d', True, False)])
def test_functions_of_lines(spark, line, out, inside):
    import csv
    import io

    def ends_inside(text):
        """By the standard reader, where it agrees with the rule: one more line joins the record or not."""
        return len(list(csv.reader(io.StringIO(text + "\nz")))) == 1

    row = spark.range(1).select(F.regexp_like(F.lit(line), F.lit(R._whole(R.OPENS))).alias("o"), F.regexp_like(F.lit(line), F.lit(R._whole(R.STAYS))).alias("i")).first()
    got = (row.o if '"' in line else False, row.i if '"' in line else True)
    assert got[0] == ends_inside(line)
    assert got[1] == ends_inside('"' + line)


def test_long_lines_need_no_deep_stack(spark):
    wide = ",".join(['"a""b"'] * 50_000)
    row = spark.createDataFrame([(wide, '"' + '""' * 50_000)], "x string, y string")
    got = row.select(F.regexp_like("x", F.lit(R._whole(R.OPENS))), F.regexp_like("y", F.lit(R._whole(R.OPENS))), F.regexp_like("x", F.lit(R._whole(R.STAYS)))).first()
    assert tuple(got)[:2] == (False, True)


@pytest.mark.parametrize("seed, bits", [(5, 0), (6, 2), (7, 4)])
def test_records_over_chunks_are_put_together(spark, tmpdir_path, monkeypatch, seed, bits):
    """Chunks of 1, 4 and 16 lines in one block, broadcast or not; no lines are kept beside the records."""
    rng = random.Random(seed)
    values = [v for v in VALUES if v] + ["plain"] * 20
    text = ["h1,h2,h3"] + [",".join(rng.choice(values) for _ in range(3)) for _ in range(150)] + ['"' + "more\n" * 20 + '",2,3', 'a,"never closed\n', "b\n"]
    path, scratch = f"{tmpdir_path}/up.csv", f"{tmpdir_path}/scratch"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("\n".join(text))
    monkeypatch.setattr(R, "CHUNK_BITS", bits, raising=False)
    monkeypatch.setattr(R, "BROADCAST_CHUNKS", 0 if seed == 6 else 1000, raising=False)
    rows, rejects = A.read_folder_with_rejects(spark, [path], standardize=False, scratch=scratch)
    want = one_task(spark, path, ["h1", "h2", "h3"])
    assert sorted(repr(tuple(r)) for r in rows.collect()) == want[0] and len(want[0]) > 100
    assert sorted(x.strip("\n") for x in want[1]) == sorted(r.record.strip("\n") for r in rejects.collect())
    assert not (set(os.listdir(scratch)) & {"lines", "functions", "parts", "heads"})


def test_packed_files_are_read(spark, tmpdir_path):
    import gzip

    for i in range(3):
        with gzip.open(f"{tmpdir_path}/{i}.csv.gz", "wt") as f:
            f.write(f'No,Item\n{i},"two\nlines"\n1{i},plain\n')
    rows, rejects = A.read_folder_with_rejects(spark, A.list_files(spark, tmpdir_path, (".csv.gz",)), standardize=False)
    assert sorted((r.No, r.Item) for r in rows.collect()) == sorted([(str(i), "two\nlines") for i in range(3)] + [(f"1{i}", "plain") for i in range(3)])
    assert rejects.count() == 0
