"""Quoted CSV in many blocks against the reader that takes whole files."""

import csv
import io
import random

import pytest

from ebbtide.sources import csv_export, csv_split


def written(rng, rows, ending="\r\n"):
    fields = ["", "plain", "with, comma", 'a "quoted" word', "two\nlines", "x\n\n\ny", '"', '""', '\n"\n', "é\nü", " lead",
              "tail ", ",", 'end"\n', "long " * 30 + "\n" + "line " * 30]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=ending)
    w.writerow(["id", "note", "odd, name"])
    for k in range(rows):
        w.writerow([k, rng.choice(fields) + rng.choice(["", "!"]), rng.choice(fields)])
    return out.getvalue()


@pytest.mark.parametrize("block", ["97", "1k", "1m"])
@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_blocks_give_the_records_of_the_whole_file(spark, tmp_path, block, ending):
    rng = random.Random(11)
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(written(rng, 150, ending), newline="")
    path = str(tmp_path)
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    keys = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = csv_export.read_csv(spark, path)
        tasks = csv_split._lines(spark, path).rdd.getNumPartitions()
        mine = sorted(map(tuple, got.collect()), key=str)
        one = sorted(r[0] for r in got.select("id").collect())
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert got.columns == whole.columns
    assert mine == sorted(map(tuple, whole.collect()), key=str) and len(mine) == 450
    assert one == sorted(r[0] for r in whole.select("id").collect())
    if block == "97":
        assert tasks > 100


@pytest.mark.parametrize(("line", "inside", "after"), [
    ('a,b', False, False), ('a,b', True, True), ('a,"b', False, True), ('a",b', True, False), ('5" pipe,x', False, False),
    ('a,"x ""y"" z', False, True), ('""', False, False), ('""', True, True), ('"', True, False), ('"",""', False, False),
    ('x","y', True, True), ('', True, True), ('', False, False)])
def test_the_state_after_a_line(line, inside, after):
    assert csv_split.ends_inside(line, inside) is after


@pytest.mark.parametrize("bad", ["id,a\n1,2,3\n", "id,a\n1\n"])
def test_ragged_records_fail_the_read(spark, tmp_path, bad):
    (tmp_path / "x.csv").write_text(bad)
    with pytest.raises(Exception):  # noqa: B017
        csv_export.read_csv(spark, str(tmp_path / "x.csv")).select("id").collect()


def test_a_header_alone_and_a_file_without_a_last_line_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n")
    (tmp_path / "b.csv").write_text('id,a\n1,"x\ny"')
    assert csv_export.read_csv(spark, str(tmp_path / "a.csv")).collect() == []
    assert [tuple(r) for r in csv_export.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", "x\ny")]
