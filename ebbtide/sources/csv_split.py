"""Records of quoted CSV files whose fields may hold line breaks, read in as many tasks as blocks.

A line break ends a record only outside quotes, and whether a line starts inside quotes depends on all
lines before it. But a line only maps one of two states to another, whatever the state is, and such maps
compose: a first pass takes the map of every block of a file on its own, the maps of successive blocks
then give the state at the start of each block (a row per block on the driver, as the planner has
them too), and a second pass cuts each block at its true record ends. Only a record that runs across a
block border is put together by a shuffle, from one piece per block.

Quotes open a field only at its start and are doubled inside it, as in the files of most exporters.
Empty lines between records are no records. The header must lie in the first block of its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ends_inside(line: str, inside: bool, comma: str = ",") -> bool:
    """Whether the end of `line` lies inside quotes, given whether its start does."""
    if not inside and '"' not in line:
        return False
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                inside, at = True, at + 1
            else:
                at = line.find(comma, at)
                if at < 0:
                    return False
                at += 1
                continue
        at = line.find('"', at)
        if at < 0:
            return True
        if line[at + 1:at + 2] == '"':
            at += 2
            continue
        inside = False
        at = line.find(comma, at + 1)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path, lineSep="\n")
    return text.select("value", F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of lines of one block; a batch holds lines of a few blocks, in order."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    values = batch.column("value").to_pylist()
    start = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or (files[k], blocks[k]) != (files[start], blocks[start]):
            yield files[start], blocks[start], [v[:-1] if v.endswith("\r") else v for v in values[start:k]]
            start = k


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block: the states at its end if it starts outside and inside quotes, and whether a
    record that is open at its start ends in it."""
    at, state = None, [False, True, False]
    rows = []
    for batch in batches:
        for file, block, lines in _blocks(batch):
            if (file, block) != at:
                if at:
                    rows.append((*at, *state))
                at, state = (file, block), [False, True, False]
            for line in lines:
                state[0] = ends_inside(line, state[0])
                state[1] = ends_inside(line, state[1])
                state[2] = state[2] or not state[1]
    if at:
        rows.append((*at, *state))
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
        zip(*rows, strict=True) if rows else [[]] * 5,
        (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)],
        ["file", "block", "out", "inn", "closes"])


def _starts(maps: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each block: whether it starts inside quotes, the block in which the record that is open at its
    start began, and the one in which the record that is open at its end began."""
    found: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, inside, owner = None, False, 0
    for m in sorted(maps, key=lambda m: (m["file"], m["block"])):
        if m["file"] != file:
            file, inside, owner = m["file"], False, m["block"]
        head = owner if inside else m["block"]
        tail = head if inside and not m["closes"] else m["block"]
        found[file, m["block"]] = inside, head, tail
        inside, owner = (m["inn"] if inside else m["out"]), tail
    return found


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files at `path` but their headers, as text in column `record`."""
    lines = _lines(spark, path)
    maps = lines.mapInArrow(_maps, "file string, block long, out boolean, inn boolean, closes boolean").collect()
    starts = spark.sparkContext.broadcast(_starts(maps))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, head, first = None, False, True, False
        open_: list[str] = []

        def piece() -> tuple:
            """What is open where a block ends."""
            return (at[0], starts.value[at][1 if head else 2], at[1], "\n".join(open_))

        for batch in batches:
            rows: list[tuple] = []
            for file, block, lines in _blocks(batch):
                if (file, block) != at:
                    if open_:
                        rows.append(piece())
                    at, open_ = (file, block), []
                    inside = head = starts.value[at][0]
                    first = block == 0
                for line in lines:
                    inside = ends_inside(line, inside)
                    open_.append(line)
                    if inside:
                        continue
                    if head:  # the end of a record of an earlier block
                        rows.append(piece())
                        head = False
                    elif first:
                        first = False
                    elif line or len(open_) > 1:
                        rows.append((None, None, None, "\n".join(open_)))
                    open_ = []
            yield _table(rows)
        if open_:
            if first:
                raise ValueError(f"the header of {at[0]} does not end in its first block")
            yield _table([piece()])

    found = lines.mapInArrow(cut, "file string, owner long, block long, record string")
    pieces = found.filter("file IS NOT NULL").groupBy("file", "owner").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"))
    return found.filter("file IS NULL").select("record").union(pieces.select("record"))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
        columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
        ["file", "owner", "block", "record"])
