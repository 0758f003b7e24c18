"""Reading files that hold one large JSON array, each file by many tasks.

The text reader cuts a file into splits and, at every ``}``, into pieces. Whether a piece starts inside a string, and how
deep, depends on all text before it, so each split is first summed up for both cases (starting inside a string or not):
its quotes, and its change of depth. These sums, one small row per split, carried along the file give the state in which
each split starts. Then every split is cut into its records on its own. Only what lies across the borders of splits is
put together by a shuffle: two pieces of a record per split.

Any file system that Spark reads will do; compressed files are one split. Records come out in the order of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import materialise

ESCAPED = re.compile(rb"\\.", re.DOTALL)
_byte = np.arange(256)
#: What each byte does to the depth, outside strings.
STEP = (np.isin(_byte, list(b"[{")).astype(np.int64) - np.isin(_byte, list(b"]}")).astype(np.int64))
#: The bytes that count: brackets and quotes.
MARKS = (STEP != 0) | (_byte == 34)
#: Characters of a broken part that an error row shows.
SHOWN = 1000


def _text(pieces: pa.Array) -> bytes:
    return b"}".join([*pieces.to_pylist(), b""])


def _marked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where brackets and quotes stand that are not escaped, which they are, and how many quotes there are up to each."""
    plain = np.frombuffer(ESCAPED.sub(b"__", data) if b"\\" in data else data, np.uint8)
    at = np.flatnonzero(MARKS[plain])
    marks = plain[at]
    return at, marks, np.cumsum(marks == 34)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows of the same split."""
    for batch in batches:
        starts, files = batch.column("start").to_numpy(), batch.column("file")
        cuts = [0, *(i for i in range(1, batch.num_rows) if starts[i] != starts[i - 1] or files[i].as_py() != files[i - 1].as_py()), batch.num_rows] if len(set(starts.tolist())) > 1 or len(files.unique()) > 1 else [0, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                yield (part.column("file")[0].as_py(), part.column("start")[0].as_py()), part


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: bytes, quotes, and the change of depth if it starts outside or inside a string."""

    def row(split, total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*split, *total)], names=["file", "start", "size", "bytes", "quotes", "outside", "inside"])

    split, total = None, None
    for key, part in _by_split(batches):
        if split is None or key != split[:2]:
            if split is not None:
                yield row(split, total)
            split, total = (*key, part.column("size")[0].as_py()), [0, 0, 0, 0]
        data = _text(part.column("value"))
        _at, marks, quotes = _marked(data)
        step, inside = STEP[marks], quotes & 1
        odd = int((step * inside).sum())
        even = int(step.sum()) - odd
        turned = total[1] % 2
        total = [total[0] + len(data), total[1] + int(quotes[-1]), total[2] + (odd if turned else even), total[3] + (even if turned else odd)]
    if split is not None:
        yield row(split, total)


class _Cutter:
    """Cuts the text of one split into records. What is before the first border and after the last is kept apart."""

    def __init__(self, quotes: int, depth: int, trim: bool):
        self.quotes, self.depth = quotes, depth
        self.trim, self.last = trim, b""  # the last bracket of a split that does not end with one is held back
        self.held: list[bytes] = []
        self.head: bytes | None = None  # up to the end of the record that an earlier split began
        self.open_ = False  # some record has ended in this split, or the split begins with the array

    def records(self, data: bytes, first: bool) -> list[bytes]:
        if self.trim:
            data = self.last + data
            data, self.last = data[:-1], data[-1:]
        if not data:
            return []
        places, marks, quotes = _marked(data)
        outside = (quotes & 1) == self.quotes
        depth = self.depth + np.cumsum(STEP[marks] * outside)
        ends = places[outside & (marks == 125) & (depth == 1)] + 1
        if len(marks):
            self.quotes, self.depth = int(quotes[-1] + self.quotes) % 2, int(depth[-1])
        out, at = [], 0
        for end in ends.tolist():
            record = b"".join([*self.held, data[at:end]])
            self.held = []
            if self.open_ or first:
                out.append(record)
            else:
                self.head = record
            self.open_, first, at = True, False, end
        if at < len(data):
            self.held.append(data[at:])
        return out


OUT = "file string, start long, kind int, at long, text string"
RECORD, TAIL, HEAD = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split, and its two ends: HEAD ends a record (or is all there is), TAIL begins one."""

    def rows(split, kind, texts, at=0) -> pa.RecordBatch:
        n = len(texts)
        columns = [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["file", "start", "kind", "at", "text"])

    def rest(split, cutter) -> Iterator[pa.RecordBatch]:
        left = b"".join(cutter.held)
        if not cutter.open_:  # no border in this split
            yield rows(split, TAIL, [left])
            return
        if cutter.head is not None:
            yield rows(split, HEAD, [cutter.head])
        if left:
            yield rows(split, TAIL, [left])

    split, cutter, made = None, None, 0
    for key, part in _by_split(batches):
        if key != split:
            if split is not None:
                yield from rest(split, cutter)
            quotes, depth = part.column("before_quotes")[0].as_py(), part.column("before_depth")[0].as_py()
            split, cutter, made = key, _Cutter(quotes % 2, depth, part.column("trim")[0].as_py()), 0
        found = cutter.records(_text(part.column("value")), split[1] == 0)
        if found:
            yield rows(split, RECORD, found, made)
            made += len(found)
    if split is not None:
        yield from rest(split, cutter)


def read_raw_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(position, raw): the records of files that hold one JSON array each, as JSON texts, in order within a file.

    Broken files: the records that are whole come out, and one more row for an array that is not closed or for text after
    it, ``broken: `` with the beginning of what cannot be read. Elements that are no objects come out as they are, with
    what follows up to the end of the next object. None of these is valid JSON.
    """
    pieces = spark.read.schema("value string").option("lineSep", "}").text(path)
    split = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), *split)
    sums = pieces.mapInArrow(_summed, "file string, start long, size long, bytes long, quotes long, outside long, inside long")
    return _records(pieces, sums)


def _records(pieces: DataFrame, sums: DataFrame) -> DataFrame:
    along = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(along), F.lit(0))
    states = sums.withColumn("before_quotes", before("quotes"))
    states = states.withColumn("change", F.when(F.col("before_quotes") % 2 == 0, F.col("outside")).otherwise(F.col("inside")))
    states = states.withColumn("before_depth", before("change"))
    whole = Window.partitionBy("file")
    # a bracket is put after the last piece, too: then there is one byte more than the file has (or 3 fewer where a mark
    # of the byte order was taken off); for compressed files this is not known, and no whole array ends with a bracket
    read = F.sum("bytes").over(whole)
    real = (read == F.col("size")) | (read == F.col("size") - 3)
    states = states.withColumn("last", F.col("start") == F.max("start").over(whole)).withColumn("trim", F.col("last") & ~real)
    states = states.withColumn("rank", F.row_number().over(Window.orderBy("file", "start")))
    # one small row per split
    states = F.broadcast(materialise(states.select("file", "start", "before_quotes", "before_depth", "last", "trim", "rank"), "splits"))
    cut = materialise(pieces.join(states.drop("last", "rank"), ["file", "start"]).mapInArrow(_cut, OUT), "records")
    inside = cut.filter(F.col("kind") == RECORD).select("file", "start", F.lit(1).alias("side"), "at", "text")
    # ends of splits, in order: a record begins with a TAIL and goes on to the next HEAD
    ends = cut.filter(F.col("kind") != RECORD)
    order = Window.partitionBy("file").orderBy("start", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("record", F.coalesce(F.sum((F.col("kind") == HEAD).cast("int")).over(order), F.lit(0)))
    joined = ends.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("kind")).alias("side"), "text"))).alias("parts"),
        F.max("start").alias("start"),
        F.max((F.col("kind") == HEAD).cast("int")).alias("closed"),
    )
    joined = joined.select("file", "start", F.array_join("parts.text", "").alias("text"), "closed")
    spanning = joined.filter("closed = 1").select("file", "start", F.lit(0).alias("side"), F.lit(0).cast("long").alias("at"), "text")
    # what is left at the end of a file has to be the end of the array
    left = joined.filter("closed = 0")
    wrong = left.filter(~F.regexp_replace("text", r"\s", "").isin("]", "[]")).withColumn("text", F.substring("text", 1, SHOWN))
    without = states.filter("last").join(left.select("file"), "file", "left_anti").withColumn("text", F.lit("the array is not closed"))
    faults = wrong.select("file", "start", "text").unionByName(without.select("file", "start", "text"))
    faults = faults.select("file", "start", F.lit(2).alias("side"), F.lit(0).cast("long").alias("at"), F.concat(F.lit("broken: "), "text").alias("text"))
    every = inside.unionByName(spanning).unionByName(faults)
    position = F.shiftleft(F.col("rank").cast("long"), 34) + F.shiftleft(F.col("side").cast("long"), 32) + F.col("at")
    # the bracket that opens the array, or the comma before the record
    raw = F.when(F.col("side") == 2, F.col("text")).otherwise(F.regexp_replace("text", r"^\s*[\[,]\s*", ""))
    return every.join(states.select("file", "start", "rank"), ["file", "start"]).select(raw.alias("raw"), position.alias("position"))
