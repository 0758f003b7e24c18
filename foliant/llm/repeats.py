"""Exact removal of repeated byte strings, by bucket-pointer refinement of the suffixes that may repeat.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Which strings
repeat is found as in the construction of a suffix array: suffixes that agree on q bytes share a bucket, and buckets are
refined by the buckets of later offsets (q + q bytes, then the rest of ``LENGTH``), which are themselves refined ones.
A bucket's name is a 64-bit hash of what its suffixes agree on, so that every task names it alike and a refined name is
made from two names; names are sorted to bring the suffixes of a bucket together. (Different strings of one name would
need equal 64-bit hashes; of n names about n^2 / 2^65 pairs do.) Three rounds keep the suffixes few:

1. Texts are cut into phrases where their content says so. All strings that start in a phrase lie in the phrase and the
   bytes after it; where an earlier document has the same ones, they all repeat, and nothing else need be known of them.
2. In the other phrases each string is bucketed by the least of its ``GRAM``-byte names. A string that repeats has the
   same one elsewhere, so buckets of a single document are dropped. Neighbouring strings mostly share their bucket.
3. The strings that are left are refined to their full length.

Each round is the same exchange: a batch of documents sends each distinct name once, packed by part of the hash space; a
part sorts its names and answers each batch in the order asked. Batches and parts grow in number with the input, not in
size, and a name that occurs everywhere is one entry per batch. Texts are written once, bucketed by batch, and are not
shuffled: each round reads them where they lie.

Nulls, ties, edges: a null text is empty; a null id comes after all others; rows with the same id have no smaller id
among them; texts shorter than ``LENGTH`` bytes lose nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import mixed, table
from foliant.llm.packing import by_part, pack_keys, pack_numbers, unpack_keys, unpack_numbers
from foliant.session import materialise, new_folder

LENGTH = 50
#: Bytes that the first buckets agree on.
GRAM = 24
#: A phrase ends where the name of the next bytes falls into one of so many classes, or after so many strings.
CUT_BYTES, CUT_CLASSES, LONGEST = 8, 64, 512
BATCH_BYTES = 8 << 20
#: Bytes that are worked on at once inside a batch.
SLICE = 1 << 19
LAST = np.iinfo(np.int64).max

_BASE = 0xD6E8FEB86659FD93
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) <= n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


class Slice:
    """Some documents of a batch in a row, with the names of their substrings."""

    def __init__(self, data: list[bytes], first: int):
        self.first, self.count = first, len(data)
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.lengths = np.array([len(d) for d in data])
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        n = len(self.bytes)
        power, self.back = _power_tables(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.bytes] * power[:n], out=self.sums[1:])
        # strings of LENGTH bytes start here
        self.valid = np.zeros(n + 1, np.int32)
        some = self.lengths >= LENGTH
        np.add.at(self.valid, self.starts[some], 1)
        np.add.at(self.valid, self.ends[some] - LENGTH + 1, -1)
        self.valid = np.cumsum(self.valid)[:-1].astype(bool)

    def names(self, length: int) -> np.ndarray:
        """The name of the substring of ``length`` bytes from each place on; 0 beyond the end."""
        out = np.zeros(len(self.bytes), np.uint64)
        n = len(self.bytes) - length + 1
        if n > 0:
            np.subtract(self.sums[length:], self.sums[:n], out=out[:n])
            out[:n] *= self.back[:n]
        return out

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First place, end, document in the batch, and name of each phrase."""
        some = self.lengths >= LENGTH
        cut = (mixed(self.names(CUT_BYTES)) % np.uint64(CUT_CLASSES) == 0) & self.valid
        cut[self.starts[some]] = True
        starts = np.flatnonzero(cut)
        doc = np.searchsorted(self.ends, starts, "right")
        ends = np.minimum(np.append(starts[1:], len(self.bytes)), self.ends[doc] - LENGTH + 1)
        pieces = -(-(ends - starts) // LONGEST)
        if (pieces > 1).any():
            of = np.repeat(np.arange(len(starts)), pieces)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, last, doc = starts[of] + nth * LONGEST, ends[of], doc[of]
            ends = np.minimum(starts + LONGEST, last)
        stop = ends + LENGTH - 1
        names = mixed((self.sums[stop] - self.sums[starts]) * self.back[starts]) + (ends - starts).astype(np.uint64)
        return starts, ends, doc + self.first, mixed(names)

    def fill(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """True at the places of the given phrases."""
        steps = np.zeros(len(self.bytes) + 1, np.int32)
        steps[starts] += 1
        np.add.at(steps, ends, -1)
        return np.cumsum(steps)[:-1].astype(bool)

    def gram_ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of the first buckets, and what they are ordered by (never 0, and never the top value)."""
        names = mixed(self.names(GRAM))
        return names, np.clip(names >> np.uint64(32), 1, (1 << 32) - 2).astype(np.uint32)

    def refined(self, places: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Bucket names of the full length at some places, each made from two names of later offsets."""
        combine = lambda a, b: mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)
        twice = lambda p: combine(grams[p], grams[p + GRAM])
        return combine(twice(places), twice(places + LENGTH - 2 * GRAM))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest of each ``width`` values from a place on; shorter at the end."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        longer = out.copy()
        pick(out[:-step], out[step:], out=longer[:-step])
        out, have = longer, have + step
    return out


REACH = LENGTH - GRAM + 1


def _anchors(s: Slice, wanted: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least order of each wanted string's grams (0 elsewhere), and the places of the grams that are one."""
    least = np.where(wanted, _sliding(order, REACH, np.minimum), np.uint32(0))
    over = _sliding(least[::-1], REACH, np.maximum)[::-1]  # the greatest among the strings that a gram lies in
    return least, np.flatnonzero(over == order)


def _open_strings(least: np.ndarray, order: np.ndarray, anchors: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Places of the wanted strings whose bucket holds several documents."""
    kept = np.full(len(order), np.iinfo(np.uint32).max, np.uint32)
    at = anchors[shared]
    kept[at] = order[at]
    return np.flatnonzero((_sliding(kept, REACH, np.minimum) == least) & (least > 0))


class Batch:
    """The documents of a batch, in slices. Names are asked in the order of their hashes, so the order of rows is free."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column("doc_id").to_pylist()
        self.order = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.data = [d or b"" for d in rows.column("data").to_pylist()]

    def slices(self) -> Iterator[Slice]:
        some, size, first = [], 0, 0
        for i, d in enumerate(self.data):
            if some and size + len(d) > SLICE:
                yield Slice(some, first)
                some, size, first = [], 0, i
            some.append(d)
            size += len(d)
        if some:
            yield Slice(some, first)


def _asked(names: list[np.ndarray], docs: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names by part, the place of each given name among them, and the least and greatest document of each."""
    flat, owner = np.concatenate([*names, np.empty(0, np.uint64)]), np.concatenate([*docs, np.empty(0, np.int64)])
    distinct, at = by_part(flat, parts)
    least, most = np.full(len(distinct), LAST), np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, at, owner)
    np.maximum.at(most, at, owner)
    return distinct, at, least, most


class Rounds:
    """What a batch asks and learns, round by round; all of it follows from the texts and the answers so far."""

    def __init__(self, batch: Batch, parts: int, answers: list[np.ndarray]):
        self.batch, self.parts, self.answers = batch, parts, answers

    def phrases(self):
        cut = [s.phrases() for s in self.batch.slices()]
        return cut, _asked([c[3] for c in cut], [self.batch.order[c[2]] for c in cut], self.parts)

    def first(self) -> Iterator[tuple[Slice, np.ndarray, np.ndarray]]:
        """Each slice with the strings that are known to repeat and those that are not decided."""
        cut, (_, at, least, _) = self.phrases()
        known = (least - self.answers[0])[at] if len(at) else at
        done = 0
        for s, (starts, ends, doc, _) in zip(self.batch.slices(), cut, strict=True):
            repeats = known[done : done + len(starts)] < self.batch.order[doc]
            done += len(starts)
            yield s, s.fill(starts[repeats], ends[repeats]), s.fill(starts[~repeats], ends[~repeats])

    def grams(self):
        names, docs = [], []
        for s, _, wanted in self.first():
            grams, order = s.gram_ranks()
            _, anchors = _anchors(s, wanted, order)
            names.append(grams[anchors])
            docs.append(self.batch.order[s.first + np.searchsorted(s.ends, anchors, "right")])
        return _asked(names, docs, self.parts)

    def second(self) -> Iterator[tuple[Slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Each slice with its known repeats, and place and name of the strings that remain."""
        _, at, _, _ = self.grams()
        shared = self.answers[1].astype(bool)[at] if len(at) else at.astype(bool)
        done = 0
        for s, repeats, wanted in self.first():
            grams, order = s.gram_ranks()
            least, anchors = _anchors(s, wanted, order)
            places = _open_strings(least, order, anchors, shared[done : done + len(anchors)])
            done += len(anchors)
            yield s, repeats, places, s.refined(places, grams)

    def strings(self):
        found = list(self.second())
        docs = [self.batch.order[s.first + np.searchsorted(s.ends, places, "right")] for s, _, places, _ in found]
        return found, docs, _asked([names for *_, names in found], docs, self.parts)


ASKED = "batch long, part long, names binary, base long, values binary"
ANSWER = "batch long, part long, round int, values binary"


def _sent(batch: int, parts: int, names: np.ndarray, values: np.ndarray) -> pa.Table:
    part = names % np.uint64(parts)
    every, starts = np.unique(part, return_index=True)
    out = []
    for p, a, b in zip(every, starts, np.append(starts[1:], len(names)), strict=True):
        base = int(values[a:b].min())
        out.append((batch, int(p), pack_keys(names[a:b], parts), base, pack_numbers((values[a:b] - base).astype(np.uint64))))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["batch", "part", "names", "base", "values"])


def _received(rows: pa.Table, part: int, parts: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the batches' lists, all names, their values, and for each the place of its name among the sorted ones."""
    lists = [unpack_keys(x, part, parts) for x in rows.column("names").to_pylist()]
    values = np.concatenate([unpack_numbers(v) + b for v, b in zip(rows.column("values").to_pylist(), rows.column("base").to_pylist(), strict=True)])
    distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
    return [len(x) for x in lists], distinct, values, at


def _reply(rows: pa.Table, number: int, values: np.ndarray, lengths: list[int]) -> pa.Table:
    packed = [pack_numbers(v.astype(np.uint64)) for v in np.split(values, np.cumsum(lengths)[:-1])]
    columns = [pa.array([number] * len(packed), pa.int32()), pa.array(packed, pa.binary())]
    return pa.table([rows.column("batch"), rows.column("part"), *columns], names=["batch", "part", "round", "values"])


def _least(number: int, parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """How far the least document of each name lies before the batch's own; mostly 0, which packs to little."""
        lengths, distinct, values, at = _received(rows, key[0].as_py(), parts)
        least = np.full(len(distinct), LAST)
        np.minimum.at(least, at, values)
        return _reply(rows, number, values - least[at], lengths)

    return run


def _shared(number: int, parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Whether a name occurs in several documents: of several batches, or of one that says so."""
        lengths, distinct, values, at = _received(rows, key[0].as_py(), parts)
        several = (np.bincount(at, minlength=len(distinct)) > 1) | (np.bincount(at, values, len(distinct)) > 0)
        return _reply(rows, number, several[at].astype(np.int64), lengths)

    return run


def _answers(rows: pa.Table) -> list[np.ndarray]:
    """The answers of each round so far, in the order of the names asked."""
    rows = rows.sort_by([("round", "ascending"), ("part", "ascending")])
    rounds: list[list[np.ndarray]] = [[], [], []]
    for number, values in zip(rows.column("round").to_pylist(), rows.column("values").to_pylist(), strict=True):
        rounds[number].append(unpack_numbers(values))
    return [np.concatenate([*r, np.empty(0, np.int64)]) for r in rounds]


def _ask_phrases(parts: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        _, (names, _, least, _) = Rounds(Batch(rows), parts, []).phrases()
        return _sent(key[0].as_py(), parts, names, least)

    return run


def _ask_grams(parts: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        names, _, least, most = Rounds(Batch(rows), parts, _answers(answers)).grams()
        return _sent(key[0].as_py(), parts, names, (least < most).astype(np.int64))

    return run


def _ask_strings(parts: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, (names, _, least, _) = Rounds(Batch(rows), parts, _answers(answers)).strings()
        return _sent(key[0].as_py(), parts, names, least)

    return run


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def _removed(parts: int):
    def run(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = Batch(rows)
        rounds = Rounds(batch, parts, _answers(answers))
        found, docs, (_, at, least, _) = rounds.strings()
        known = (least - rounds.answers[2])[at] if len(at) else at
        out, done = [], 0
        for (s, repeats, places, _), own in zip(found, docs, strict=True):
            later = known[done : done + len(places)] < own
            done += len(places)
            repeats[places[later]] = True
            steps = np.zeros(len(s.bytes) + 1, np.int32)
            starts = np.flatnonzero(repeats)
            steps[starts] += 1
            steps[starts + LENGTH] -= 1
            gone = np.cumsum(steps)[:-1] > 0
            for i in range(s.count):
                own_gone = gone[s.starts[i] : s.ends[i]]
                data = batch.data[s.first + i]
                n = int(own_gone.sum())
                kept = s.bytes[s.starts[i] : s.ends[i]][~own_gone].tobytes() if n else data
                edges = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0)) if n else []
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                out.append((batch.ids[s.first + i], len(data), n, len(spans), hashlib.sha256(kept).hexdigest(), spans))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number batches of about ``BATCH_BYTES`` within each task."""
    number, size = TaskContext.get().partitionId() << 24, 0
    for rows in batches:
        numbers = []
        for length in pc.binary_length(rows.column("data")).to_pylist():
            if size and size + (length or 0) > BATCH_BYTES:
                number, size = number + 1, 0
            size += length or 0
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), rows.column("doc_id"), rows.column("data")], names=["batch", "doc_id", "data"])


def batched(docs: DataFrame, parts: int) -> DataFrame:
    """The documents in a table bucketed by batch, so that no later round moves them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("data"))
    name = f"repeats_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(_batched, "batch long, doc_id long, data binary").write.format("parquet")
    writer.option("path", new_folder(spark, "repeats")).bucketBy(parts, "batch").saveAsTable(name)
    return spark.table(name)


def removed_spans(docs: DataFrame) -> DataFrame:
    """For each row of (doc_id, text): the byte ranges to remove, and a digest of what is left."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // BATCH_BYTES))
    rows = batched(docs, parts)
    asked = rows.groupBy("batch").applyInArrow(_ask_phrases(parts), ASKED)
    answers = materialise(asked.groupBy("part").applyInArrow(_least(0, parts), ANSWER), "phrases")
    asked = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask_grams(parts), ASKED)
    answers = answers.unionByName(materialise(asked.groupBy("part").applyInArrow(_shared(1, parts), ANSWER), "grams"))
    asked = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask_strings(parts), ASKED)
    answers = answers.unionByName(materialise(asked.groupBy("part").applyInArrow(_least(2, parts), ANSWER), "strings"))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_removed(parts), REMOVED)


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = removed_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
