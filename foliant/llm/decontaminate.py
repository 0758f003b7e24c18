"""Benchmark decontamination: one Aho-Corasick automaton over the normalised item windows, each text scanned once.

A window is ``window`` consecutive words of an item; a shorter item is one window. Texts are normalised to their words
with a blank on either side, so that a window can only match whole words. Matches give word ranges, which are mapped
back to character ranges of the original text.

The automaton is built in each task from item texts of at most ``BLOCK_WORDS`` words, a checked bound. More items than
that are dealt into blocks; each block is one more pass over the texts, and the matches of all blocks are merged.

Nulls, ties, edges: a null, empty or wordless text has no words and no hits, and such an item no window; items with the
same id count as one, an item without an id marks words but is not listed; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, plain_words, table
from foliant.session import materialise

WINDOW = 10
BLOCK_WORDS = 200_000
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "struct<n_words:bigint,words:array<struct<start:int,end:int>>,chars:array<struct<start:int,end:int>>,items:array<string>>"

_built: dict = {}


def automaton(items: list[tuple[str | None, str]], window: int):
    """The automaton of all windows; a pattern holds its number of words and the ids of its items."""
    key = (id(items), window)
    if key not in _built:
        _built.clear()
        patterns: dict[str, tuple[int, set]] = {}
        for name, text in items:
            words = plain_words(text)
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                pattern = (b" " + b" ".join(words[i : i + n]) + b" ").decode("latin-1")
                patterns.setdefault(pattern, (n, set()))[1].add(name)
        built = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            built.add_word(pattern, value)
        built.make_automaton()
        _built[key] = (items, built if patterns else None)  # holds on to the items, so that their id stays theirs
    return _built[key][1]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def scan(text: str | None, built) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged ranges of hit words and ids of the items that occur."""
    words = plain_words(text)
    if not words or built is None:
        return len(words), [], set()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ranges, names, seen, at = [], set(), 0, 0
    for end, (n, items) in built.iter(line):
        seen += line.count(" ", at, end + 1)
        at = end + 1
        last = seen - 1  # words before the blank that ends the match
        if ranges and last - n <= ranges[-1][1]:
            ranges[-1] = (min(ranges[-1][0], last - n), last)
        else:
            ranges.append((last - n, last))
        names |= items
    return len(words), merged(ranges), names


def char_ranges(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    spans = [m.span() for m in WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def scanned(docs: DataFrame, items: list[tuple[str | None, str]], text: str, into: str, window: int) -> DataFrame:
    """One pass over the texts with one block of items; ``into`` may hold the matches of earlier blocks."""
    has = into in docs.columns
    schema = docs.schema if has else docs.withColumn(into, F.lit(None).cast(FOUND)).schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = automaton(items, window)
        for batch in batches:
            earlier = batch.column(into).to_pylist() if has else [None] * batch.num_rows
            out = []
            for value, old in zip(batch.column(text), earlier, strict=True):
                body = value.as_py()
                n, ranges, found = scan(body, built)
                found = {x for x in found if x is not None}
                if old:
                    ranges, found = merged(ranges + [(r["start"], r["end"]) for r in old["words"]]), found | set(old["items"])
                chars = char_ranges(body, ranges) if ranges else []
                as_rows = lambda x: [{"start": a, "end": b} for a, b in x]
                out.append({"n_words": n, "words": as_rows(ranges), "chars": as_rows(chars), "items": sorted(found)})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            column = pa.array(out, pa.struct([("n_words", pa.int64()), ("words", kind), ("chars", kind), ("items", pa.list_(pa.string()))]))
            columns = [column if name == into else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "found") -> DataFrame:
    """``docs`` with ``into``: number of words, ranges of hit words, the same as characters, and the item ids."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    dealt = benchmark.select(F.col("item_id").cast("string").alias("id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    out = docs
    for i in range(blocks):
        items = [(r["id"], r["text"]) for r in dealt.filter(F.col("block") == i).filter(F.col("text").isNotNull()).collect()]
        out = scanned(out, items, text, into, window)
        out = materialise(out, "matches") if blocks > 1 else out
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits per document."""
    found = matches(docs.select("doc_id", "text"), benchmark).select("doc_id", "found.*")
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, whole and unchanged."""
    (found,) = fresh(docs, "found")
    return matches(docs, benchmark, window=window, into=found).filter(F.size(F.col(found)["words"]) == 0).drop(found)


def query(spark, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
