"""What each of five filters removes, in every order, from a sparse document-term matrix in shards.

Matrix. A task turns about ``SHARD_BYTES`` of text at a time into a shard: the words of its documents, encoded by the
shard's own dictionary, as compressed rows (``indptr``, ``indices``, ``counts``). Each shard sends its words, packed by
parts of a hash space, to the tasks of the global dictionary: a part makes the words of all shards distinct, numbers them
and answers each shard in the order asked, so that no word travels back. The shards are then rewritten to the global
columns, which are numbered without gaps. Row sums and numbers of entries of the rows are the words and distinct words of
the documents, which decide filters A and B. A frequent word is sent once per shard, never once per occurrence; parts
grow in number with the corpus and not in size.

Filters (a document fails): A: under ``LEAST_WORDS`` words; B: fewer than half of its words are distinct; C: more than
3 % of its characters are in A-Z; D: a character of ``#$%&*|``; E: its text is that of a smaller doc_id, removed or not.

Audit. Documents are counted by part and by the set of filters they fail, 32 sets at most, and only these counts meet the
120 orders: a document is removed by the first filter of the order in its set. A filter is first of a set of k in 120 / k
orders, which gives its Shapley value.

Nulls, ties, edges: a null or empty text has no words, and so fails A, and E if there is a smaller id with such a text;
a null lang is the part ''; a null id is larger than all others, and has no labels; of rows with the same id and text
none is smaller; labels hold if any row of the id says so; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import mixed, table, written
from foliant.llm.packing import pack_numbers, unpack_numbers
from foliant.session import materialise

SHARD_BYTES = 4 << 20
#: Bytes of text for each part of the global dictionary.
PART_BYTES = 32 << 20
LEAST_WORDS = 200
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SIGNS = b"#$%&*|"

ROWS = "doc_ids array<bigint>, langs array<string>, texts array<binary>, shouts binary, signs binary"
#: A row of a shard (part -1), or the words that a shard sends to a part, each with a line feed.
LOCAL = f"shard long, part int, words binary, indptr binary, indices binary, counts binary, {ROWS}"
ANSWERS = "shard long, part int, numbers binary, n long"
MATRIX = f"shard long, indptr binary, indices binary, counts binary, {ROWS}"
KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _schema(columns: str) -> pa.Schema:
    kind = lambda k: pa.list_(KINDS[k[6:-1]]) if k.startswith("array<") else KINDS[k]
    return pa.schema([(name, kind(k)) for name, k in (c.split() for c in columns.split(", "))])


def term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and the compressed rows: where each row starts, its words and their counts."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    sizes, words = np.diff(lists.offsets.to_numpy()), lists.flatten()
    owner = np.repeat(np.arange(len(texts)), sizes)
    del lists
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():  # a blank text gives one empty word
        owner, words = owner[real], words.filter(pa.array(real))
    coded = words.dictionary_encode()
    width = max(1, len(coded.dictionary))
    cells, counts = np.unique(owner * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return coded.dictionary, np.searchsorted(cells // width, np.arange(len(texts) + 1)), cells % width, counts


def _per_text(texts: pa.Array, which: np.ndarray) -> np.ndarray:
    """How many bytes of each text are marked in ``which``, a table over all bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    marked = np.append(which.astype(np.uint8)[data], np.uint8(0))
    return np.where(np.diff(offsets) > 0, np.add.reduceat(marked, offsets[:-1] - offsets[0], dtype=np.int64), 0) if len(texts) else np.zeros(0, np.int64)


_byte = np.arange(256)
CAPITALS, HEADS, MARKS = (_byte >= 65) & (_byte <= 90), (_byte & 0xC0) != 0x80, np.isin(_byte, list(SIGNS))


def parts_of(words: pa.Array, parts: int) -> np.ndarray:
    """The part of each word, by a hash of its bytes."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    return (mixed(np.add.reduceat(data * mixed(place + 1), offsets[:-1] - offsets[0])) % np.uint64(parts)).astype(np.int64)


def _sharded(parts: int):
    schema = _schema(LOCAL)

    def made(number: int, held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held)
        texts = pc.fill_null(pa.concat_arrays(rows.column("text").chunks).cast(pa.large_string()), "")
        words, indptr, indices, counts = term_counts(texts)
        # words in the order of their parts, which is the order of the answers
        part = parts_of(words, parts)
        order = np.argsort(part, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        sent = pc.binary_join_element_wise(words.take(pa.array(order)).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cuts))
        ends = np.frombuffer(sent.buffers()[1], np.int64)[cuts] if len(sent) else cuts
        data = (sent.buffers()[2] if len(sent) else None) or pa.py_buffer(b"")
        shouts = 100 * _per_text(texts, CAPITALS) > 3 * _per_text(texts, HEADS)
        signs = _per_text(texts, MARKS) > 0
        keys = [hashlib.sha256(t).digest() for t in texts.cast(pa.large_binary()).to_pylist()]
        packed = [pack_numbers(x) for x in (indptr, place[indices], counts)]
        row = number, -1, None, *packed, rows.column("doc_id").to_pylist(), rows.column("lang").to_pylist(), keys, pack_numbers(shouts), pack_numbers(signs)
        shard = pa.table([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
        asked = [pa.array([number] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([data[ends[p] : ends[p + 1]].to_pybytes() for p in some], pa.binary())]
        asked += [pa.nulls(len(some), f.type) for f in list(schema)[3:]]
        return pa.concat_tables([shard, pa.table(asked, schema=schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                held.append(some)
                size += pc.sum(pc.binary_length(some.column("text"))).as_py() or 0
                if size >= SHARD_BYTES:
                    yield from made(number, held).to_batches()
                    number, held, size = number + 1, [], 0
        if held:
            yield from made(number, held).to_batches()

    return run


def _distinct(rows: pa.Table) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words that a part was sent, and how many each row of it has."""
    data = [x.as_py() for x in rows.column("words")]
    whole = b"".join(data)
    ends = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10) + 1
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(whole)])
    return words.dictionary_encode(), np.searchsorted(ends, np.cumsum([len(x) for x in data]), "right")


def _answered(key: tuple, rows: pa.Table) -> pa.Table:
    """The numbers of the words of each shard within a part, in the order asked."""
    rows = rows.sort_by("shard")
    coded, upto = _distinct(rows)
    numbers = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), upto[:-1])
    columns = [rows.column("shard"), rows.column("part"), pa.array([pack_numbers(x) for x in numbers], pa.binary()), pa.array([len(coded.dictionary)] * rows.num_rows, pa.int64())]
    return pa.table(columns, schema=_schema(ANSWERS))


def _rewritten(key: tuple, shard: pa.Table, answers: pa.Table) -> pa.Table:
    """A shard with the global numbers of its words; the words of a row are then in their order."""
    schema = _schema(MATRIX)
    if not shard.num_rows:
        return schema.empty_table()
    row = shard.to_pylist()[0]
    given = answers.sort_by("part").to_pylist()
    number = np.concatenate([np.zeros(0, np.int64), *(unpack_numbers(a["numbers"]) + a["before"] for a in given)])
    indptr, indices, counts = (unpack_numbers(row[c]) for c in ("indptr", "indices", "counts"))
    columns = number[indices]
    order = np.lexsort((columns, np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))))
    row |= {"indices": pack_numbers(columns[order]), "counts": pack_numbers(counts[order])}
    return pa.table([pa.array([row[f.name]], f.type) for f in schema], schema=schema)


def _starts(answers: DataFrame) -> DataFrame:
    """The number of the first word of each part: one row per part."""
    sizes = answers.groupBy("part").agg(F.first("n").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def matrix(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of (doc_id, text, lang), and its dictionary (term, word).

    The matrix has one row per shard, with compressed rows over global columns: ``indptr``, ``indices`` and ``counts`` are
    packed numbers; beside them are, by row of the shard, the ids and langs of the documents, a digest of the text, and
    whether it fails C (``shouts``) and D (``signs``).
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    if parts is None:
        size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-int(size) // PART_BYTES))
    local = written(some.mapInArrow(_sharded(parts), LOCAL), "shards")
    asked = local.filter("part >= 0").select("shard", "part", "words")
    answers = materialise(asked.groupBy("part").applyInArrow(_answered, ANSWERS), "answers")
    starts = F.broadcast(materialise(_starts(answers), "starts"))
    shards = local.filter("part < 0").drop("part", "words")
    numbers = answers.join(starts, "part").select(F.col("shard").alias("of"), "part", "numbers", "before")

    def listed(key: tuple, rows: pa.Table) -> pa.Table:
        words = _distinct(rows.sort_by("shard"))[0].dictionary.to_pylist()
        return pa.table([pa.array([key[0].as_py()] * len(words), pa.int32()), pa.array(range(len(words)), pa.int64()), pa.array([w[:-1].decode() for w in words], pa.string())], names=["part", "place", "word"])

    dictionary = asked.groupBy("part").applyInArrow(listed, "part int, place long, word string").join(starts, "part")
    rewritten = shards.groupBy("shard").cogroup(numbers.groupBy("of")).applyInArrow(_rewritten, MATRIX)
    return rewritten, dictionary.select((F.col("before") + F.col("place")).alias("term"), "word")


MEASURED = "doc_id long, lang string, key binary, words long, distinct_words long, shouts boolean, signs boolean"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _schema(MEASURED)
    for batch in batches:
        for row in batch.to_pylist():
            indptr, counts = unpack_numbers(row["indptr"]), unpack_numbers(row["counts"])
            sums = np.diff(np.concatenate([[0], np.cumsum(counts)])[indptr])
            flags = [unpack_numbers(row[c]).astype(bool) for c in ("shouts", "signs")]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((row["doc_ids"], row["langs"], row["texts"], sums, np.diff(indptr), *flags), schema, strict=True)], schema=schema)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, and ``fails``: the letters of the filters that each document fails, whatever the order."""
    rows = materialise(matrix(docs)[0].mapInArrow(_measured, MEASURED), "measured")
    copies = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = materialise(copies.select(F.col("key").alias("copied"), "first"), "copies")
    joined = rows.join(copies, F.col("key") == F.col("copied"), "left")
    fails = {
        "A": F.col("words") < LEAST_WORDS,
        "B": 100 * F.col("distinct_words") < 50 * F.col("words"),
        "C": F.col("shouts"),
        "D": F.col("signs"),
        "E": F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("first") < F.col("doc_id"))),
    }
    return joined.select("doc_id", "lang", F.concat(*[F.when(fails[x], x).otherwise("") for x in FILTERS]).alias("fails"))


def audited(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from (doc_id, lang, fails) and labels (doc_id, quality, toxic)."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled"))
    known = materialise(known.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(c) for c in ("quality", "toxic")]), "labels")
    marked = failing.join(known, F.col("doc_id") == F.col("labelled"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    cells = marked.groupBy(F.col("lang").alias("part"), "fails").agg(F.count(F.lit(1)).alias("n"), total("quality"), total("toxic"))
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter, earlier = "substr(filter_order, step, 1)", "substr(filter_order, 1, step - 1)"
    own, before = F.expr(f"instr(fails, {letter}) > 0"), F.expr(f"translate(fails, {earlier}, '') <> fails")
    steps = steps.withColumn("own", own).withColumn("before", before)
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    removed = F.col("own") & ~F.col("before")
    numbers: dict[str, Column] = {
        "kept": count(~F.col("own") & ~F.col("before")),
        "removed": count(removed),
        "redundant": count(F.col("own") & F.col("before")),
        "unique_fails": count(F.col("own") & (F.length("fails") == 1)),
        "good_lost": count(removed, "quality"),
        "toxic_lost": count(removed, "toxic"),
        "shapley": F.sum(F.when(F.col("own"), F.expr(f"n * ({len(ORDERS)} div length(fails))")).otherwise(0)),
    }
    return steps.groupBy("part", "filter_order", "step").agg(*[c.cast("long").alias(name) for name, c in numbers.items()])


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audited(failures(table(spark, folder, "documents").select("doc_id", "text", "lang")), table(spark, folder, "labels"))


SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM words GROUP BY t
), docs AS (
  SELECT doc_id, part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
     regexp_matches(t, '[#$%&*|]'), first IS NOT NULL AND (doc_id IS NULL OR first < doc_id)] AS f
  FROM words JOIN firsts USING (t)
), marked AS (
  SELECT part, f, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM docs LEFT JOIN (
    SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS quality, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id
  ) l ON docs.doc_id = l.doc_id
), cells AS (
  SELECT part, f, count(*) AS n, sum(quality) AS quality, sum(toxic) AS toxic FROM marked GROUP BY part, f
), letter AS (
  SELECT unnest(range(1, 6)) AS i
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), judged AS (
  SELECT part, o, step, f[o[step]] AS own, len(list_filter(o[1:step - 1], lambda x: f[x])) > 0 AS before, len(list_filter(f, lambda x: x)) AS k, n, quality, toxic
  FROM cells, orders, (SELECT i AS step FROM letter)
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (NOT own AND NOT before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT before), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (own AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(quality) FILTER (own AND NOT before), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT before), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(k, 1)) FILTER (own), 0)::BIGINT AS shapley
FROM judged GROUP BY part, o, step
"""
