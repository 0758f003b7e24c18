"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

Each turn is a node named by a hash over all turns up to it, so conversations that begin alike share nodes. The nodes
are emitted depth-first into one long sequence of code points. A node carries its offset in that sequence, its position
id (code points before it on its own path) and, through its segment, the intervals of the sequence that its ancestors
occupy and that it may attend to.

A segment is what one conversation adds to the sequence. Conversations are ordered by their path, so the first one
through a node owns it, owned nodes are a suffix of their conversation, and the order of the segments is depth-first.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is put into each ``<|``, and
one more into what already looks so; roles also have their line ends escaped. Both are undone when reading back.

Nulls, ties, edges: a null role or text is empty; a null conversation id is a conversation of its own; a null turn comes
first; rows with the same turn are ordered by role and text and are all kept; equal conversations share all nodes and
have an empty segment each but one; no rows give no output.

A conversation is read in order by one task, as a stream of rows; nothing holds a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import table
from foliant.session import materialise

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Ranks whose lengths are summed by one task.
CHUNK = 10_000
#: Stretches of the sequence, with the segment that each lies in and the depths of its turns.
INTERVALS = "array<struct<start:bigint,end:bigint,owner:bigint,from_depth:bigint,to_depth:bigint>>"
_LIKE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


class Packed(NamedTuple):
    """The output: nodes in the sequence, and a segment for each conversation."""

    nodes: DataFrame
    segments: DataFrame


def escape(text: str) -> str:
    return _LIKE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def formatted(role: str, text: str) -> str:
    return f"{START}{escape_role(role)}\n{escape(text)}{END}\n"


def parsed(turn: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text lies in a formatted turn."""
    assert turn.startswith(START) and turn.endswith(END + "\n")
    line = turn.index("\n")
    start, end = line + 1, len(turn) - len(END) - 1
    return unescape_role(turn[len(START) : line]), unescape(turn[start:end]), start, end


_NONE = object()
TURNS = "conv_id long, depth long, node binary, parent binary, position long, length long, role string, formatted string, loss_start int, loss_end int"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the node of each turn, with its depth and position; rows come by conversation and turn."""
    conv, parent, depth, position = _NONE, None, 0, 0
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for c, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if c != conv or conv is _NONE:
                conv, parent, depth, position = c, None, 0, 0
            role, text = role or "", text or ""
            raw = role.encode()
            node = hashlib.sha256((parent or b"") + len(raw).to_bytes(8, "big") + raw + text.encode()).digest()[:16]
            turn = formatted(role, text)
            start = turn.index("\n") + 1
            end = len(turn) - len(END) - 1
            loss = (start, end) if role == LOSS_ROLE else (0, 0)
            for column, value in zip(out, (c, depth, node, parent, position, len(turn), role, turn, *loss), strict=True):
                column.append(value)
            parent, depth, position = node, depth + 1, position + len(turn)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = "conv_id depth node parent position length role formatted loss_start loss_end".split()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)


def _ranked(turns: DataFrame) -> DataFrame:
    """The place of each conversation in the order of paths: (conv_id, rank).

    A path is written as the nodes where conversations part; between them all of its conversations go the same way.
    """
    through = turns.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    above = through.select(F.col("node").alias("parent"), F.col("n").alias("n_above"))
    narrow = turns.select("conv_id", "depth", "node", "parent")
    counted = narrow.join(through, "node").join(above, "parent", "left")
    parting = counted.filter(F.col("n_above").isNull() | (F.col("n") < F.col("n_above")))
    steps = F.array_sort(F.collect_list(F.struct("depth", F.hex("node").alias("node"))))
    paths = parting.groupBy("conv_id").agg(F.array_join(F.transform(steps, lambda x: x["node"]), "").alias("path"))
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ordered = ordered.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
    ordered = materialise(ordered, "paths")
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return ordered.join(parts, "part").select("conv_id", (F.col("before") + F.col("local")).alias("rank"))


def packed(conversations: DataFrame) -> Packed:
    """Pack rows of (conv_id, turn, role, text)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    turns = materialise(rows.mapInArrow(_chained, TURNS), "turns")
    ranks = materialise(_ranked(turns), "ranks")
    c = ranks.withColumnRenamed("conv_id", "c")
    steps = turns.select("conv_id", "depth", "node", "position", "length").join(c, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    owners = steps.groupBy("node").agg(F.min("rank").alias("owner"))
    steps = materialise(steps.join(owners, "node"), "steps")

    owned = steps.filter(F.col("owner") == F.col("rank")).groupBy("rank").agg(F.sum("length").alias("length"), F.min("position").alias("first"), F.min("depth").alias("top"), F.max("depth").alias("bottom"))
    sizes = ranks.join(owned, "rank", "left").select("conv_id", "rank", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("first", F.lit(0)).alias("first"), "top", "bottom")
    sizes = sizes.withColumn("chunk", F.floor(F.col("rank") / CHUNK))
    chunks = sizes.groupBy("chunk").agg(F.sum("length").alias("total"))
    before = F.sum("total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))  # one row per CHUNK conversations
    chunks = chunks.select("chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(chunks, "chunk")
    starts = materialise(starts.select("conv_id", "rank", "length", "first", "top", "bottom", (F.col("before") + F.col("inside")).alias("start")), "starts")

    by_owner = starts.select(F.col("rank").alias("owner"), F.col("start").alias("owner_start"), F.col("first").alias("owner_first"))
    borrowed = steps.filter(F.col("owner") < F.col("rank")).groupBy("rank", "owner").agg(
        F.min("position").alias("low"), F.max(F.col("position") + F.col("length")).alias("high"), F.min("depth").alias("from_depth"), F.max("depth").alias("to_depth")
    )
    borrowed = borrowed.join(by_owner, "owner")
    shift = F.col("owner_start") - F.col("owner_first")
    interval = F.struct((F.col("low") + shift).alias("start"), (F.col("high") + shift).alias("end"), "owner", "from_depth", "to_depth")
    ancestors = borrowed.groupBy("rank").agg(F.array_sort(F.collect_list(interval)).cast(INTERVALS).alias("ancestors"))
    segments = starts.join(ancestors, "rank", "left").select(
        "conv_id",
        F.col("rank").alias("segment"),
        "start",
        (F.col("start") + F.col("length")).alias("end"),
        F.col("first").alias("position"),
        F.coalesce("ancestors", F.array().cast(INTERVALS)).alias("ancestors"),
        F.col("top").cast("long").alias("from_depth"),
        F.col("bottom").cast("long").alias("to_depth"),
    )
    mine = starts.select(F.col("conv_id").alias("c"), F.col("rank").alias("segment"), (F.col("start") - F.col("first")).alias("shift"))
    nodes = turns.join(owners.withColumnRenamed("node", "n"), F.col("node") == F.col("n"))
    nodes = nodes.join(mine, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("owner") == F.col("segment")))
    nodes = nodes.select("node", "parent", "segment", "depth", (F.col("position") + F.col("shift")).alias("offset"), "position", "length", "role", "formatted", "loss_start", "loss_end")
    return Packed(materialise(nodes, "nodes"), materialise(segments, "segments"))


def unpacked(out: Packed) -> DataFrame:
    """The turns of each conversation, read back from its segment and the intervals it attends to.

    An interval tells the segment that it lies in and the depths of its turns, and a segment has one turn at a depth: the
    turns are found by equality, one row for each turn that is wanted.
    """
    own = F.struct(F.col("start"), F.col("end"), F.col("segment").alias("owner"), "from_depth", "to_depth")
    seen = out.segments.select("conv_id", F.explode(F.filter(F.array_append("ancestors", own), lambda x: x["start"] < x["end"])).alias("seen"))
    wanted = seen.select("conv_id", F.col("seen.owner").alias("segment"), F.explode(F.sequence("seen.from_depth", "seen.to_depth")).alias("depth"))
    rows = wanted.join(out.nodes.drop("parent", "node"), ["segment", "depth"])
    return rows.select("conv_id", "position", "formatted", "loss_start", "loss_end")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, turns, loss, counts = _NONE, None, None, [0, 0, 0]
    done: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if done:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()

    def close() -> None:
        if conv is not _NONE:
            done.append((conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

    for batch in batches:
        for c, turn, start, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if conv is _NONE or c != conv:
                close()
                conv, turns, loss, counts = c, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text, _, _ = parsed(turn)
            turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(turn[start:end])
            loss.update(masked.encode())
            counts = [counts[0] + 1, counts[1] + len(masked), counts[2] + len(turn)]
        yield from flush()
    close()
    yield from flush()


def digests(out: Packed) -> DataFrame:
    rows = unpacked(out).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInArrow(_digested, DIGESTS)


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = rows.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")
    )
    extra = extra.select("conv_id", "x.turn", "x.role", F.lit(tricky).alias("text"))
    return digests(packed(rows.unionByName(extra)))
