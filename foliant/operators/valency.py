"""Concrete variants of valency patterns such as ``ngn (snabbt/långsamt) [caps till/mot ngt]``."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How patterns are spaced before they are read, applied in order.
SPACING = [
    (r"\[caps /", "/[caps "),
    (r" {2,}", " "),
    (r" \] ?", "] "),
    (r" ?/ ?", "/"),
    (r"\[caps ([()])\]", "$1"),
]
CLOSES = {")": "(", "]": "["}
_TAG = re.compile(r"(\w+) (?=.)", re.DOTALL)


def cleanup(col: Column) -> Column:
    """Spacing around brackets and slashes put in order."""
    for pattern, replacement in SPACING:
        col = F.regexp_replace(col, pattern, replacement)
    return col


@dataclass
class Choice:
    """Alternatives that a slash separates; ``number`` is the place of the decision among those of the pattern."""

    alternatives: list[list]
    number: int = -1


@dataclass
class Group:
    """What a pair of brackets holds; ``tag`` is the word that a square bracket begins with."""

    opening: str
    closing: str
    tag: str
    parts: list
    start: int


def _grouped(pattern: str) -> list:
    """Characters and groups. Brackets without a partner, without content or, if square, without a tag are characters."""
    open_: list[tuple[str, int, list]] = [("", -1, [])]
    for at, char in enumerate(pattern):
        if char in "([":
            open_.append((char, at, []))
        elif char in CLOSES:
            opening, start, units = open_[-1]
            tag = _TAG.match("".join(u if isinstance(u, str) else "\0" for u in units)) if opening == "[" else None
            whole = opening == CLOSES[char] and units and not any(u in "()[]" for u in units if isinstance(u, str))
            if whole and (opening == "(" or tag):
                open_.pop()
                length = len(tag[0]) if tag else 0
                open_[-1][2].append(Group(opening, char, tag[0] if tag else "", units[length:], start))
            else:
                units.append(char)
                while len(open_) > 1:  # what is open now never closes
                    opening, _, units = open_.pop()
                    open_[-1][2].extend([opening, *units])
        else:
            open_[-1][2].append(char)
    while len(open_) > 1:
        opening, _, units = open_.pop()
        open_[-1][2].extend([opening, *units])
    return open_[0][2]


def _chosen(units: list) -> list:
    """Runs without a space or an open bracket become choices where a slash stands inside them."""
    out: list = []
    run: list = []
    for unit in [*units, " "]:
        if not isinstance(unit, str) or unit not in " ()[]":
            run.append(unit)
            continue
        if "/" in run[1:-1]:
            alternatives: list[list] = [[]]
            for u in run:
                if u == "/":
                    alternatives.append([])
                else:
                    alternatives[-1].append(u)
            out.append(Choice(alternatives))
        else:
            out.extend(run)
        run = []
        out.append(unit)
    return out[:-1]


def _groups(units: list) -> list[Group]:
    found = []
    for unit in units:
        if isinstance(unit, Group):
            found += [unit, *_groups(unit.parts)]
    return found


def _read(pattern: str) -> tuple[list, list[Choice]]:
    """The tree of a pattern and its decisions, the slowest first.

    Decisions are taken from the inside out: of the groups that hold no undecided one the leftmost, round before square,
    and those outside of all groups last.
    """
    units = _grouped(pattern)
    waiting = _groups(units)
    inner = {id(g): {id(x) for x in _groups(g.parts)} for g in waiting}
    decisions: list[Choice] = []

    def decide(parts: list) -> list:
        chosen = _chosen(parts)
        decisions.extend(x for x in chosen if isinstance(x, Choice))
        return chosen

    while waiting:
        undecided = {id(g) for g in waiting}
        free = [g for g in waiting if not inner[id(g)] & undecided]
        group = min(free, key=lambda g: (g.opening == "[", g.start))
        group.parts = decide(group.parts)
        waiting = [g for g in waiting if g is not group]
    tree = decide(units)
    for number, choice in enumerate(decisions):
        choice.number = number
    return tree, decisions


def _written(parts: list, picks: tuple[int, ...]) -> str:
    out = []
    for part in parts:
        if isinstance(part, Choice):
            out.append(_written(part.alternatives[picks[part.number]], picks))
        elif isinstance(part, Group):
            out.append(f"{part.opening}{part.tag}{_written(part.parts, picks)}{part.closing}")
        else:
            out.append(part)
    return "".join(out)


def variants(pattern: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """The variants of a cleaned pattern with the numbers from ``start`` up to ``end``, in the order of their decisions.

    A number stands for one choice at each decision, as its digits would with the alternatives as bases.
    """
    return _numbered(*_read(pattern), start, end)


def _numbered(tree: list, decisions: list[Choice], start: int, end: int | None) -> Iterator[str]:
    sizes = [len(c.alternatives) for c in decisions]
    for number in range(start, math.prod(sizes) if end is None else end):
        picks = []
        for size in reversed(sizes):
            number, pick = divmod(number, size)
            picks.append(pick)
        yield _written(tree, tuple(reversed(picks))).replace("_", " ")


def count(cleaned: str) -> int:
    """How many variants a cleaned pattern has; none if there is nothing to choose."""
    decisions = _read(cleaned)[1]
    return math.prod(len(c.alternatives) for c in decisions) if decisions else 0


ROWS_PER_FRAME = 10_000
#: Variants of a pattern that are written by one task.
RANGE = 1 << 16


def expand_patterns(df: DataFrame, keys: list[str], col: str, numbers: int = RANGE) -> DataFrame:
    """One row per variant: ``keys``, ``position``, ``variant``.

    Variants are numbered. Patterns with few are worked off where they lie. Of others, ranges of at most ``numbers``
    variants are dealt to all tasks, and every range is written on its own. A pattern with n slashes has 2^n at most.
    """
    source = df.select(*keys, cleanup(F.col(col)).alias("_cleaned"))
    # patterns without anything to choose have no variants
    slashes = F.length("_cleaned") - F.length(F.replace("_cleaned", F.lit("/"), F.lit("")))
    few = math.log2(numbers)
    whole = source.filter((slashes > 0) & (slashes <= few)).withColumns({"_start": F.lit(0).cast("long"), "_end": F.lit(None).cast("long")})
    names = [*keys, "_cleaned", "_start", "_end"]

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own in frame.itertuples(index=False, name=None):
                n = count(own[-1])
                starts = iter(range(0, n, numbers))
                while some := list(itertools.islice(starts, ROWS_PER_FRAME)):
                    yield pd.DataFrame([(*own, a, min(n, a + numbers)) for a in some], columns=names)

    dealt = source.filter(slashes > few).mapInPandas(ranges, T.StructType([*source.schema.fields, T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())]))
    # by number and pattern, so that the ranges of one pattern go to different tasks
    dealt = dealt.repartition("_start", "_cleaned")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("position", T.LongType()), T.StructField("variant", T.StringType())])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = [*keys, "position", "variant"]
        rows: list[tuple] = []
        for frame in frames:
            held = frame[keys].itertuples(index=False, name=None)
            for own, cleaned, start, end in zip(held, frame["_cleaned"], frame["_start"], frame["_end"], strict=True):
                tree, decisions = _read(cleaned)
                if not decisions:
                    continue
                for i, v in enumerate(_numbered(tree, decisions, int(start), None if pd.isna(end) else int(end)), int(start)):
                    rows.append((*own, i, v))
                    if len(rows) >= ROWS_PER_FRAME:
                        yield pd.DataFrame(rows, columns=out)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=out)

    return whole.mapInPandas(work, schema).unionByName(dealt.mapInPandas(work, schema))
