"""Highlights: matched words of a text wrapped in ``<em>``, keyed by field."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.functions.paths import bind
from foliant.operators.predicates import And, Compare, Freetext, Not, Or, Predicate, Sub, _present
from foliant.plans.spec import Field, Spec, split_path

# a word as it stands in the text: hyphens and combining marks belong to it
_MARKED = r"[\p{L}\p{M}\p{N}_\-&&[^\p{IsHan}\p{IsHiragana}]]"
WORD_IN_TEXT = (
    r"[\p{IsHan}\p{IsHiragana}]"
    rf"|-*[\p{{L}}\p{{N}}_]{_MARKED}*(?:(?<=\p{{L}})['’.:·](?=\p{{L}}){_MARKED}+|(?<=\p{{N}})[.,;'’](?=\p{{N}}){_MARKED}+)*"
)

# stands for a word while a text is cut into what lies between its words
CUT = "\ue00f"

FRAGMENTS = "array<struct<key:string,value:array<string>>>"

Matcher = Callable[[Column], Column]


def _matcher(p: Compare | Freetext) -> Matcher:
    """From the folded words of a text to an array that tells which of them match."""
    op = "equals" if isinstance(p, Freetext) else p.op
    arg = str(p.value).lower()

    def phrase(words: Column) -> Column:
        wanted = text.analyze(F.lit(arg))
        size = F.size(wanted)
        starts = F.filter(
            F.sequence(F.lit(0), F.size(words)),
            lambda i: (size > 0) & (F.slice(words, i + 1, F.greatest(size, F.lit(1))) == wanted),
        )
        return bind(
            starts,
            lambda found: F.transform(words, lambda _w, i: F.exists(found, lambda s: (s <= i) & (i < s + size))),
        )

    tests: dict[str, Callable[[Column], Column]] = {
        "contains": lambda w: F.contains(w, F.lit(arg)),
        "startswith": lambda w: F.startswith(w, F.lit(arg)),
        "endswith": lambda w: F.endswith(w, F.lit(arg)),
        "gt": lambda w: w > F.lit(arg),
        "gte": lambda w: w >= F.lit(arg),
        "lt": lambda w: w < F.lit(arg),
        "lte": lambda w: w <= F.lit(arg),
    }
    pattern = p.word_pattern() if isinstance(p, Compare) else None
    if pattern:  # the same test that finds the entry
        return lambda words: F.transform(words, lambda w: F.rlike(w, F.lit(f"^(?:{pattern})$")))
    return phrase if op == "equals" else lambda words: F.transform(words, tests[op])


def marked(col: Column, matchers: list[Matcher]) -> Column:
    """The text with matched words in ``<em>``; null when nothing matches."""
    words = F.regexp_extract_all(col, F.lit(f"(?:{WORD_IN_TEXT})"), F.lit(0))
    gaps = F.split(F.regexp_replace(col, f"(?:{WORD_IN_TEXT})", CUT), CUT, -1)

    def hits_of(folded: Column) -> Column:
        found = [m(folded) for m in matchers]
        return functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x | y), found)

    def glue(parts: Column) -> Column:
        own, between, hits = parts.getField("words"), parts.getField("gaps"), parts.getField("hits")
        pieces = F.transform(
            own,
            lambda w, i: F.concat(
                F.get(between, i), F.when(F.get(hits, i), F.concat(F.lit("<em>"), w, F.lit("</em>"))).otherwise(w)
            ),
        )
        whole = F.concat(F.array_join(pieces, ""), F.get(between, F.size(own)))
        return F.when(F.exists(hits, lambda h: h), whole)

    def with_hits(own: Column) -> Column:
        hits = bind(F.transform(own, text.fold), hits_of)
        return bind(F.struct(own.alias("words"), gaps.alias("gaps"), hits.alias("hits")), glue)

    return bind(words, with_hits)


def _leaves(p: Predicate, prefix: str, all_text: list[str]) -> list[tuple[str, Matcher]]:
    if isinstance(p, (And, Or, Not)):
        return [x for item in p.items for x in _leaves(item, prefix, all_text)] if not isinstance(p, Not) else []
    if isinstance(p, Sub):
        return _leaves(p.inner, f"{prefix}{p.path}.", all_text)
    if isinstance(p, Compare):
        return [(prefix + p.path, _matcher(p))]
    if isinstance(p, Freetext):
        return [(path, _matcher(p)) for path in all_text if path.startswith(prefix)]
    return []


def _fragments(root: Column, fields: dict[str, Field], parts: list, key: Column, matchers: list[Matcher], positions: bool) -> Column:
    """(key, fragments) of one text field, one entry per position when ``positions`` is set."""
    f = fields[parts[0]]
    col = root.getField(parts[0])
    here = F.concat(key, F.lit(parts[0]))
    if len(parts) > 1 and f.collection:

        def element(x: Column, i: Column) -> Column:
            at = F.concat(here, F.lit("["), i.cast("string"), F.lit("]")) if positions else here
            return _fragments(x, f.fields, parts[1:], F.concat(at, F.lit(".")), matchers, positions)

        return F.coalesce(F.flatten(F.transform(col, element)), F.array().cast(FRAGMENTS))
    if len(parts) > 1:
        return _fragments(col, f.fields, parts[1:], F.concat(here, F.lit(".")), matchers, positions)
    texts = F.transform(col, lambda x: marked(x, matchers)) if f.collection else F.array(marked(col, matchers))
    kept = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array(F.struct(here.alias("key"), kept.alias("value")))).otherwise(
        F.array().cast(FRAGMENTS)
    )


def highlight(df: DataFrame, predicate: Predicate | None, spec: Spec, positions: bool = False, name: str = "highlight") -> DataFrame:
    """Add a map from field to highlighted texts, for the text fields the predicate names (all of them for freetext).

    With ``positions`` the keys tell which array elements matched (``a[2].b[0].c``). The map is null when nothing
    matched or there is no predicate. Meant for the rows of a page.
    """
    if predicate is None:
        return df.withColumn(name, F.lit(None).cast("map<string,array<string>>"))
    fields = _present(spec.fields, df.schema["entry"].dataType)
    texts = [path for path, f in spec.with_fields(fields).leaves() if f.is_text]
    by_path: dict[str, list[Matcher]] = {}
    for path, matcher in _leaves(predicate, "", texts):
        if path in texts:
            by_path.setdefault(path, []).append(matcher)
    if not by_path:
        return df.withColumn(name, F.lit(None).cast("map<string,array<string>>"))
    found = F.flatten(
        F.array(*[_fragments(F.col("entry"), fields, split_path(p), F.lit(""), ms, positions) for p, ms in by_path.items()])
    )

    def as_map(rows: Column) -> Column:
        if positions:
            made = F.map_from_entries(rows)
        else:
            # the elements of one field share its key
            def merged(key: Column) -> Column:
                same = F.filter(rows, lambda e: e.getField("key") == key)
                return F.struct(key.alias("key"), F.flatten(F.transform(same, lambda e: e.getField("value"))).alias("value"))

            made = F.map_from_entries(F.transform(F.array_distinct(F.transform(rows, lambda e: e.getField("key"))), merged))
        return F.when(F.size(rows) > 0, made)

    return df.withColumn(name, bind(found, as_map))
