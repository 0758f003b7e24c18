"""Line dedup by winnowing: runs of lines that occur earlier are deleted. Built-in expressions only.

Each window of ``LINES`` consecutive lines selects the least of its line hashes. Two equal runs of that many lines have
the same window and so the same selected hash: no repeated run is missed, and neighbouring windows mostly select the
same line. Selected hashes that occur once in the corpus need no further look. Where one occurs again, the windows that
selected it are joined by their position around it: windows of equal lines form a class, whose first place (document,
line) is kept and whose later places are matches. Matches extend both ways by the neighbouring windows that match too,
so a run is deleted as far as it repeats earlier lines. Fewer lines that hold ``LONG`` words or more together are a window
of their own.

Documents are ordered by id, lines by number. Within a document only places that do not overlap the first one are later.
Lines are compared without blanks around them; blank lines are not counted and stay, unless runs are deleted on both sides
of them as one.

Nulls, ties, edges: a null text has no lines; a null id comes first; rows with the same id and text are one document and
treated alike; other rows with the same id are ordered by a hash of their text. Where the documents have columns of the
names of the counts, the counts get an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import fresh, table
from foliant.session import materialise

LINES = 3
LONG = 50


def _kept_lines(lines: Column, removed: Column) -> Column:
    """The lines that are not in the sorted array ``removed``, cut out between its runs."""
    starts, ends = _runs(removed)
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(starts)),
        lambda j: F.slice(lines, F.when(j == 0, 1).otherwise(F.get(ends, j - 1) + 2), F.coalesce(F.get(starts, j), F.size(lines)) - F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1)),
    )
    return F.flatten(pieces)


def _runs(removed: Column) -> tuple[Column, Column]:
    """First and last numbers of the runs of consecutive numbers in a sorted array."""
    starts = F.filter(removed, lambda x, i: (i == 0) | (F.coalesce(F.get(removed, i - 1), F.lit(-9)) != x - 1))
    ends = F.filter(removed, lambda x, i: F.coalesce(F.get(removed, i + 1), F.lit(-9)) != x + 1)
    return starts, ends


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, lines): number, hash and number of words of the lines that are not blank; one row per document."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    trimmed = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("number"), F.trim(x).alias("line")))
    some = F.filter(trimmed, lambda x: x["line"] != "")
    hashed = F.transform(some, lambda x: F.struct(x["number"], F.xxhash64(x["line"]).alias("hash"), words(x["line"]).alias("words")))
    rows = docs.filter("text is not null").select(F.col("doc_id"), F.xxhash64("text").alias("digest"), hashed.alias("lines"))
    return rows.filter(F.size("lines") > 0).dropDuplicates(["doc_id", "digest"])


def _later(places: DataFrame, keys: list[str], span: int) -> DataFrame:
    """The places of each class that come after its first one and do not overlap it."""
    first = places.groupBy(*keys).agg(F.min(F.struct("doc_id", "digest", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    apart = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest")) | (F.col("at") >= F.col("first.at") + span)
    return places.join(first, keys).filter(apart).select("doc_id", "digest", "numbers")


def _few_lines(rows: DataFrame, span: int, long: int) -> DataFrame:
    """(doc_id, digest, at, window, numbers): the runs of ``span`` lines that hold ``long`` words or more together."""

    def window(i: Column) -> Column:
        own = [F.get("lines", i + k) for k in range(span)]
        words = sum((x["words"] for x in own), F.lit(0))
        return F.struct(i.alias("at"), words.alias("words"), F.xxhash64(*[x["hash"] for x in own]).alias("window"), F.array(*[x["number"] for x in own]).alias("numbers"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.size("lines") - span), window), lambda w: w["words"] >= long)
    return rows.filter(F.size("lines") >= span).select("doc_id", "digest", F.explode(windows).alias("w")).select("doc_id", "digest", "w.at", "w.window", "w.numbers")


def repeated_lines(docs: DataFrame, lines: int = LINES, long: int = LONG) -> DataFrame:
    """(doc_id, digest, removed): the sorted numbers of the lines to delete, for documents that have any."""
    rows = materialise(line_hashes(docs), "lines")
    value = lambda i, k: F.get("lines", i + k)["hash"]
    number = lambda i, k: F.get("lines", i + k)["number"]

    def window(i: Column) -> Column:
        return F.struct(
            i.alias("at"),
            (F.least(*[value(i, k) for k in range(lines)]) if lines > 1 else value(i, 0)).alias("selected"),
            F.xxhash64(*[value(i, k) for k in range(lines)]).alias("window"),
            F.array(*[number(i, k) for k in range(lines)]).alias("numbers"),
        )

    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - lines), window)
    windowed = rows.filter(F.size("lines") >= lines).select("doc_id", "digest", windows.alias("windows"))
    # one row for each selected hash of a document, more only where it is selected at places of their own
    selected = windowed.select(F.explode(F.transform("windows", lambda w: F.struct(w["selected"], w["window"]))).alias("w")).select("w.*")
    repeated = selected.groupBy("selected", "window").agg(F.count(F.lit(1)).alias("n")).groupBy("selected").agg(F.sum("n").alias("n")).filter("n > 1").select("selected")
    places = windowed.select("doc_id", "digest", F.explode("windows").alias("w")).select("doc_id", "digest", "w.*").join(repeated, "selected", "left_semi")
    found = _later(places, ["selected", "window"], lines)
    for span in range(1, lines):
        found = found.unionByName(_later(_few_lines(rows, span, long), ["window"], span))
    return found.groupBy("doc_id", "digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("numbers")))).alias("removed"))


def without_repeats(docs: DataFrame, lines: int = LINES, long: int = LONG, into: tuple[str, str, str] = ("n_lines", "n_removed", "n_runs")) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``, and the numbers of lines, deleted lines and deleted runs."""
    d, g, removed, digest, split = fresh(docs, "run_doc", "run_digest", "run_removed", "run_text_digest", "run_lines")
    found = repeated_lines(docs, lines, long).select(F.col("doc_id").alias(d), F.col("digest").alias(g), F.col("removed").alias(removed))
    out = docs.withColumn(digest, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(digest) == F.col(g)), "left")
    out = out.withColumn(split, F.split("text", "\n", -1))
    n_lines, n_removed, n_runs = fresh(docs, *into)
    out = out.withColumns(
        {
            n_lines: F.coalesce(F.size(split), F.lit(0)).cast("long"),
            n_removed: F.coalesce(F.size(removed), F.lit(0)).cast("long"),
            n_runs: F.coalesce(F.size(_runs(F.col(removed))[0]), F.lit(0)).cast("long"),
            "text": F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col(split), F.col(removed)), "\n")),
        }
    )
    return out.drop(d, g, removed, digest, split)


def query(spark: SparkSession, folder: str) -> DataFrame:
    out = without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, number, trim(line) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents)
), placed AS (
  SELECT doc_id, number, line, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS place,
         length(line) - length(replace(line, ' ', '')) + 1 AS words
  FROM lines WHERE line <> ''
), windows AS (
  SELECT doc_id, place, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), firsts AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(place) OVER w AS first_at
  FROM windows WHERE c IS NOT NULL WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, place)
), pairs AS (
  SELECT doc_id, place, line AS a, lead(line) OVER w AS b, words + lead(words) OVER w AS words FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), first_pairs AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(place) OVER w AS first_at
  FROM pairs WHERE b IS NOT NULL AND words >= 50 WINDOW w AS (PARTITION BY a, b ORDER BY doc_id, place)
), later AS (
  SELECT doc_id, place + k AS place FROM firsts, (VALUES (0), (1), (2)) AS t(k) WHERE first_doc <> doc_id OR place >= first_at + 3
  UNION
  SELECT doc_id, place + k FROM first_pairs, (VALUES (0), (1)) AS t(k) WHERE first_doc <> doc_id OR place >= first_at + 2
  UNION
  SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY line ORDER BY doc_id, place) AS n FROM placed WHERE words >= 50) WHERE n > 1
), marked AS (
  SELECT l.doc_id, l.number, l.raw, r.doc_id IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents) l
  LEFT JOIN (SELECT p.doc_id, p.number FROM placed p JOIN later USING (doc_id, place)) r ON r.doc_id = l.doc_id AND r.number = l.number
), runs AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY number), false) AS starts FROM marked
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (starts) AS n_runs,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY number) FILTER (NOT removed), '')) AS kept_sha256
FROM runs GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""
