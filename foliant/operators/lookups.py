"""Lookups between collections, expressed as joins.

Join sides are left to the optimizer, which broadcasts a side only after measuring it and splits skewed partitions at
run time. Lookup tables are made unique per key before they are joined, so a hot key multiplies no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import array_depth, get_path, parts_of, path_type, values_at
from foliant.functions.text import analyze
from foliant.session import materialise

# How many collected values one row may hold; more come in several rows, told apart by ``part``.
PART = 100_000


def by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Entries with the given ``ids(id)``, or ``ids(resource, id)`` where ids of several collections are the same."""
    keys = [c for c in ("resource", "id") if c in ids.columns]
    return df.join(ids.select(*[F.col(c).cast("string") for c in keys]).distinct(), keys, "left_semi")


def field_values(df: DataFrame, path: str) -> Column:
    """Distinct non-null values of a body path, as one array per entry."""
    return F.array_distinct(values_at(F.col("entry"), df.schema["entry"].dataType, path))


def multi_lookup(keys: DataFrame, df: DataFrame, path: str) -> DataFrame:
    """Many queries answered together: ``keys(query, value)`` gives one row per hit, and one without a hit for a
    query that finds nothing.

    The hits come from an inner join, where either side of a hot value can be split; an outer join splits only the keys.
    """
    hits = df.select(F.explode(field_values(df, path)).alias("value"), F.struct("resource", "id", "entry").alias("hit"))
    found = keys.join(hits, "value")
    nothing = keys.join(hits.select("value").distinct(), "value", "left_anti")
    return found.unionByName(nothing, allowMissingColumns=True)


# ---------------------------------------------------------------- phrases


def text_words(df: DataFrame, paths: list[str]) -> DataFrame:
    """(words): the words of every text at the given paths, in order."""
    found = [values_at(F.col("entry"), df.schema["entry"].dataType, path) for path in paths]
    texts = df.select(F.explode(F.flatten(F.array(*found))).alias("text"))
    return texts.select(analyze(F.col("text")).alias("words")).filter(F.size("words") > 0)


def _phrases_in(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``wanted(_words)``, of two words or more, that stand in ``texts(words)``.

    A phrase is looked for where its rarest word stands. Texts send only the surroundings of such words, as far as their
    longest phrase reaches, and phrases are compared there; what is exchanged follows the places of rare words.
    """
    parts = wanted.select("_words", F.explode(F.array_distinct("_words")).alias("word"))
    counts = texts.select(F.explode("words").alias("word")).join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rated = parts.join(counts, "word", "left").groupBy("_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest"))
    rated = materialise(rated.filter("rarest.n > 0").select("_words", F.col("rarest.word").alias("word"), (F.array_position("_words", F.col("rarest.word")) - 1).cast("int").alias("at")), "anchors")
    reach = rated.groupBy("word").agg(F.max("at").alias("left"), F.max(F.size("_words") - F.col("at")).alias("right"))
    # where an anchor stands, with as many words before and after it as some phrase needs
    here = texts.select(F.posexplode("words").alias("i", "word"), "words").join(reach, "word")
    start = F.greatest(F.col("i") - F.col("left"), F.lit(0))
    windows = here.select("word", (F.col("i") - start).alias("i"), F.slice("words", start + 1, F.col("i") + F.col("right") - start).alias("around")).distinct()
    stands = (F.col("i") >= F.col("at")) & (F.slice("around", F.greatest(F.col("i") - F.col("at"), F.lit(0)) + 1, F.size("_words")) == F.col("_words"))
    return windows.join(rated, "word").filter(stands).select("_words").distinct()


def not_found(words: DataFrame, df: DataFrame, paths: list[str], max_words: int | None = None) -> DataFrame:
    """Those of ``words(word)`` that occur in none of the given text fields.

    Occurring means being a phrase of the field. Single words are looked up among the distinct words of the texts; longer
    phrases where their rarest word stands. ``max_words=1`` says that there are no longer ones.
    """
    wanted = words.select("word").distinct().withColumn("_words", analyze(F.col("word")))
    texts = text_words(df, paths) if max_words == 1 else materialise(text_words(df, paths), "words")
    known = texts.select(F.explode(F.array_distinct("words")).alias("_single")).distinct()
    missing = wanted.filter(F.size("_words") <= 1).withColumn("_single", F.get("_words", F.lit(0))).join(known, "_single", "left_anti").select("word")
    if max_words == 1:
        return missing
    phrases = wanted.filter(F.size("_words") > 1)
    return missing.unionByName(phrases.join(_phrases_in(phrases.select("_words").distinct(), texts), "_words", "left_anti").select("word"))


# ---------------------------------------------------------------- links


def link_table(other: DataFrame, target: str) -> DataFrame:
    """(value, hits, hit): how many entries hold each value of ``target``, and one of them."""
    rows = other.select(F.explode(field_values(other, target)).alias("value"), "id", "entry")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("hits"), F.min_by("entry", "id").alias("hit"))


def link_result(hits: Column, hit: Column) -> Column:
    """The linked entry, or an ``error`` when there is none or more than one."""
    error = F.when(F.coalesce(hits, F.lit(0)) == 0, "not found").when(hits > 1, "multiple matches")
    return F.struct(error.alias("error"), F.when(hits == 1, hit).alias("entry"))


def link(df: DataFrame, other: DataFrame, id: str, target: str, name: str = "link") -> DataFrame:
    """For the value of ``id`` in each entry, the entry of ``other`` whose ``target`` equals it."""
    table = link_table(other, target).withColumnsRenamed({"value": "_value", "hits": "_hits", "hit": "_hit"})
    joined = df.withColumn("_id", get_path(df, f"entry.{id}")).join(table, F.col("_id") == F.col("_value"), "left")
    result = F.when(F.col("_id").isNotNull(), link_result(F.col("_hits"), F.col("_hit")))
    return joined.withColumn(name, result).drop("_id", "_value", "_hits", "_hit")


def backlink_edges(other: DataFrame, target: str, field: str) -> DataFrame:
    """(ref, value): one row per entry of ``other`` and value of ``target``, with the entry's ``field``.

    The complete result in long form; no group is ever collected.
    """
    return _edges(other, target, field).drop("source")


def _edges(other: DataFrame, target: str, field: str) -> DataFrame:
    """``backlink_edges`` with the entry that each comes from."""
    source = F.struct(*[F.col(c) for c in ("resource", "id") if c in other.columns]).alias("source")
    return other.select(F.explode(field_values(other, target)).alias("ref"), get_path(other, f"entry.{field}").alias("value"), source)


def collect_parts(edges: DataFrame, keys: list[str], value: str | Column, name: str, limit: int = PART, salt: str | Column | None = None) -> DataFrame:
    """Values per key as arrays of about ``limit`` values at most: (keys, part, name).

    Keys with more values than that are found by a count with map-side combining, and their values are spread over as
    many parts as they need before anything is collected: by ``salt``, which tells rows with equal values apart, so that
    a value that very many rows share is spread, too.
    """
    value = F.col(value) if isinstance(value, str) else value
    salted = value if salt is None else F.col(salt) if isinstance(salt, str) else salt
    hot = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    spread = edges.join(hot, keys, "left")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / limit)
    part = F.pmod(F.xxhash64(F.to_json(F.struct(salted.alias("v")))), parts).cast("int")
    return (
        spread.withColumn("part", F.when(F.col("_n").isNull(), 0).otherwise(part))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(value)).alias(name))
    )


def backlink(
    df: DataFrame, other: DataFrame, target: str, field: str, id: str, name: str = "backlinks", limit: int = PART
) -> DataFrame:
    """Entries with all values of ``field`` of the entries of ``other`` that refer to them; ``[]`` when none do.

    An entry with more than ``limit`` of them comes in several rows, numbered by ``part``.
    """
    edges = _edges(other, target, field)
    kind = edges.schema["value"].dataType
    grouped = collect_parts(edges, ["ref"], "value", name, limit, "source").withColumnRenamed("ref", "_ref")
    joined = df.withColumn("_id", get_path(df, f"entry.{id}")).join(grouped, F.col("_id") == F.col("_ref"), "left")
    filled = F.coalesce(name, F.array().cast(T.ArrayType(kind)))
    return joined.withColumn(name, filled).withColumn("part", F.coalesce("part", F.lit(0))).drop("_id", "_ref")


def resource_values(other: DataFrame, path: str = "") -> DataFrame:
    """Every value of a path in a collection, one row per entry that has it."""
    if not path:
        return other.select(F.col("entry").alias("value"))
    dtype = path_type(other.schema["entry"].dataType, parts_of(path))
    if array_depth(dtype) > 1:
        raise ValueError(f"{path} is nested more than one level deep")
    value = get_path(other, f"entry.{path}")
    return other.select(value.alias("value")).filter("value IS NOT NULL")


def collect_resource(df: DataFrame, other: DataFrame, path: str = "", name: str = "values", limit: int | None = PART) -> DataFrame:
    """Put every value of a path in another collection on each entry, as arrays of about ``limit`` values at most.

    A collection with more values comes in several rows per entry, numbered by ``part``; an entry with none has ``[]``.
    The arrays are joined on their part, and only their number is known to all tasks. ``limit=None`` is for collections
    that are known to be small: one array. ``resource_values`` is the long form.
    """
    values = resource_values(other, path)
    kind = T.ArrayType(values.schema["value"].dataType)
    parts = F.lit(1)
    if limit:
        parts = values.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / limit)).cast("int")).scalar()
    # told apart by where they are read, so that equal values are spread, too
    place = F.xxhash64(F.monotonically_increasing_id())
    numbered = values.withColumn("_parts", parts).select("value", F.pmod(place, "_parts").cast("int").alias("part"))
    arrays = numbered.groupBy("part").agg(F.array_sort(F.collect_list("value")).alias(name))
    every = df.withColumn("_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))))
    return every.join(arrays, "part", "left").withColumn(name, F.coalesce(name, F.array().cast(kind))).select(*df.columns, "part", name)


# ---------------------------------------------------------------- publication and permissions


def published(df: DataFrame, resources: DataFrame) -> DataFrame:
    """Entries of collections whose newest resource row is published."""
    from foliant.sources.catalog import list_resources

    open_ones = list_resources(resources).select(F.col("resource_id").alias("resource"))
    return df.join(open_ones, "resource", "left_semi")


def protection(resources: DataFrame) -> DataFrame:
    """(resource_id, protected): ADMIN, WRITE, READ or null for each published collection.

    ``config`` holds the protection flags as ``protected.admin`` and so on in its JSON.
    """
    from foliant.sources.catalog import list_resources

    flag = {level: F.get_json_object("config", f"$.protected.{level}") for level in ("admin", "write", "read")}
    some = F.coalesce(*flag.values()).isNotNull()
    level = (
        F.when(~some, F.lit(None))
        .when(flag["admin"] == "true", "ADMIN")
        .when(flag["write"] == "true", "WRITE")
        .otherwise("READ")
    )
    return list_resources(resources).select("resource_id", level.alias("protected"))


# Permission levels, lowest first.
LEVELS = {"READ": 1, "WRITE": 2, "ADMIN": 3}


def permitted(requests: DataFrame, grants: DataFrame, resources: DataFrame, level: str) -> DataFrame:
    """Those of the ``requests(user, resource_id)`` that are allowed at ``level``.

    Reading is open unless the collection is read-protected; writing and administering always need a grant of at
    least the level. ``grants(user, resource_id, level)`` holds numbers. Two equi-joins: collections open to everyone
    are a property of the collection, so users and collections are never multiplied.
    """
    from foliant.sources.catalog import latest_resources

    enough = grants.filter(F.col("level") >= LEVELS[level]).select("user", "resource_id").distinct()
    shut = F.lit(True)
    if level == "READ":
        shut = F.coalesce(F.get_json_object("config", "$.protected.read") == "true", F.lit(False))
    known = latest_resources(resources).filter(~F.col("discarded")).select("resource_id", shut.alias("_shut"))
    asked = requests.join(known, "resource_id")
    granted = asked.join(enough.withColumn("_granted", F.lit(True)), ["user", "resource_id"], "left")
    return granted.filter(~F.col("_shut") | F.col("_granted")).select(*requests.columns)


def permitted_entries(df: DataFrame, grants: DataFrame, resources: DataFrame, user: str, level: str = "READ") -> DataFrame:
    """Entries of the collections one user may use at a level."""
    asked = resources.select("resource_id").distinct().withColumn("user", F.lit(user))
    allowed = permitted(asked, grants.filter(F.col("user") == user), resources, level)
    return df.join(allowed.select(F.col("resource_id").alias("resource")), "resource", "left_semi")
