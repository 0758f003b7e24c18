"""The catalog of collections: its own append-only history, listing, and lifecycle changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.history import latest_per_key

RESOURCE_TYPE = (
    "history_id long, entity_id string, resource_id string, version int, name string, table_name string, "
    "config string, is_published boolean, last_modified double, last_modified_by string, message string, op string, "
    "discarded boolean"
)

CREATE, CHANGE, PUBLISH, UNPUBLISH, DELETE = "create", "update", "publish", "unpublish", "delete"


def latest_resources(resources: DataFrame) -> DataFrame:
    """The newest row of every collection."""
    return latest_per_key(resources, ["resource_id"], "history_id")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ``*`` any text, ``?`` one character."""
    return "^" + glob.replace("*", ".*").replace("?", ".") + "$"


def list_resources(resources: DataFrame, published: bool = True, globs: list[str] | None = None) -> DataFrame:
    """Newest rows of collections, by default the published ones, whose id matches any of the globs."""
    rows = latest_resources(resources).filter(~F.col("discarded"))
    if published:
        rows = rows.filter("is_published")
    if globs:
        rows = rows.filter(F.rlike("resource_id", F.lit("|".join(glob_pattern(g) for g in globs))))
    return rows


def show_resource(resources: DataFrame, resource_id: str | None = None, version: int | None = None) -> DataFrame:
    """Metadata and config of one collection (or of all), now or at an older version."""
    rows = resources if resource_id is None else resources.filter(F.col("resource_id") == resource_id)
    return latest_resources(rows) if version is None else rows.filter(F.col("version") == version)


def resource_changes(resources: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lifecycle changes, at most one per collection: (new history rows, errors, collections to forget).

    ``changes(resource_id, change, version, config, name, user, message, last_modified)``. Creating fails when the
    collection exists; an unchanged config makes no version; a version that is given must match; unpublishing an
    unpublished collection does nothing; deleting forgets every version (remove those rows with ``forget``).
    """
    c = F.col
    now = latest_resources(resources.join(changes.select("resource_id"), "resource_id", "left_semi"))
    now = now.filter(~c("discarded")).select(
        "resource_id",
        c("entity_id").alias("_entity"),
        c("version").alias("_version"),
        c("name").alias("_name"),
        c("table_name").alias("_table"),
        c("config").alias("_config"),
        c("is_published").alias("_published"),
    )
    judged = changes.join(now, "resource_id", "left")
    known = c("_version").isNotNull()
    idle = ((c("change") == CHANGE) & c("config").eqNullSafe(c("_config"))) | (
        (c("change") == UNPUBLISH) & ~F.coalesce("_published", F.lit(False))
    )
    mismatch = c("version").isNotNull() & (c("version") != c("_version"))
    error = (
        F.when((c("change") == CREATE) & (F.length("resource_id") < 2), "name too short")
        .when((c("change") == CREATE) & F.contains("resource_id", F.lit(" ")), "name has a space")
        .when((c("change") == CREATE) & known, "exists")
        .when((c("change") != CREATE) & ~known, "missing")
        .when(c("change").isin(CHANGE, PUBLISH, UNPUBLISH) & ~idle & mismatch, "version")
    )
    judged = judged.withColumn("error", error)
    errors = judged.filter("error IS NOT NULL").select("resource_id", "change", "error")
    fine = judged.filter("error IS NULL")
    made = fine.filter((c("change") != DELETE) & ~F.coalesce(idle, F.lit(False)))
    create = c("change") == CREATE
    entity = F.coalesce("_entity", F.concat(c("resource_id"), F.lit("@"), c("last_modified").cast("string")))
    said = F.when(c("message") != "", c("message"))
    default = (
        F.when(create, F.concat(F.lit("Resource '"), c("resource_id"), F.lit("' created.")))
        .when(c("change") == CHANGE, "updating")
        .when(c("change") == PUBLISH, "Published")
        .otherwise("Unpublished")
    )
    rows = made.select(
        entity.alias("entity_id"),
        "resource_id",
        F.when(create, 1).otherwise(c("_version") + 1).cast("int").alias("version"),
        F.coalesce("name", "_name").alias("name"),
        F.coalesce("_table", F.concat_ws("_", "resource_id", entity)).alias("table_name"),
        F.when(create | (c("change") == CHANGE), c("config")).otherwise(c("_config")).alias("config"),
        F.when(c("change") == PUBLISH, True)
        .when(create | (c("change") == UNPUBLISH), False)
        .otherwise(c("_published"))
        .alias("is_published"),
        "last_modified",
        F.coalesce("user", F.lit("unknown")).alias("last_modified_by"),
        F.when(c("change") == UNPUBLISH, "Unpublished").otherwise(F.coalesce(said, default)).alias("message"),
        F.when(create, "ADDED").otherwise("UPDATED").alias("op"),
        F.lit(False).alias("discarded"),
    )
    return rows, errors, fine.filter(c("change") == DELETE).select("resource_id")


def forget(resources: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalog without any version of the deleted collections."""
    return resources.join(gone, "resource_id", "left_anti")
