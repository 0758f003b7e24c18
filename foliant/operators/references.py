"""The graph of references between entries: ids, forward edges, backward edges, and what references point at.

Which fields hold ids, which hold references and which attributes describe an id are given by a ``Layout``; the
default is the layout of a Swedish dictionary with the two parts ``so`` and ``saol``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.paths import bind, is_visible, type_at, update, visible
from foliant.functions.text import clean_refs, clean_tags
from foliant.operators.derive import at_parents, resolve
from foliant.operators.history import latest_per_key
from foliant.operators.lookups import PART, collect_parts
from foliant.plans.spec import split_path
from foliant.session import materialise

# ---- Fixed values: kinds of ids and the name each is written with.
KINDS = {
    "LNR": ("so", "lnr"),
    "XNR": ("so", "xnr"),
    "KCNR": ("so", "kcnr"),
    "INR": ("so", "inr"),
    "SAOL_LNR": ("saol", "lnr"),
    "SAOL_XNR": ("saol", "xnr"),
}

# The kind a written prefix stands for, by the part of the entry it is found in.
PREFIXES = {
    "so": {"lnr": "LNR", "xnr": "XNR", "kcnr": "KCNR"},
    "saol": {"lnr": "SAOL_LNR", "xnr": "SAOL_XNR", "kcnr": "KCNR"},
}

# Fields that hold an id.
ID_FIELDS = {
    "so.l_nr": "LNR",
    "so.huvudbetydelser.x_nr": "XNR",
    "so.huvudbetydelser.underbetydelser.kc_nr": "KCNR",
    "so.huvudbetydelser.idiom.i_nr": "INR",
    "so.variantformer.l_nr": "LNR",
    "so.vnomen.l_nr": "LNR",
    "so.förkortningar.l_nr": "LNR",
    "saol.id": "SAOL_LNR",
    "saol.variantformer.id": "SAOL_LNR",
    "saol.huvudbetydelser.id": "SAOL_XNR",
}

# Fields that hold a reference; without a kind the reference itself is prefixed.
REF_FIELDS = {
    "so.huvudbetydelser.hänvisningar.hänvisning": None,
    "so.huvudbetydelser.morfex.hänvisning": None,
    "so.huvudbetydelser.underbetydelser.hänvisningar.hänvisning": None,
    "so.huvudbetydelser.underbetydelser.morfex.hänvisning": None,
    "so.huvudbetydelser.idiom.hänvisning": "INR",
    "so.vnomen.hänvisning": None,
    "so.relaterade_verb.refid": "LNR",
    "saol.moderverb": "SAOL_LNR",
}

# The attributes in the id directory and, per id field, the path each is read from; a value in a
# one-element tuple is taken as it is.
ATTRIBUTES = ("ortografi", "ordklass", "ingångstyp", "homografNr", "huvudbetydelseNr")
_BASE = {"ortografi": "ortografi", "ordklass": "ordklass", "ingångstyp": "ingångstyp"}
_SO = {**_BASE, "homografNr": "so.homografNr"}
_SAOL = {**_BASE, "homografNr": "saol.homografNr"}
_SO_SENSE = {**_SO, "huvudbetydelseNr": "so.huvudbetydelser.h_nr"}
ID_INFO = {
    "so.l_nr": _SO,
    "so.huvudbetydelser.x_nr": _SO_SENSE,
    "so.huvudbetydelser.underbetydelser.kc_nr": _SO_SENSE,
    "so.huvudbetydelser.idiom.i_nr": _SO_SENSE,
    "so.variantformer.l_nr": {
        **_SO,
        "ortografi": "so.variantformer.ortografi",
        "homografNr": "so.variantformer.homografNr",
        "ingångstyp": ("variant",),
    },
    "so.vnomen.l_nr": {**_SO, "ortografi": "so.vnomen.ortografi", "homografNr": "so.vnomen.homografNr"},
    "so.förkortningar.l_nr": {**_SO, "ortografi": "so.vnomen.ortografi", "homografNr": "so.vnomen.homografNr"},
    "saol.id": _SAOL,
    "saol.variantformer.id": {
        **_SO,
        "ortografi": "saol.variantformer.ortografi",
        "homografNr": "so.variantformer.homografNr",
        "ingångstyp": ("variant",),
    },
    "saol.huvudbetydelser.id": {**_SAOL, "huvudbetydelseNr": "saol.huvudbetydelser.h_nr"},
}
# ---- end of fixed values


@dataclass(frozen=True)
class Layout:
    id_fields: dict = field(default_factory=lambda: ID_FIELDS)
    ref_fields: dict = field(default_factory=lambda: REF_FIELDS)
    info: dict = field(default_factory=lambda: ID_INFO)
    numbered: tuple = ("so.huvudbetydelser", "saol.huvudbetydelser")


SWEDISH = Layout()


def format_ref(kind: Column, ref: Column) -> Column:
    """``so.lnr123`` for a kind and a number."""
    known = F.create_map(*[F.lit(x) for k, (ns, name) in KINDS.items() for x in (k, f"{ns}.{name}")])
    return F.concat(F.try_element_at(known, kind), ref)


def format_as(kind: str, ref: Column) -> Column:
    return F.concat(F.lit(".".join(KINDS[kind])), ref)


def parse_ref(ref: Column, root: str) -> Column:
    """A prefixed reference found under ``root`` as struct(kind, ref); null when the prefix is unknown."""
    out = F.lit(None).cast("struct<kind:string,ref:string>")
    for prefix, kind in reversed(PREFIXES[root].items()):
        found = F.struct(F.lit(kind).alias("kind"), F.substring(ref, len(prefix) + 1, 1 << 30).alias("ref"))
        out = F.when(F.startswith(ref, F.lit(prefix)), found).otherwise(out)
    return out


def _full_ref(ref: Column, root: str, kind: str | None) -> Column:
    """The written form of a reference; null when it cannot be read."""
    if kind is not None:
        return format_as(kind, ref)
    out = F.lit(None).cast("string")
    for prefix, known in reversed(PREFIXES[root].items()):
        rest = F.substring(ref, len(prefix) + 1, 1 << 30)
        out = F.when(F.startswith(ref, F.lit(prefix)), format_as(known, rest)).otherwise(out)
    return out


REF_ROW = "array<struct<ref:string,visas:boolean>>"


def _members(col: Column, dtype: T.DataType, rest: list, at: Callable[[Column, T.DataType, Column], Column], shown: Column, empty: str) -> Column:
    """Arrays that ``at(value, type, visible)`` makes for every value at a path, as one array; ``visible`` tells
    whether every object on the way is."""
    none = F.array().cast(empty)
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(col, lambda x: _members(x, dtype.elementType, rest, at, shown, empty))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(dtype, T.StructType):
        shown = shown & is_visible(col, dtype)
    if rest:
        if not isinstance(dtype, T.StructType) or rest[0] not in dtype.fieldNames():
            return none
        return _members(col.getField(rest[0]), dtype[rest[0]].dataType, rest[1:], at, shown, empty)
    return F.when(col.isNotNull(), at(col, dtype, shown)).otherwise(none)


def _strings(col: Column, dtype: T.DataType, path: str, skip: set, crossed: bool, at: Callable, shown: Column) -> list[Column]:
    """Arrays for every string below a value, one column per string field."""
    if isinstance(dtype, T.ArrayType):
        inner = _strings_flat(dtype.elementType, path, skip, True, at, shown)
        return [] if inner is None else [F.coalesce(F.flatten(F.transform(col, inner)), F.array().cast(REF_ROW))]
    if isinstance(dtype, T.StructType):
        below = shown & is_visible(col, dtype)
        out = []
        for f in dtype.fields:
            out.extend(_strings(col.getField(f.name), f.dataType, f"{path}.{f.name}", skip, crossed, at, below))
        return out
    if isinstance(dtype, T.StringType) and not (path in skip and not crossed):
        return [F.when(col.isNotNull(), at(col, shown)).otherwise(F.array().cast(REF_ROW))]
    return []


def _strings_flat(dtype: T.DataType, path: str, skip: set, crossed: bool, at: Callable, shown: Column):
    probe = _strings(F.lit(None).cast(dtype), dtype, path, skip, crossed, at, shown)
    if not probe:
        return None

    def each(x: Column) -> Column:
        return F.flatten(F.array(*_strings(x, dtype, path, skip, crossed, at, shown)))

    return each


def forward_refs(df: DataFrame, layout: Layout = SWEDISH) -> Column:
    """The references of an entry: array of (ref, visas), one per reference, visible if any occurrence is."""
    return forward_refs_of(F.col("entry"), df.schema["entry"].dataType, layout)


def forward_refs_of(entry: Column, dtype: T.StructType, layout: Layout = SWEDISH) -> Column:
    """``forward_refs`` of any nested value.

    References stand in the fields of the layout and as ``refid=`` codes in any string. Everything happens inside the
    row; duplicates are settled by sorting the entry's own references.
    """
    found = []
    for path, kind in layout.ref_fields.items():
        root = split_path(path)[0]

        def one(value: Column, _t: T.DataType, shown: Column, root: str = root, kind: str | None = kind) -> Column:
            return F.array(F.struct(_full_ref(value.cast("string"), root, kind).alias("ref"), shown.alias("visas")))

        if type_at(dtype, split_path(path)) is not None:
            found.append(_members(entry, dtype, split_path(path), one, F.lit(True), REF_ROW))
    top = is_visible(entry, dtype)
    for root in ("so", "saol"):
        if root not in dtype.fieldNames():
            continue

        def codes(value: Column, shown: Column, root: str = root) -> Column:
            refs = F.regexp_extract_all(value, F.lit(r"(?<=refid=)[a-zA-Z0-9]*"), F.lit(0))

            def row(r: Column) -> Column:
                return F.struct(_full_ref(r, root, None).alias("ref"), shown.alias("visas"))

            # most strings hold no code: look for the marker before running the pattern
            return F.when(F.contains(value, F.lit("refid=")), F.transform(refs, row)).otherwise(F.array().cast(REF_ROW))

        found.extend(_strings(entry.getField(root), dtype[root].dataType, root, set(layout.ref_fields), False, codes, top))
    if not found:
        return F.array().cast(REF_ROW)
    rows = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda r: r.getField("ref").isNotNull())))

    def last_of_runs(sorted_rows: Column) -> Column:
        # sorted by (ref, visas): the last row of a run is visible if any is
        def ends(r: Column, i: Column) -> Column:
            return F.coalesce(F.get(sorted_rows, i + 1).getField("ref") != r.getField("ref"), F.lit(True))

        return F.filter(sorted_rows, ends)

    return bind(rows, last_of_runs)


def forward_edges(df: DataFrame, layout: Layout = SWEDISH) -> DataFrame:
    """(resource, id, ref, visas): one row per entry and reference. No shuffle."""
    rows = df.select("resource", "id", F.explode(forward_refs(df, layout)).alias("r"))
    return rows.select("resource", "id", F.col("r.ref").alias("ref"), F.col("r.visas").alias("visas"))


def find_ids(df: DataFrame, layout: Layout = SWEDISH) -> DataFrame:
    """(resource, id, kind, ref): every id in every entry."""
    dtype = df.schema["entry"].dataType
    found = []
    for path, kind in layout.id_fields.items():

        def one(value: Column, _t: T.DataType, _s: Column, kind: str = kind) -> Column:
            return F.array(F.struct(F.lit(kind).alias("kind"), format_as(kind, value.cast("string")).alias("ref")))

        if type_at(dtype, split_path(path)) is not None:
            found.append(_members(F.col("entry"), dtype, split_path(path), one, F.lit(True), "array<struct<kind:string,ref:string>>"))
    rows = df.select("resource", "id", F.explode(F.flatten(F.array(*found))).alias("r"))
    return rows.select("resource", "id", "r.kind", "r.ref")


def backward_edges(df: DataFrame, edges: DataFrame, layout: Layout = SWEDISH) -> DataFrame:
    """(resource, id, ref, from_id, ortografi, homografNr, visas, subobject): every entry that refers to any id of an
    entry, in long form. An id that a third of all references point at is split by the skew-join handling; nothing
    is collected."""
    dtype = df.schema["entry"].dataType

    def read(path: str) -> Column:
        if type_at(dtype, split_path(path)) is None:
            return F.lit(None).cast("string")
        col = F.col("entry")
        for part in split_path(path):
            col = col.getField(part)
        return col.cast("string")

    sources = df.select(
        F.col("resource").alias("_from"),
        F.col("id").alias("from_id"),
        F.coalesce(read("ortografi"), F.lit("?")).alias("ortografi"),
        read("so.homografNr").alias("_so"),
        read("saol.homografNr").alias("_saol"),
    )
    targets = find_ids(df, layout).select("resource", "id", "ref").distinct()
    hits = edges.select(F.col("resource").alias("_from"), F.col("id").alias("from_id"), "ref", "visas").join(targets, "ref")
    return hits.join(sources, ["_from", "from_id"]).select(
        "resource",
        "id",
        "ref",
        "from_id",
        "ortografi",
        F.when(F.startswith("ref", F.lit("so.")), F.col("_so")).otherwise(F.col("_saol")).alias("homografNr"),
        "visas",
        F.lit(False).alias("subobject"),
    )


def backward_refs(df: DataFrame, edges: DataFrame, nested: DataFrame | None = None, layout: Layout = SWEDISH, limit: int = PART) -> DataFrame:
    """Entries with their incoming references as arrays (several ``part`` rows beyond ``limit``).

    ``nested`` holds the references found for sub-objects, in the shape of ``backward_edges``; they are appended with
    ``subobject`` set.
    """
    rows = backward_edges(df, edges, layout)
    if nested is not None:
        rows = rows.unionByName(nested.withColumn("subobject", F.lit(True)))
    value = F.struct(F.col("subobject"), F.col("from_id").alias("id"), "ref", "ortografi", "homografNr", "visas")
    # read twice: to count and to collect
    rows = materialise(rows, "incoming")
    return collect_parts(rows, ["resource", "id"], value, "references", limit)


def id_info(df: DataFrame, layout: Layout = SWEDISH) -> DataFrame:
    """The id directory: (resource, entry_id, id, attributes): every id in the visible part of an entry, described
    by values read relative to where the id stands. Senses are numbered when there is more than one."""
    rows = id_info_of(F.col("entry"), df.schema["entry"].dataType, layout)
    out = df.select("resource", F.col("id").alias("entry_id"), F.explode(rows).alias("r"))
    return out.select("resource", "entry_id", "r.*")


ID_ROW = "array<struct<id:string," + ",".join(f"`{a}`:string" for a in ATTRIBUTES) + ">>"


def id_info_of(entry: Column, dtype: T.StructType, layout: Layout = SWEDISH) -> Column:
    """``id_info`` of any nested value, as one array."""

    def number(old: Column | None, _t: T.DataType | None, _p: Column) -> Column:
        many = F.size(old) > 1
        return F.transform(old, lambda x, i: x.withField("h_nr", F.when(many, i + 1)))

    seen, shape = visible(entry, dtype), dtype
    for path in layout.numbered:
        parts = split_path(path)
        if isinstance(type_at(shape, parts), T.ArrayType):
            seen = update(seen, shape, parts, number)
            shape = _numbered(shape, parts)
    return bind(seen, lambda obj: _directory(obj, shape, layout))


def _numbered(dtype: T.DataType, parts: list) -> T.DataType:
    """A type whose objects at ``parts`` also have a number."""
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_numbered(dtype.elementType, parts))
    if not parts:
        return T.StructType([f for f in dtype.fields if f.name != "h_nr"] + [T.StructField("h_nr", T.IntegerType())])
    return T.StructType(
        [T.StructField(f.name, _numbered(f.dataType, parts[1:]) if f.name == parts[0] else f.dataType) for f in dtype.fields]
    )


def _directory(entry: Column, dtype: T.StructType, layout: Layout) -> Column:
    found = []
    for path, attributes in layout.info.items():
        parts = split_path(path)
        if type_at(dtype, parts) is None:
            continue
        kind = layout.id_fields[path]

        def describe(chain, parts=parts, attributes=attributes, kind=kind) -> Column:
            _, holder, _ = chain[-1]
            own = holder.getField(parts[-1]).cast("string")
            members = [format_as(kind, own).alias("id")]
            for name in ATTRIBUTES:
                source = attributes.get(name)
                if isinstance(source, tuple):
                    value = F.lit(source[0])
                else:
                    got = resolve(chain, source) if source else None
                    value = got[0].cast("string") if got else F.lit(None).cast("string")
                members.append(value.alias(name))
            return F.when(own.isNotNull(), F.struct(*members))

        nested = at_parents(entry, dtype, parts[:-1], describe)
        levels = sum(isinstance(type_at(dtype, parts[: i + 1]), T.ArrayType) for i in range(len(parts) - 1))
        rows = nested if levels else F.array(nested)
        for _ in range(levels - 1):
            rows = F.flatten(F.filter(rows, lambda x: x.isNotNull()))
        found.append(F.coalesce(F.filter(rows, lambda x: x.isNotNull()), F.array().cast(ID_ROW)))
    return F.flatten(F.array(*found)) if found else F.array().cast(ID_ROW)


def reference_info(edges: DataFrame, directory: DataFrame, prefix: str = "") -> DataFrame:
    """For each entry, the directory rows its visible references point at, optionally of one prefix only, which is
    then stripped from the id."""
    wanted = edges.filter("visas").select("resource", "id", "ref").distinct()
    if prefix:
        wanted = wanted.filter(F.startswith("ref", F.lit(prefix)))
    described = latest_per_key(directory.drop("resource"), ["id"], "entry_id").withColumnRenamed("id", "ref")
    joined = wanted.withColumnRenamed("id", "from_id").join(described.drop("entry_id"), "ref")
    return joined.select(
        "resource", "from_id", F.substring("ref", len(prefix) + 1, 1 << 30).alias("id"), *ATTRIBUTES
    )


# ---------------------------------------------------------------- text of a sense


def sense_text(headword: Column, inflection: Column, sense: Column, dtype: T.StructType) -> Column:
    """One text per visible sense: headword, inflection, subject areas, definitions and those of its sub-senses, with
    the reference and tag markup removed."""

    def member(obj: Column, dt: T.StructType, name: str) -> Column:
        return F.coalesce(obj.getField(name), F.lit("")) if name in dt.fieldNames() else F.lit("")

    def parts(obj: Column, dt: T.StructType, text_field: str, list_field: str) -> Column:
        # the text is the sense's own, once per visible item of the list
        if list_field not in dt.fieldNames():
            return F.lit("")
        item = dt[list_field].dataType.elementType
        shown = F.size(F.filter(F.coalesce(obj.getField(list_field), F.array().cast(dt[list_field].dataType)), lambda x: is_visible(x, item)))
        return F.repeat(F.concat(F.lit(" "), member(obj, dt, text_field)), shown)

    def own(obj: Column, dt: T.StructType) -> Column:
        areas = F.lit("")
        if "ämnesområden" in dt.fieldNames():
            item = dt["ämnesområden"].dataType.elementType
            names = F.transform(obj.getField("ämnesområden"), lambda x: member(x, item, "ämne"))
            areas = F.coalesce(F.array_join(names, " "), F.lit(""))
        text = F.concat(
            areas,
            F.lit(" "),
            member(obj, dt, "definition"),
            F.lit(" "),
            member(obj, dt, "definitionstillägg"),
            parts(obj, dt, "text", "syntex"),
            parts(obj, dt, "ortografi", "morfex"),
            parts(obj, dt, "ortografi", "_inkommande_hänvisningar"),
        )
        return F.when(is_visible(obj, dt), text).otherwise("")

    text = F.concat(headword, F.lit(" "), inflection, F.lit(" "), own(sense, dtype))
    if "underbetydelser" in dtype.fieldNames():
        sub = dtype["underbetydelser"].dataType.elementType
        subs = F.transform(sense.getField("underbetydelser"), lambda x: F.concat(F.lit(" "), own(x, sub)))
        text = F.concat(text, F.coalesce(F.array_join(subs, ""), F.lit("")))
    return F.when(is_visible(sense, dtype), clean_tags(clean_refs(text)))


__all__ = [
    "Layout",
    "SWEDISH",
    "backward_edges",
    "backward_refs",
    "find_ids",
    "format_ref",
    "forward_edges",
    "forward_refs",
    "id_info",
    "parse_ref",
    "reference_info",
    "sense_text",
]
