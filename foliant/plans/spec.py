"""Declared schemas of collections and the Spark types they stand for."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

# The declared scalar types and their Spark types.
SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "long_string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
    "dense_vector": T.ArrayType(T.FloatType()),
}


class SpecError(ValueError):
    """A spec, or a use of a field, that cannot be planned."""


class IncompatibleFields(SpecError):
    """A field that several collections declare differently (error 83)."""

    code = 83


class UnknownField(SpecError):
    """A field that is not declared in every collection asked for (error 84)."""

    code = 84


class SortError(SpecError):
    """A field that cannot be sorted on, or collections without a common default sort (error 82)."""

    code = 82


def _flag(value: Any) -> bool:
    return value.strip().lower() in ("true", "yes", "1") if isinstance(value, str) else bool(value)


def split_path(path: str | list) -> list:
    if isinstance(path, str):
        return path.split(".") if path else []
    return list(path)


@dataclass(frozen=True)
class Field:
    """One declared field; names follow the keys of a configuration dictionary."""

    type: str | None = None
    required: bool = False
    collection: bool = False
    store: bool = True
    virtual: bool = False
    plugin: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    field_params: dict[str, Any] = field(default_factory=dict)
    fields: dict[str, "Field"] = field(default_factory=dict)
    hidden: bool = False
    flatten_params: bool = False
    allow_missing_params: bool = False
    cache_plugin_expansion: bool = True
    searchable: bool = True
    skip_raw: bool = False
    additional_properties: bool = True

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> "Field":
        known = {f: config[f] for f in cls.__dataclass_fields__ if f in config}
        unknown = set(config) - set(known)
        if unknown:
            raise SpecError(f"unknown field settings {sorted(unknown)}")
        for name in (
            "required collection store virtual hidden flatten_params allow_missing_params "
            "cache_plugin_expansion searchable skip_raw additional_properties"
        ).split():
            if name in known:
                known[name] = _flag(known[name])
        known["fields"] = {k: cls.from_dict(v) for k, v in (config.get("fields") or {}).items()}
        made = cls(**known)
        if not made.virtual and made.type != "object" and made.type not in SCALARS:
            raise SpecError(f"unsupported type {made.type!r}")
        if made.virtual and not made.plugin:
            raise SpecError("a derived field needs a function")
        return made

    @property
    def is_object(self) -> bool:
        return self.type == "object"

    @property
    def is_text(self) -> bool:
        return self.type == "string"

    def element_type(self) -> T.DataType:
        if self.is_object:
            return struct_of(self.fields)
        if self.type not in SCALARS:
            raise SpecError(f"no Spark type for {self.type!r}")
        return SCALARS[self.type]

    def data_type(self) -> T.DataType:
        return T.ArrayType(self.element_type()) if self.collection else self.element_type()


def struct_of(fields: dict[str, Field]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, f.data_type()) for name, f in fields.items() if not (f.virtual and f.type is None)]
    )


@dataclass(frozen=True)
class Spec:
    """A collection: its name, fields, default sort, id field and protection."""

    name: str
    fields: dict[str, Field]
    sort: tuple[str, ...] = ()
    id: str | None = None
    protected: dict[str, bool] = field(default_factory=dict)
    additional_properties: bool = True
    title: str | None = None

    def __post_init__(self) -> None:
        if len(self.name) < 2 or " " in self.name:
            raise SpecError(f"a collection name has at least two characters and no space: {self.name!r}")

    @classmethod
    def from_dict(cls, config: dict[str, Any]) -> "Spec":
        sort = config.get("sort") or ()
        return cls(
            name=config["resource_id"],
            fields={k: Field.from_dict(v) for k, v in config["fields"].items()},
            sort=(sort,) if isinstance(sort, str) else tuple(sort),
            id=config.get("id"),
            protected=dict(config.get("protected") or {}),
            additional_properties=_flag(config.get("additional_properties", True)),
            title=config.get("resource_name"),
        )

    def with_fields(self, fields: dict[str, Field]) -> "Spec":
        return replace(self, fields=fields)

    def stored_fields(self) -> dict[str, Field]:
        """The fields a stored body may hold: everything that is not derived."""

        def keep(fields: dict[str, Field]) -> dict[str, Field]:
            return {k: replace(f, fields=keep(f.fields)) for k, f in fields.items() if not f.virtual}

        return keep(self.fields)

    def body_type(self) -> T.StructType:
        return struct_of(self.stored_fields())

    def field(self, path: str) -> Field:
        fields, found = self.fields, None
        for part in split_path(path):
            if part not in fields:
                raise UnknownField(f"no field {path!r} in {self.name}")
            found = fields[part]
            fields = found.fields
        if found is None:
            return Field(type="object", required=True, fields=self.fields)
        return found

    def nesting(self, path: str) -> int:
        """How many collections a path crosses, its last part included."""
        parts = split_path(path)
        return sum(self.field(".".join(parts[: i + 1])).collection for i in range(len(parts)))

    def walk(self) -> Iterator[tuple[str, Field]]:
        def go(prefix: str, fields: dict[str, Field]) -> Iterator[tuple[str, Field]]:
            for name, f in fields.items():
                yield prefix + name, f
                yield from go(f"{prefix}{name}.", f.fields)

        yield from go("", self.fields)

    def leaves(self) -> Iterator[tuple[str, Field]]:
        return ((path, f) for path, f in self.walk() if not f.is_object)


def shared_field(specs: list[Spec], path: str) -> Field:
    """The definition of a field used over several collections; it must be the same in all of them."""
    missing = []
    found: list[Field] = []
    for spec in specs:
        try:
            found.append(spec.field(path))
        except UnknownField:
            missing.append(spec.name)
    shape = {(f.type, f.collection, f.skip_raw) for f in found}
    if len(shape) > 1:
        raise IncompatibleFields(f"field {path!r} differs between {[s.name for s in specs]}")
    if missing:
        raise UnknownField(f"no field {path!r} in {missing}")
    parts = split_path(path)
    for i in range(1, len(parts)):
        if len({s.field(".".join(parts[:i])).collection for s in specs}) > 1:
            raise IncompatibleFields(f"field {path!r} is nested differently in {[s.name for s in specs]}")
    return found[0]
