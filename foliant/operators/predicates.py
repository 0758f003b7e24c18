"""Composable predicates over collections of nested records.

A predicate is built from field paths and values and compiled, against a spec, to one boolean ``Column``. Leaves are
null on missing values, which a filter drops and ``and_``/``or_`` carry along; ``not_`` turns null into false before
it negates, so negation is safe and plain comparisons still reach the scan as pushed filters. A path that crosses a collection of objects means "some
element", separately for each predicate; ``sub`` evaluates a whole expression on one and the same element.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import text
from foliant.plans.spec import Field, Spec, SpecError, UnknownField, shared_field, split_path

# The metadata fields, the column each is kept in and its type.
META = {
    "@id": ("id", "keyword"),
    "@last_modified": ("last_modified", "number"),
    "@last_modified_by": ("last_modified_by", "keyword"),
    "@version": ("version", "integer"),
    "@resource": ("resource", "keyword"),
}

REGEX_META = re.compile(r"[.?+*|{}\[\]()\"\\#@&<>~^$]")


@dataclass(frozen=True)
class Scope:
    """Where paths start: an object's fields and its column, and the full path leading to it."""

    fields: dict[str, Field]
    root: Column
    prefix: str = ""
    words: dict[str, str] = field(default_factory=dict)  # full path -> column that already holds the words
    top: bool = True


class Predicate:
    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def paths(self) -> set[str]:
        """The fields the predicate names."""
        return set()

    def __and__(self, other: "Predicate") -> "Predicate":
        return and_(self, other)

    def __or__(self, other: "Predicate") -> "Predicate":
        return or_(self, other)

    def __invert__(self) -> "Predicate":
        return not_(self)


LeafTest = Callable[[Column, Field, str], Column]


def some_value(scope: Scope, path: str, leaf: LeafTest) -> Column:
    """``leaf`` on some value at ``path``; one ``exists`` per collection crossed."""

    def go(root: Column, fields: dict[str, Field], parts: list, done: str) -> Column:
        name = parts[0]
        if name not in fields:
            raise UnknownField(f"no field {scope.prefix}{path}")
        f, col, at = fields[name], root.getField(name), done + name
        if len(parts) == 1:
            if f.collection:
                return F.exists(col, lambda x: leaf(x, f, at))
            return leaf(col, f, at)
        if f.collection:
            return F.exists(col, lambda x: go(x, f.fields, parts[1:], at + "."))
        return go(col, f.fields, parts[1:], at + ".")

    return go(scope.root, scope.fields, split_path(path), scope.prefix)


def _meta(path: str) -> tuple[Column, str]:
    if path not in META:
        raise UnknownField(path)
    column, kind = META[path]
    return F.col(column), kind


def _cast(value: Any, kind: str | None, lenient: bool = False) -> Any:
    """A Python value as the field's type; with ``lenient`` an unfit value gives None."""
    try:
        if kind == "integer":
            if isinstance(value, float) and not value.is_integer():
                raise ValueError(value)
            return int(value)
        if kind == "number":
            return float(value)
        if kind == "boolean":
            if isinstance(value, bool):
                return value
            if str(value) not in ("true", "false"):
                raise ValueError(value)
            return str(value) == "true"
        return str(value)
    except (ValueError, TypeError):
        if lenient:
            return None
        raise SpecError(f"{value!r} is not of type {kind}") from None


def _words(scope: Scope, col: Column, at: str) -> Column:
    stored = scope.words.get(at)
    return F.col(stored) if stored else text.analyze(col)


@dataclass(frozen=True)
class Exists(Predicate):
    path: str

    def column(self, scope: Scope) -> Column:
        if self.path.startswith("@"):
            return _meta(self.path)[0].isNotNull()

        def present(col: Column, f: Field, at: str) -> Column:
            if not f.is_object:
                return col.isNotNull()
            inner = Scope(f.fields, col, at + ".", top=False)
            tests = [Exists(name).column(inner) for name in f.fields]
            return functools.reduce(operator.or_, tests, F.lit(False))

        return some_value(scope, self.path, present)

    def paths(self) -> set[str]:
        return {self.path}


@dataclass(frozen=True)
class Compare(Predicate):
    """One field against one value: equality, ranges and word tests."""

    op: str
    path: str
    value: Any
    regex: bool = False

    def paths(self) -> set[str]:
        return {self.path}

    def column(self, scope: Scope) -> Column:
        if self.path.startswith("@"):
            col, kind = _meta(self.path)
            return self._typed(col, kind)

        def test(col: Column, f: Field, at: str) -> Column:
            if f.is_object:
                raise SpecError(f"{at} is an object")
            if f.is_text:
                return self._text(scope, col, at)
            return self._typed(col, "keyword" if f.type == "long_string" else f.type)

        return some_value(scope, self.path, test)

    def _pattern(self) -> str:
        arg = str(self.value)
        return {"contains": f".*{arg}.*", "startswith": f"{arg}.*", "endswith": f".*{arg}"}.get(self.op, arg)

    def word_pattern(self) -> str | None:
        """The regular expression that has to match a word completely, for the tests that are one."""
        if self.op == "regexp" or (self.regex and self.op in ("contains", "startswith", "endswith")):
            return f"(?iu){self._pattern()}"
        return None

    def _typed(self, col: Column, kind: str | None) -> Column:
        if self.op in ("regexp", "contains", "startswith", "endswith"):
            if kind != "keyword":
                raise SpecError("word tests need a text or keyword field")
            if self.op == "regexp" or self.regex:
                return F.rlike(col, F.lit(f"^(?:{self._pattern()})$"))
            part = F.lit(str(self.value))
            return {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[self.op](col, part)
        value = F.lit(_cast(self.value, kind))
        return _RANGES[self.op](col, value)

    def _text(self, scope: Scope, col: Column, at: str) -> Column:
        if self.op == "equals":
            phrase = F.lit(str(self.value).lower())
            if at in scope.words:
                return text.words_contain_phrase(_words(scope, col, at), text.analyze(phrase))
            return text.text_contains_phrase(col, phrase)
        arg = str(self.value).lower()
        words = _words(scope, col, at)
        if self.word_pattern():
            return text.any_word_matches(words, self.word_pattern())
        found = {"contains": text.any_word_contains, "startswith": text.any_word_starts, "endswith": text.any_word_ends}.get(self.op)
        if found:
            # words are parts of the folded text: it is searched first, so that the costlier split runs on candidates only
            tested = found(words, arg)
            return tested if at in scope.words else F.contains(text.fold(col), F.lit(arg)) & tested
        return F.exists(words, lambda w: _RANGES[self.op](w, F.lit(arg)))


_RANGES: dict[str, Callable] = {
    "equals": operator.eq,
    "gt": operator.gt,
    "gte": operator.ge,
    "lt": operator.lt,
    "lte": operator.le,
}


@dataclass(frozen=True)
class Freetext(Predicate):
    """A phrase in any text leaf in scope, or an equal value in any other leaf that can hold it."""

    value: Any

    def column(self, scope: Scope) -> Column:
        tests: list[Column] = []

        def go(fields: dict[str, Field], prefix: str) -> None:
            for name, f in fields.items():
                if f.is_object:
                    go(f.fields, f"{prefix}{name}.")
                elif f.type == "dense_vector" or not (f.searchable or not f.virtual):
                    continue
                elif f.is_text:
                    tests.append(Compare("equals", prefix + name, self.value).column(scope))
                else:
                    kind = "keyword" if f.type == "long_string" else f.type
                    value = _cast(self.value, kind, lenient=True)
                    if value is not None:
                        tests.append(Compare("equals", prefix + name, value).column(scope))

        go(scope.fields, "")
        if scope.top:
            for path, (_, kind) in META.items():
                value = _cast(self.value, kind, lenient=True)
                if path != "@id" and value is not None:
                    tests.append(Compare("equals", path, value).column(scope))
        return functools.reduce(operator.or_, tests, F.lit(False))


@dataclass(frozen=True)
class And(Predicate):
    items: tuple[Predicate, ...]

    def column(self, scope: Scope) -> Column:
        return functools.reduce(operator.and_, [p.column(scope) for p in self.items], F.lit(True))

    def paths(self) -> set[str]:
        return set().union(*(p.paths() for p in self.items))


@dataclass(frozen=True)
class Or(Predicate):
    items: tuple[Predicate, ...]

    def column(self, scope: Scope) -> Column:
        return functools.reduce(operator.or_, [p.column(scope) for p in self.items], F.lit(False))

    def paths(self) -> set[str]:
        return set().union(*(p.paths() for p in self.items))


@dataclass(frozen=True)
class Not(Predicate):
    items: tuple[Predicate, ...]

    def column(self, scope: Scope) -> Column:
        return ~F.coalesce(Or(self.items).column(scope), F.lit(False))

    def paths(self) -> set[str]:
        return set().union(*(p.paths() for p in self.items))


@dataclass(frozen=True)
class Sub(Predicate):
    """An expression on one element of a collection of objects; on a plain object only a path prefix."""

    path: str
    inner: Predicate

    def column(self, scope: Scope) -> Column:
        def on_element(col: Column, f: Field, at: str) -> Column:
            if not f.is_object:
                raise SpecError(f"{at} has no fields to query")
            return self.inner.column(Scope(f.fields, col, at + ".", scope.words, top=False))

        return some_value(scope, self.path, on_element)

    def paths(self) -> set[str]:
        return {f"{self.path}.{p}" for p in self.inner.paths()}


def exists(path: str) -> Predicate:
    return Exists(path)


def missing(path: str) -> Predicate:
    """No value anywhere: the negation is outside any collection crossed."""
    return Not((Exists(path),))


def equals(path: str, value: Any) -> Predicate:
    return Compare("equals", path, value)


def regexp(path: str, pattern: str) -> Predicate:
    return Compare("regexp", path, pattern)


def contains(path: str, part: str, regex: bool = False) -> Predicate:
    return Compare("contains", path, part, regex)


def startswith(path: str, start: str, regex: bool = False) -> Predicate:
    return Compare("startswith", path, start, regex)


def endswith(path: str, end: str, regex: bool = False) -> Predicate:
    return Compare("endswith", path, end, regex)


def gt(path: str, value: Any) -> Predicate:
    return Compare("gt", path, value)


def gte(path: str, value: Any) -> Predicate:
    return Compare("gte", path, value)


def lt(path: str, value: Any) -> Predicate:
    return Compare("lt", path, value)


def lte(path: str, value: Any) -> Predicate:
    return Compare("lte", path, value)


def freetext(value: Any) -> Predicate:
    return Freetext(value)


def and_(*items: Predicate) -> Predicate:
    return And(items)


def or_(*items: Predicate) -> Predicate:
    return Or(items)


def not_(*items: Predicate) -> Predicate:
    """True when none of the items holds."""
    if not items:
        raise SpecError("not_ needs at least one predicate")
    return Not(items)


def sub(path: str, inner: Predicate) -> Predicate:
    return Sub(path, inner)


def meta(name: str) -> str:
    """The path of a metadata field, to be used with the predicates above."""
    path = "@" + name
    _meta(path)
    return path


def _present(fields: dict[str, Field], dtype: T.DataType) -> dict[str, Field]:
    """The declared fields that the data holds; derived ones may not have been computed."""
    while isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    if not isinstance(dtype, T.StructType):
        return {}
    have = set(dtype.fieldNames())
    return {k: replace(f, fields=_present(f.fields, dtype[k].dataType)) for k, f in fields.items() if k in have}


def compile_predicate(
    predicate: Predicate | None,
    specs: Spec | list[Spec],
    words: dict[str, str] | None = None,
    body: T.StructType | None = None,
) -> Column:
    """One boolean column over an entries DataFrame, to filter by; ``words`` maps text paths to columns of stored
    words. A null counts as false."""
    specs = [specs] if isinstance(specs, Spec) else list(specs)
    if predicate is None:
        return F.lit(True)
    for path in predicate.paths():
        if not path.startswith("@") and ".@" not in path:
            shared_field(specs, path)
    fields = dict(specs[0].fields)
    for spec in specs[1:]:
        for name, f in spec.fields.items():
            fields.setdefault(name, f)
    if body is not None:
        fields = _present(fields, body)
    return predicate.column(Scope(fields, F.col("entry"), words=words or {}))


def matching(
    df: DataFrame, predicate: Predicate | None, specs: Spec | list[Spec], words: dict[str, str] | None = None
) -> DataFrame:
    """Entries for which the predicate holds."""
    if predicate is None:
        return df
    return df.filter(compile_predicate(predicate, specs, words, df.schema["entry"].dataType))
