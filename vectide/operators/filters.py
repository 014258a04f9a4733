"""Metadata filters compiled to one boolean column, which the optimizer pushes into the scan where it can.

A condition reads a field path; a missing or null scalar reads as the empty string, so only the existence tests tell
null from a value. Where a condition cannot hold for lack of a value, its column may be null, which a filter, AND and OR
take as false: the plain comparison that is left is what Parquet's statistics can prune by.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {
    "EQUALS", "NOT_EQUALS", "GREATER_THAN", "GREATER_THAN_OR_EQUAL", "LESS_THAN", "LESS_THAN_OR_EQUAL", "CONTAINS",
    "NOT_CONTAINS", "IN", "NOT_IN", "EXISTS", "NOT_EXISTS", "MATCHES_REGEX", "CONTAINS_ALL",
}
SYMBOLS = {"=": "EQUALS", "==": "EQUALS", "!=": "NOT_EQUALS", ">": "GREATER_THAN", ">=": "GREATER_THAN_OR_EQUAL", "<": "LESS_THAN", "<=": "LESS_THAN_OR_EQUAL"}
LISTS = {"IN", "NOT_IN", "CONTAINS_ALL"}
BARE = {"EXISTS", "NOT_EXISTS"}


@dataclass(frozen=True)
class Condition:
    """field is a column or `custom.<key>` of a JSON column; value for most operators, values for lists."""

    field: str
    op: str
    value: str | float | int | bool | None = None
    values: tuple = ()

    def problem(self) -> str | None:
        if not self.field:
            return "a condition needs a field"
        if self.op not in OPERATORS:
            return f"unknown operator {self.op}"
        if self.op in LISTS and not self.values:
            return f"{self.op} needs a list of values"
        if self.op not in LISTS | BARE and self.value is None:
            return f"{self.op} needs a value"
        return None


@dataclass(frozen=True)
class Group:
    """Conditions and groups of any depth, all of them (AND) or one of them (OR); an empty group matches every row."""

    combination: str = "AND"
    conditions: tuple = field(default=())


class Compiler:
    """Compiles filters for one schema. strict: an invalid condition is an error, else it matches nothing."""

    def __init__(self, schema: T.StructType, json_column: str = "custom", strict: bool = True) -> None:
        self.schema, self.json_column, self.strict = schema, json_column, strict

    def resolve(self, path: str) -> tuple[Column, bool]:
        """The field's column, and whether it is an array; null for an unknown field."""
        path = path.removeprefix("metadata.")
        head, _, rest = path.partition(".")
        if head == self.json_column and rest:
            return F.get_json_object(F.col(head), "$." + rest), False
        if head in self.schema.names and not rest:
            return F.col(head), isinstance(self.schema[head].dataType, T.ArrayType)
        return F.lit(None).cast("string"), False

    def condition(self, c: Condition) -> Column:
        if problem := c.problem():
            if self.strict:
                raise ValueError(problem)
            return F.lit(False)
        column, is_array = self.resolve(c.field)
        if is_array:
            return F.coalesce(self._array(column, c), F.lit(False))
        kind = self.schema[c.field.removeprefix("metadata.")].dataType if c.field.removeprefix("metadata.") in self.schema.names else None
        own = column.cast("string")
        text = F.coalesce(own, F.lit(""))
        match c.op:
            case "EQUALS":
                return (own if _text(c.value) else text) == F.lit(_text(c.value))
            case "NOT_EQUALS":
                return text != F.lit(_text(c.value))
            case "CONTAINS":
                return F.contains(text, F.lit(_text(c.value)))
            case "NOT_CONTAINS":
                return ~F.contains(text, F.lit(_text(c.value)))
            case "IN":
                return (text if "" in c.values else own).isin(*map(_text, c.values))
            case "NOT_IN":
                return ~text.isin(*map(_text, c.values))
            case "EXISTS":
                return text != ""
            case "NOT_EXISTS":
                return text == ""
            case "CONTAINS_ALL":
                return reduce(lambda a, b: a & b, [F.contains(text, F.lit(_text(v))) for v in c.values])
            case "MATCHES_REGEX":
                try:
                    re.compile(str(c.value))
                except re.error:
                    return F.lit(False)
                return text.rlike(f"^(?:{c.value})$")
        try:
            bound = float(c.value)
        except (TypeError, ValueError):
            return F.lit(False)
        number = column.cast("double") if isinstance(kind, T.NumericType) else column.try_cast("double")
        ordered = {"GREATER_THAN": number > bound, "GREATER_THAN_OR_EQUAL": number >= bound, "LESS_THAN": number < bound, "LESS_THAN_OR_EQUAL": number <= bound}
        return ordered[c.op]

    def _array(self, column: Column, c: Condition) -> Column:
        has = lambda v: F.array_contains(column, F.lit(_text(v)))
        some = F.coalesce(F.size(column) > 0, F.lit(False))
        match c.op:
            case "CONTAINS" | "EQUALS":
                return has(c.value)
            case "NOT_CONTAINS" | "NOT_EQUALS":
                return ~F.coalesce(has(c.value), F.lit(False))
            case "IN":
                return F.arrays_overlap(column, F.array(*[F.lit(_text(v)) for v in c.values]))
            case "NOT_IN":
                return ~F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(_text(v)) for v in c.values])), F.lit(False))
            case "CONTAINS_ALL":
                return F.size(F.array_except(F.array(*[F.lit(_text(v)) for v in c.values]), column)) == 0
            case "EXISTS":
                return some
            case "NOT_EXISTS":
                return ~some
        return F.lit(False)

    def compile(self, f: Condition | Group) -> Column:
        """Cheap conditions stand before pattern matches inside each group."""
        if isinstance(f, Condition):
            return self.condition(f)
        if f.combination not in ("AND", "OR"):
            raise ValueError(f"unknown combination {f.combination}")
        if not f.conditions:
            return F.lit(True)
        parts = [self.compile(c) for c in sorted(f.conditions, key=cost)]
        return reduce((lambda a, b: a & b) if f.combination == "AND" else (lambda a, b: a | b), parts)


def cost(f: Condition | Group) -> int:
    if isinstance(f, Group):
        return 2
    return 1 if f.op in ("MATCHES_REGEX", "CONTAINS", "NOT_CONTAINS") or "." in f.field.removeprefix("metadata.") else 0


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def apply(df: DataFrame, f: Condition | Group, strict: bool = True) -> DataFrame:
    return df.where(Compiler(df.schema, strict=strict).compile(f))


def parse_json(text: str | dict) -> Condition | Group:
    """{"combination": "AND", "conditions": [{"field", "op", "value" | "values"}, ...]}, nested to any depth."""
    node = json.loads(text) if isinstance(text, str) else text
    if "conditions" in node:
        return Group(node.get("combination", "AND").upper(), tuple(parse_json(c) for c in node["conditions"]))
    op = str(node["op"])
    return Condition(node["field"], SYMBOLS.get(op, op.upper()), node.get("value"), tuple(node.get("values", ())))


LEXEME = re.compile(r"\s*(?:(\()|(\))|(>=|<=|!=|==|=|>|<)|'((?:[^']|'')*)'|([^\s()=<>!,']+)|(,))")


def parse_text(text: str) -> Condition | Group:
    """`a = b AND (c >= 3 OR NOT_IN ...)`: comparisons with symbols or operator names, IN (x, y), EXISTS, AND before OR."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = LEXEME.match(text, at)
        if not m:
            raise ValueError(f"cannot read the filter at {at}: {text[at:at + 20]!r}")
        kind = next(i for i, g in enumerate(m.groups()) if g is not None)
        tokens.append((kind, m.groups()[kind].replace("''", "'") if kind == 3 else m.groups()[kind]))
        at = m.end()
    tokens.append((-1, ""))
    pos = 0

    def take(*wanted: int) -> str:
        nonlocal pos
        kind, value = tokens[pos]
        if wanted and kind not in wanted:
            raise ValueError(f"unexpected {value!r}")
        pos += 1
        return value

    def is_word(w: str) -> bool:
        return tokens[pos][0] == 4 and tokens[pos][1].upper() == w

    def any_of():
        parts = [all_of()]
        while is_word("OR"):
            take()
            parts.append(all_of())
        return parts[0] if len(parts) == 1 else Group("OR", tuple(parts))

    def all_of():
        parts = [single()]
        while is_word("AND"):
            take()
            parts.append(single())
        return parts[0] if len(parts) == 1 else Group("AND", tuple(parts))

    def single():
        if tokens[pos][0] == 0:
            take()
            inner = any_of()
            take(1)
            return inner
        name = take(4)
        op = take(2, 4)
        op = SYMBOLS.get(op, op.upper())
        if op in BARE:
            return Condition(name, op)
        if op in LISTS:
            take(0)
            values = [take(3, 4)]
            while tokens[pos][0] == 5:
                take()
                values.append(take(3, 4))
            take(1)
            return Condition(name, op, values=tuple(values))
        return Condition(name, op, take(3, 4))

    out = any_of()
    take(-1)
    return out


# Time


# The formats of times in text, tried in this order; fractions may have up to nine digits.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]",
    "yyyy-MM-dd",
)


def parse_time(text: Column) -> Column:
    """The first format that fits, UTC where the text names no offset; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def within_duration(a: Column, b: Column, ms: int) -> Column:
    return F.coalesce(F.abs(F.unix_millis(a) - F.unix_millis(b)) <= ms, F.lit(False))


def at_second(a: Column, b: Column) -> Column:
    return F.date_trunc("second", a) == F.date_trunc("second", b)


# Nested JSON


def json_size(value: Column) -> Column:
    """Elements of a JSON array or keys of an object; null for other values and broken text."""
    return F.coalesce(F.json_array_length(value), F.array_size(F.json_object_keys(value)))


def path_exists(value: Column, path: str) -> Column:
    """Whether a JSON text is whole and has something other than the empty string at a path."""
    return F.coalesce(F.try_parse_json(value).isNotNull() & (F.get_json_object(value, path) != ""), F.lit(False))


def subpath_matches(value: Column, path: str, key: str, dumped: str) -> Column:
    """Whether the object at a path has a key whose value, written as JSON, is the given text."""
    inner = F.try_variant_get(F.try_parse_json(F.get_json_object(value, path)), f"$.{key}", "variant")
    return F.coalesce(F.to_json(inner) == dumped, F.lit(False))


def nested_values(value: Column, path: str) -> Column:
    """The elements of the JSON array at a path as texts; a single value is an array of one, nothing an empty one."""
    inner = F.get_json_object(value, path)
    return F.when(inner.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(F.when(inner.startswith("["), inner), "array<string>"), F.array(inner)))


# Full text


def has_all_terms(text: Column, query: str) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a & b, [F.contains(low, F.lit(t.lower())) for t in query.split(" ")]), F.lit(False))


def has_any_term(text: Column, query: str) -> Column:
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in query.split(" ")]), F.lit(False))


def has_phrase(text: Column, phrase: str, case_sensitive: bool = False) -> Column:
    return F.coalesce(F.contains(text, F.lit(phrase)) if case_sensitive else F.contains(F.lower(text), F.lit(phrase.lower())), F.lit(False))


def fuzzy(text: Column, word: str, distance: int = 2) -> Column:
    """Whether a word between single blanks is within the edit distance; words of quite another length are skipped."""
    near = lambda t: F.length(t).between(len(word) - distance, len(word) + distance) & (F.levenshtein(t, F.lit(word)) <= distance)
    return F.coalesce(F.exists(F.split(text, " "), near), F.lit(False))
