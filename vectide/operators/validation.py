"""Validation of records: rows keep a list of what is wrong with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.operators.filters import parse_time

STATES = ("active", "archived", "deleted", "draft")


def errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that are true."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))


def vector_errors(dim: int, id_column: str = "id", values: str = "values") -> Column:
    v = F.col(values)
    return errors({
        "no id": F.col(id_column).isNull() | (F.col(id_column) == ""),
        "no values": v.isNull() | (F.size(v) == 0),
        "dimension": v.isNotNull() & (F.size(v) > 0) & (F.size(v) != dim),
        "null element": F.exists(v, lambda x: x.isNull()),
        "not finite": F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))),
    })


@dataclass(frozen=True)
class Rule:
    """What one field must satisfy. Bounds of (0, 0) are no bounds. field: a column, or `column.key...` inside a JSON
    column. items: what each element of an array column must satisfy (lengths, pattern, allowed)."""

    field: str
    kind: str = "STRING"
    required: bool = False
    min_length: int = 0
    max_length: int = 0
    pattern: str = ""
    allowed: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 0.0
    items: Rule | None = None


# Rules of a record's metadata where no others are given. None is required.
DEFAULT_RULES = (
    Rule("owner", max_length=255),
    Rule("category", max_length=100),
    Rule("status", allowed=STATES),
    Rule("metadata_source", max_length=100),
    Rule("created_at", kind="DATETIME"),
    Rule("updated_at", kind="DATETIME"),
    Rule("score", kind="FLOAT", low=0.0, high=1.0),
    Rule("tags", kind="ARRAY", items=Rule("tag", max_length=50)),
    Rule("permissions", kind="ARRAY", items=Rule("permission", max_length=50)),
)


def _value(field: str) -> Column:
    head, _, rest = field.partition(".")
    return F.get_json_object(head, "$." + rest) if rest else F.col(head)


def _text_checks(name: str, text: Column, r: Rule) -> dict[str, Column]:
    checks: dict[str, Column] = {}
    if r.min_length:
        checks[f"{name}: too short"] = F.length(text) < r.min_length
    if r.max_length:
        checks[f"{name}: too long"] = F.length(text) > r.max_length
    if r.pattern:
        checks[f"{name}: pattern"] = ~text.rlike(f"^(?:{r.pattern})$")
    if r.allowed:
        checks[f"{name}: not allowed"] = ~text.isin(*r.allowed)
    return checks


def _some_item(array: Column, r: Rule, check: str) -> Column:
    return F.exists(array, lambda x: F.coalesce(_text_checks(r.field, x.cast("string"), r.items)[check], F.lit(False)))


def schema_errors(rules: Sequence[Rule]) -> Column:
    """What is wrong with a row. Texts that are no times are only warned of (see schema_warnings)."""
    checks: dict[str, Column] = {}
    for r in rules:
        c = _value(r.field)
        if r.kind == "ARRAY":
            if r.required:
                checks[f"{r.field}: missing"] = c.isNull() | (F.size(c) == 0)
            for name in _text_checks(r.field, F.lit(""), r.items) if r.items else ():
                checks[name + " (item)"] = _some_item(c, r, name)
            continue
        text = c.cast("string")
        if r.required:
            checks[f"{r.field}: missing"] = c.isNull() | (text == "")
        checks |= _text_checks(r.field, text, r)
        if r.kind in ("INTEGER", "FLOAT"):
            number = c.try_cast("double")
            checks[f"{r.field}: no number"] = c.isNotNull() & number.isNull()
            if (r.low, r.high) != (0.0, 0.0):
                checks[f"{r.field}: out of range"] = (number < r.low) | (number > r.high)
    return errors(checks)


def schema_warnings(rules: Sequence[Rule]) -> Column:
    """What is odd about a row without making it bad: times that cannot be read."""
    return errors({f"{r.field}: no time": _value(r.field).isNotNull() & parse_time(_value(r.field).cast("string")).isNull() for r in rules if r.kind == "DATETIME"})


def split_valid(df: DataFrame, wrong: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their errors."""
    marked = df.withColumn("errors", wrong)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)
