"""Metadata filters: a list of predicates over a map column, joined by AND or OR, compiled to one Column."""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import to_number


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None


def _text(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else f"{value:g}" if isinstance(value, float) else str(value)


def predicate(f: Filter, metadata: Column) -> Column:
    """One predicate. A field that is missing fails every operator but exists (so also ne and nin)."""
    v = F.element_at(metadata, F.lit(f.field))
    there = F.coalesce(F.map_contains_key(metadata, F.lit(f.field)), F.lit(False))
    if f.op == "exists":
        return there if f.value is True else ~there
    listed = [_text(x) for x in f.value] if isinstance(f.value, (list, tuple)) else None
    number = F.lit(float(f.value) if isinstance(f.value, (int, float)) else 0.0)
    if isinstance(f.value, str):
        number = to_number(F.lit(f.value))
    tests = {
        "eq": lambda: v == _text(f.value),
        "ne": lambda: v != _text(f.value),
        "gt": lambda: to_number(v) > number,
        "gte": lambda: to_number(v) >= number,
        "lt": lambda: to_number(v) < number,
        "lte": lambda: to_number(v) <= number,
        "in": lambda: v.isin(listed) if listed else F.lit(False),
        "nin": lambda: ~v.isin(listed) if listed else F.lit(True),
        "contains": lambda: F.contains(v, F.lit(_text(f.value))),
        "startswith": lambda: F.startswith(v, F.lit(_text(f.value))),
        "endswith": lambda: F.endswith(v, F.lit(_text(f.value))),
    }
    return there & F.coalesce(tests[f.op](), F.lit(False)) if f.op in tests else F.lit(False)


def condition(filters: list[Filter], metadata: Column, logic: str = "and") -> Column:
    """All predicates joined; none is true. Any logic but "or" means AND."""
    if not filters:
        return F.lit(True)
    return functools.reduce(operator.or_ if logic == "or" else operator.and_, [predicate(f, metadata) for f in filters])


def filter_rows(rows: DataFrame, filters: list[Filter], logic: str = "and", column: str = "metadata") -> DataFrame:
    return rows.where(condition(filters, F.col(column), logic))


def parse_filters(text: str) -> list[Filter]:
    """Filters from a JSON list; malformed entries are dropped."""
    try:
        rows = json.loads(text)
    except ValueError:
        return []
    rows = rows if isinstance(rows, list) else []
    return [Filter(r["field"], r["operator"], r.get("value")) for r in rows if isinstance(r, dict) and r.get("field") and r.get("operator")]
