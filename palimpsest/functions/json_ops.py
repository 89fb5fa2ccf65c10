"""JSON text: canonical form, containment, key tests - all as built-in column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(c: Column) -> Column:
    """JSON text with sorted keys, no blanks, last of equal keys lost: two equal documents are equal texts."""
    return F.to_json(F.parse_json(c))


def _path(parts: list[str]) -> str:
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in parts)


def text(c: Column, *keys: str) -> Column:
    """The value at a key path as text, as ``->>`` gives it; null if it is missing or null."""
    return F.get_json_object(c, _path(list(keys)))


def has_key(c: Column, key: str) -> Column:
    """Whether an object has a top-level key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def contains(c: Column, part: object) -> Column:
    """Whether the document holds ``part`` as ``@>`` means it: objects by key, arrays by element, scalars by value."""
    return F.coalesce(_contains(F.try_parse_json(c), [], part), F.lit(False))


def _contains(v: Column, path: list[str], part: object) -> Column:
    at = _path(path)
    here = F.try_variant_get(v, at, "variant")
    if isinstance(part, dict):
        is_object = F.startswith(F.schema_of_variant(here), F.lit("OBJECT"))
        return reduce(lambda a, b: a & b, [_contains(v, [*path, k], x) for k, x in part.items()], F.coalesce(is_object, F.lit(False)))
    if isinstance(part, list):
        items = F.try_variant_get(v, at, "array<variant>")
        ok = items.isNotNull()
        for x in part:
            ok = ok & F.coalesce(F.exists(items, lambda i, x=x: F.coalesce(_contains(i, [], x), F.lit(False))), F.lit(False))
        return ok
    if part is None:
        return F.is_variant_null(here)
    if isinstance(part, bool):
        return (F.schema_of_variant(here) == "BOOLEAN") & (F.try_variant_get(v, at, "boolean") == part)
    if isinstance(part, str):
        return (F.schema_of_variant(here) == "STRING") & (F.try_variant_get(v, at, "string") == part)
    number = F.schema_of_variant(here).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return number & (F.try_variant_get(v, at, "double") == float(part))


def object_text(**columns: Column) -> Column:
    """A JSON object from columns."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def literal(value: object) -> Column:
    return F.lit(json.dumps(value, sort_keys=True, separators=(",", ":")))
