"""JSON and array functions on columns of JSON text and arrays."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_text(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def has_key(c: Column, key: str) -> Column:
    """True for a key whose value is JSON null, too, and for keys with dots or quotes."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def has_any_key(c: Column, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(c), F.array(*map(F.lit, keys))), F.lit(False)) if keys else F.lit(False)


def has_all_keys(c: Column, keys: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(c))) == 0, F.lit(False)) if keys else c.isNotNull()


def _step(key: str) -> str:
    return "['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _inside(variant: Column, path: str, want: Any) -> Column:
    """Whether what stands at ``path`` of a variant contains ``want``: objects by their keys, arrays by their elements, scalars by equality."""
    if isinstance(want, dict):
        there = F.schema_of_variant(F.variant_get(variant, path, "variant")).startswith("OBJECT")
        return reduce(lambda a, b: a & b, [_inside(variant, path + _step(k), v) for k, v in want.items()], there)
    if isinstance(want, list):
        own = F.variant_get(variant, path, "array<variant>") if path != "$" else F.try_variant_get(variant, "$", "array<variant>")
        there = F.schema_of_variant(F.variant_get(variant, path, "variant")).startswith("ARRAY")
        return reduce(lambda a, b: a & b, [F.exists(own, _contains(v)) for v in want], there)
    at = F.variant_get(variant, path, "variant")
    if want is None:
        return F.is_variant_null(at)
    if isinstance(want, bool):
        return (F.schema_of_variant(at) == "BOOLEAN") & (F.try_variant_get(variant, path, "boolean") == F.lit(want))
    if isinstance(want, str):
        return (F.schema_of_variant(at) == "STRING") & (F.try_variant_get(variant, path, "string") == F.lit(want))
    return ~F.schema_of_variant(at).isin("STRING", "BOOLEAN") & (F.try_variant_get(variant, path, "double") == F.lit(float(want)))


def _contains(want: Any):
    return lambda element: F.coalesce(_inside(element, "$", want), F.lit(False))


def contains(c: Column, want: Any) -> Column:
    """Containment: every part of ``want`` (a value or JSON text) is found in the column's value. Malformed text contains nothing."""
    want = json.loads(want) if isinstance(want, str) else want
    return F.coalesce(_inside(F.try_parse_json(c), "$", want), F.lit(False))


def array_has(c: Column, value: Any) -> Column:
    return F.array_contains(c, value)
