"""JSON text columns: paths, and containment without a UDF."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def step(key: str | int) -> str:
    return f"[{key}]" if isinstance(key, int) else "['" + key.replace("'", "\\'") + "']"


def extract(column: Column, path: tuple[tuple[str, str | int], ...]) -> Column:
    """`->` and `->>` steps: the value's text; after a last `->` strings keep their quotes' meaning as JSON text of objects and arrays."""
    return F.get_json_object(column, "$" + "".join(step(k) for _, k in path))


def _scalar(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def contains(column: Column, value: Any) -> Column:
    """Whether JSON text holds value (@>): objects key by key, arrays element by element, scalars by equality."""

    def at(doc: Column, path: str, v: Any) -> Column:
        if isinstance(v, dict):
            here = F.get_json_object(doc, path).isNotNull()
            for k, x in v.items():
                here = here & at(doc, path + step(k), x)
            return here
        if isinstance(v, list):
            items = F.from_json(F.get_json_object(doc, path), "array<string>")
            out = items.isNotNull()
            for x in v:
                out = out & has(items, x)
            return out
        if v is None:
            return F.get_json_object(F.concat(F.lit('{"x":'), F.coalesce(F.get_json_object(doc, path), F.lit("null")), F.lit("}")), "$.x").isNull()
        return F.get_json_object(doc, path) == F.lit(_scalar(v))

    def has(items: Column, x: Any) -> Column:
        test = (lambda i: at(i, "$", x)) if isinstance(x, (dict, list)) else (lambda i: i == F.lit(_scalar(x)))
        return F.coalesce(F.exists(items, test), F.lit(False))

    return F.coalesce(at(column, "$", value), F.lit(False))


def contained(column: Column, value: Any) -> Column:
    """Whether every key of a JSON object column is in value with that value (<@), one level deep."""
    if not isinstance(value, dict):
        return column == F.lit(_scalar(value))
    fields = F.from_json(column, "map<string,string>")
    known = F.create_map(*[F.lit(y) for k, v in value.items() for y in (k, v if isinstance(v, str) else json.dumps(v))]) if value else F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.forall(F.map_entries(fields), lambda e: F.coalesce(F.try_element_at(known, e["key"]) == e["value"], F.lit(False))), F.lit(False))
