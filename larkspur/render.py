"""Results as JSON, CSV and single values, and the headers about them."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import ApiError


class Number(float):
    """A number with its digits as they are."""

    def __new__(cls, digits: str):
        n = super().__new__(cls, digits)
        n.digits = digits
        return n

    def __repr__(self) -> str:
        return self.digits


def value(v: Any, kind: T.DataType, json_text: bool = False) -> Any:
    """A cell as a JSON value: exact decimals, ISO times, nested rows; not-a-number is null."""
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return row(v, kind)
    if isinstance(kind, T.ArrayType):
        return [value(x, kind.elementType) for x in v]
    if isinstance(kind, T.MapType):
        return {str(k): value(x, kind.valueType) for k, x in v.items()}
    if isinstance(v, Decimal):
        return Number(format(v, "f"))
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dt.datetime):
        if isinstance(kind, T.TimestampType):
            return v.astimezone(dt.timezone.utc).isoformat()
        return v.isoformat()
    if isinstance(v, (dt.date, dt.time)):
        return v.isoformat()
    if isinstance(v, dt.timedelta):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return "\\x" + bytes(v).hex()
    if json_text and isinstance(v, str):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v


def row(r: Row, kind: T.StructType, json_columns: frozenset[str] = frozenset()) -> dict[str, Any]:
    return {f.name: value(r[i], f.dataType, f.name in json_columns) for i, f in enumerate(kind.fields)}


def rows(df: DataFrame, json_columns: frozenset[str] = frozenset(), stream: bool = False) -> Any:
    """Result rows on the driver; with stream one partition at a time, for results that are large."""
    schema = df.schema
    source = df.toLocalIterator(prefetchPartitions=True) if stream else df.collect()
    it = (row(r, schema, json_columns) for r in source)
    return it if stream else list(it)


def row_json(df: DataFrame, key_order: str = "sorted", strip: bool = False) -> Column:
    """Each row as JSON text, made by the executors."""
    names = sorted(df.columns) if key_order == "sorted" else df.columns
    return F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]), {"ignoreNullFields": str(strip).lower()})


def strip_nulls(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: strip_nulls(x) for k, x in v.items() if x is not None}
    return [strip_nulls(x) for x in v] if isinstance(v, list) else v


def dumps(v: Any, key_order: str = "sorted") -> str:
    """Keys in alphabetical order, or with 'select' in the order of the result's columns."""
    return json.dumps(v, ensure_ascii=False, sort_keys=key_order == "sorted", separators=(",", ":"))


def singular(found: list[dict], nullable: bool = False) -> dict | None:
    if len(found) == 1:
        return found[0]
    if not found:
        if nullable:
            return None
        raise ApiError("not_found", "no_rows", "the result has no row, and one was asked for")
    raise ApiError("not_acceptable", "many_rows", "the result has several rows, and one was asked for")


def singular_or_null(found: list[dict]) -> Any:
    return None if not found else found[0] if len(found) == 1 else found


def to_csv(found: list[dict]) -> str:
    """A header from the first row's keys; nulls empty; nothing of no rows."""
    if not found:
        return ""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(found[0])
    for r in found:
        w.writerow(["" if v is None else dumps(v) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else v for v in r.values()])
    return out.getvalue()


def content_range(offset: int, returned: int, total: int | None = None) -> str:
    span = f"{offset}-{offset + returned - 1}" if returned else "*"
    return f"{span}/{'*' if total is None else total}"


def explain(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def status_of(returned: int, total: int | None, limited: bool) -> int:
    """206 for a part of a counted result."""
    return 206 if total is not None and limited and returned < total else 200
