"""Statements built step by step, as DataFrames.

`Select`, `Insert`, `Update` and `Delete` take names, Columns or SQL expressions; each build()
is a lazy DataFrame. Conditions add up with AND.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.names import quote
from larkspur.operators import mutate


def as_column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Select:
    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame] | None = None):
        self.spark, self.tables = spark, tables or spark.table
        self.df: DataFrame | None = None
        self.ctes: dict[str, DataFrame] = {}
        self.columns: list[Column] = []
        self.steps: list[Callable[[DataFrame], DataFrame]] = []
        self.groups: list[Column] = []
        self.havings: list[Column] = []
        self.orders: list[Column] = []
        self.unique, self.n, self.skip = False, None, 0

    def _source(self, name: str) -> DataFrame:
        return self.ctes[name] if name in self.ctes else self.tables(name)

    def with_cte(self, name: str, query: "Select | DataFrame") -> "Select":
        self.ctes[name] = query.build() if isinstance(query, Select) else query
        return self

    def from_table(self, name: str) -> "Select":
        self.df = self._source(name).alias(name)
        return self

    def from_table_as(self, name: str, alias: str) -> "Select":
        self.df = self._source(name).alias(alias)
        return self

    def from_raw(self, query: "str | DataFrame | Select", alias: str = "t") -> "Select":
        """A derived table: a DataFrame, a Select, or SQL over registered views."""
        df = query.build() if isinstance(query, Select) else self.spark.sql(query) if isinstance(query, str) else query
        self.df = df.alias(alias)
        return self

    def all_columns(self) -> "Select":
        self.columns.append(F.col("*"))
        return self

    def all_columns_from(self, alias: str) -> "Select":
        self.columns.append(F.col(f"{alias}.*"))
        return self

    def column(self, name: str) -> "Select":
        self.columns.append(F.col(quote(name)))
        return self

    def column_as(self, name: str, alias: str) -> "Select":
        self.columns.append(F.col(quote(name)).alias(alias))
        return self

    def qualified_column(self, table: str, name: str) -> "Select":
        self.columns.append(F.col(f"{table}.{quote(name)}"))
        return self

    def column_raw(self, expression: Column | str) -> "Select":
        self.columns.append(as_column(expression))
        return self

    def distinct(self) -> "Select":
        self.unique = True
        return self

    def _join(self, table: str | DataFrame, on: Column | str, how: str, alias: str | None) -> "Select":
        side = self._source(table).alias(alias or table) if isinstance(table, str) else table.alias(alias or "j")
        self.steps.append(lambda df: df.join(side, as_column(on), how))
        return self

    def inner_join(self, table: str | DataFrame, on: Column | str, alias: str | None = None) -> "Select":
        return self._join(table, on, "inner", alias)

    def left_join(self, table: str | DataFrame, on: Column | str, alias: str | None = None) -> "Select":
        return self._join(table, on, "left", alias)

    def left_join_lateral(self, subquery: DataFrame, alias: str, on: Column | None = None) -> "Select":
        """subquery may refer to the outer row by .outer() columns."""
        self.steps.append(lambda df: df.lateralJoin(subquery.alias(alias), on, "left"))
        return self

    def where(self, condition: Column | str) -> "Select":
        self.steps.append(lambda df: df.where(as_column(condition)))
        return self

    def group_by(self, *columns: Column | str) -> "Select":
        self.groups += [as_column(c) for c in columns]
        return self

    def having(self, condition: Column | str) -> "Select":
        self.havings.append(as_column(condition))
        return self

    def order_by(self, column: str, desc: bool = False, nulls: str | None = None) -> "Select":
        nulls = nulls or ("first" if desc else "last")
        self.orders.append(getattr(as_column(column), f"{'desc' if desc else 'asc'}_nulls_{nulls}")())
        return self

    def order_by_raw(self, expression: Column | str) -> "Select":
        self.orders.append(as_column(expression))
        return self

    def limit(self, n: int) -> "Select":
        self.n = n
        return self

    def offset(self, n: int) -> "Select":
        self.skip = n
        return self

    def build(self) -> DataFrame:
        if self.df is None:
            raise ValueError("a select needs a source")
        df = functools.reduce(lambda d, s: s(d), self.steps, self.df)
        if self.groups:
            df = df.groupBy(*self.groups).agg(*self.columns)
            if self.havings:
                df = df.where(functools.reduce(operator.and_, self.havings))
        elif self.columns:
            df = df.select(*self.columns)
        if self.unique:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.n is None else df.limit(self.n)


class Insert:
    """values in rows; default_values is one row of defaults. on_conflict decides what happens to keys that exist."""

    def __init__(self, current: DataFrame, defaults: dict[str, Any] | None = None):
        self.current, self.defaults = current, defaults or {}
        self.rows: list[dict] = []
        self.keys: tuple[str, ...] = ()
        self.resolution: str | None = None
        self.set_columns: tuple[str, ...] | None = None

    def values(self, **row: Any) -> "Insert":
        self.rows.append(row)
        return self

    def default_values(self) -> "Insert":
        self.rows.append({})
        return self

    def on_conflict_do_nothing(self, *keys: str) -> "Insert":
        self.keys, self.resolution = keys, "ignore"
        return self

    def on_conflict_do_update(self, keys: tuple[str, ...], columns: tuple[str, ...] | None = None) -> "Insert":
        self.keys, self.resolution, self.set_columns = keys, "merge", columns
        return self

    def build(self) -> tuple[DataFrame, DataFrame]:
        schema = self.current.schema
        data = [tuple(r.get(f.name, self.defaults.get(f.name)) for f in schema.fields) for r in self.rows]
        rows = self.current.sparkSession.createDataFrame(data, schema)
        if self.resolution == "ignore":
            return mutate.ignore_duplicates(self.current, rows, self.keys)
        if self.resolution == "merge":
            used = self.set_columns or tuple(dict.fromkeys(k for r in self.rows for k in r))
            return mutate.merge_duplicates(self.current, rows, self.keys, used)
        return mutate.insert(self.current, rows)


class Update:
    def __init__(self, current: DataFrame):
        self.current, self.sets, self.conditions = current, {}, []

    def set(self, column: str, value: Any) -> "Update":
        self.sets[column] = F.lit(value)
        return self

    def set_raw(self, column: str, expression: Column | str) -> "Update":
        self.sets[column] = as_column(expression)
        return self

    def where(self, condition: Column | str) -> "Update":
        self.conditions.append(as_column(condition))
        return self

    def build(self) -> tuple[DataFrame, DataFrame]:
        return mutate.update(self.current, functools.reduce(operator.and_, self.conditions) if self.conditions else None, self.sets)


class Delete:
    def __init__(self, current: DataFrame):
        self.current, self.conditions, self.other = current, [], None

    def using(self, other: DataFrame, on: Column | str) -> "Delete":
        self.other = (other, as_column(on))
        return self

    def where(self, condition: Column | str) -> "Delete":
        self.conditions.append(as_column(condition))
        return self

    def build(self) -> tuple[DataFrame, DataFrame]:
        if self.other:
            return mutate.delete_using(self.current, *self.other)
        return mutate.delete(self.current, functools.reduce(operator.and_, self.conditions) if self.conditions else None)
