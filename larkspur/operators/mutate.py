"""Mutations as pure functions of a table's rows, and a versioned store that commits them.

Each takes the current rows and gives (new rows, affected rows). Nothing is written until the
store commits, after keys, references and required columns have been checked.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Context, Name, TableDef
from larkspur.errors import ApiError, bad_request
from larkspur.functions.types import lit
from larkspur.operators.predicates import conditions
from larkspur.operators.security import policy
from larkspur.plans.ir import Tree


def _same(a: str, b: str, keys: Iterable[str]) -> Column:
    out = None
    for k in keys:
        eq = F.col(f"{a}.`{k}`") == F.col(f"{b}.`{k}`")
        out = eq if out is None else out & eq
    if out is None:
        raise bad_request("a conflict needs key columns")
    return out


def insert(current: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return current.unionByName(rows, allowMissingColumns=True), rows


def ignore_duplicates(current: DataFrame, rows: DataFrame, keys: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys exist, or came earlier among rows, are left out."""
    keys = list(keys)
    fresh = rows.alias("n").join(current.alias("o"), _same("n", "o", keys), "left_anti").dropDuplicates(keys)
    return current.unionByName(fresh), fresh


def merge_duplicates(current: DataFrame, rows: DataFrame, keys: Iterable[str], columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Insert, or set `columns` to the new values where the keys exist. Other columns keep their old values."""
    keys, columns = list(keys), set(columns)
    old = current.alias("o")
    merged = rows.alias("n").join(old, _same("n", "o", keys), "left")
    hit = F.col(f"o.`{keys[0]}`").isNotNull()
    after = merged.select(*[(F.col(f"n.`{c}`") if c in columns or c in keys else F.when(hit, F.col(f"o.`{c}`")).otherwise(F.col(f"n.`{c}`"))).alias(c) for c in current.columns])
    rest = old.join(rows.alias("n"), _same("o", "n", keys), "left_anti")
    return rest.unionByName(after), after


def update(current: DataFrame, where: Column | None, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """A condition that is null touches nothing."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    set_to = {c: v.cast(current.schema[c].dataType) for c, v in values.items()}
    after = current.select(*[(F.when(hit, set_to[c]).otherwise(F.col(f"`{c}`")) if c in set_to else F.col(f"`{c}`")).alias(c) for c in current.columns])
    touched = current.where(hit).select(*[(set_to[c] if c in set_to else F.col(f"`{c}`")).alias(c) for c in current.columns])
    return after, touched


def partial_update(current: DataFrame, where: Column | None, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Values that are null leave the column as it is."""
    return update(current, where, {c: F.coalesce(v, F.col(f"`{c}`")) for c, v in values.items()})


def delete(current: DataFrame, where: Column | None) -> tuple[DataFrame, DataFrame]:
    """Rows whose condition is null stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return current.where(~hit), current.where(hit)


def delete_using(current: DataFrame, using: DataFrame, on: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE ... USING: rows that match any row of `using`. Name the sides t and u in `on`."""
    t, u = current.alias("t"), using.alias("u")
    return t.join(u, on, "left_anti"), t.join(u, on, "left_semi")


@dataclass
class Store:
    """The current version of each written table; others are read from where their catalog says.

    With a folder a commit writes a new Parquet version and old versions stay readable; without
    one the lazy plan is the version (for small tables and tests).
    """

    spark: SparkSession
    folder: str | None = None
    versions: dict[Name, list[DataFrame]] = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock)

    def rows(self, table: TableDef) -> DataFrame:
        held = self.versions.get(table.name)
        return held[-1] if held else table.load(self.spark)

    def written(self, table: TableDef) -> DataFrame | None:
        held = self.versions.get(table.name)
        return held[-1] if held else None

    def commit(self, table: TableDef, new: DataFrame) -> DataFrame:
        with self.lock:
            held = self.versions.setdefault(table.name, [table.load(self.spark)])
            if self.folder:
                path = f"{self.folder}/{table.name.schema}.{table.name.name}/v{len(held):06d}-{uuid.uuid4().hex[:8]}"
                new.write.parquet(path)
                new = self.spark.read.schema(new.schema).parquet(path)
            held.append(new)
            return new


def check(catalog: Catalog, store: Store, table: TableDef, new: DataFrame, affected: DataFrame) -> None:
    """Required columns, the primary key, and foreign keys of the affected rows; a violation is a 409."""
    required = [c.name for c in table.columns if not c.nullable]
    if required:
        bad = affected.where(" or ".join(f"`{c}` is null" for c in required)).limit(1).collect()
        if bad:
            missing = next(c for c in required if bad[0][c] is None)
            raise ApiError("conflict", "not_null_violation", f"null value in column {missing} of {table.name.name}")
    if table.pk:
        keys = affected.select(*table.pk).distinct()
        twice = new.join(keys, list(table.pk), "left_semi").groupBy(*table.pk).count().where("count > 1").limit(1).collect()
        if twice:
            raise ApiError("conflict", "unique_violation", f"duplicate key in {table.name.name}", details=", ".join(f"{k}={twice[0][k]}" for k in table.pk))
    for rel in catalog.relationships:
        if rel.table == table.name and rel.kind in ("m2o", "o2o") and not rel.constraint.startswith("_"):
            target = catalog.tables.get(rel.target)
            if target is None or (rel.kind == "o2o" and tuple(c for c, _ in rel.columns) == table.pk and tuple(c for _, c in rel.columns) != target.pk):
                continue
            if rel.kind == "o2o" and not _refers(catalog, rel):
                continue
            other = new if rel.target == table.name else store.rows(target)
            on = None
            for a, b in rel.columns:
                eq = F.col(f"n.`{a}`") == F.col(f"p.`{b}`")
                on = eq if on is None else on & eq
            orphans = affected.alias("n").where(" and ".join(f"`{a}` is not null" for a, _ in rel.columns)).join(other.alias("p"), on, "left_anti").limit(1).collect()
            if orphans:
                raise ApiError("conflict", "foreign_key_violation", f"{table.name.name} refers to a missing row of {target.name.name}", details=rel.constraint)


def restrict(catalog: Catalog, store: Store, table: TableDef, old: DataFrame, new: DataFrame, changed: Iterable[str] | None = None) -> None:
    """Rows of other tables that refer to keys of `old` which `new` no longer has are a 409. changed: the columns that can differ, all if not given."""
    for rel in catalog.relationships:
        if rel.target != table.name or rel.kind not in ("m2o", "o2o") or (rel.kind == "o2o" and not _refers(catalog, rel)):
            continue
        if changed is not None and not {b for _, b in rel.columns} & set(changed):
            continue
        child = catalog.tables.get(rel.table)
        if child is None or child.is_view:
            continue
        keys = [F.col(f"`{b}`").alias(f"_k{i}") for i, (_, b) in enumerate(rel.columns)]
        names = [f"_k{i}" for i in range(len(keys))]
        gone = old.select(*keys).join(new.select(*keys), names, "left_anti")
        rows = new if rel.table == table.name else store.rows(child)
        left = rows.select(*[F.col(f"`{a}`").alias(k) for k, (a, _) in zip(names, rel.columns, strict=True)]).join(gone, names, "left_semi").limit(1).collect()
        if left:
            raise ApiError("conflict", "foreign_key_violation", f"{child.name.name} still refers to {table.name.name}", details=rel.constraint)


def _refers(catalog: Catalog, rel) -> bool:
    """Of a one-to-one pair, the direction that was declared first is the reference."""
    same = [r for r in catalog.relationships if r.constraint == rel.constraint]
    return bool(same) and same[0] is rel


def where_of(catalog: Catalog, table: TableDef, trees: tuple[Tree, ...], ctx: Context, command: str) -> Column | None:
    """The request's conditions and the role's policies: what it may not see, it cannot change or delete either."""
    out = conditions(table, trees)
    for rule in (policy(catalog, table.name, ctx, c) for c in (command, "select")):
        if rule is not None:
            out = rule if out is None else out & rule
    return out


def values_of(table: TableDef, row: dict) -> dict[str, Column]:
    import json

    out = {}
    for k, v in row.items():
        c = table.column(k)
        if c.json and v is not None and not isinstance(v, str):
            v = json.dumps(v)
        out[k] = F.lit(None).cast(c.type) if v is None else lit(v, c.type)
    return out
