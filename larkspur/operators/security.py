"""Row policies and grants, applied at the scan, under every filter of the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.catalog import Catalog, Context, Name, TableDef
from larkspur.errors import ApiError
from larkspur.operators.predicates import or_all


def permitted(catalog: Catalog, name: Name, ctx: Context, command: str) -> None:
    """A 403 where the role has no grant. Without a grant table everything is permitted."""
    if catalog.grants is not None and command not in catalog.grants.get((ctx.role, name), frozenset()):
        raise ApiError("forbidden", "insufficient_privilege", f"permission denied for {name.name}")


def policy(catalog: Catalog, name: Name, ctx: Context, command: str, written: bool = False) -> Column | None:
    """The rows that the role may touch (or, written, may leave): any of its policies for the command. A table with policies hides all rows from roles without one."""
    own = [p for p in catalog.policies if p.table == name]
    if not own:
        return None
    rule = lambda p: p.check(ctx) if written and p.check else p.using(ctx)
    return or_all(F.coalesce(rule(p), F.lit(False)) for p in own if ctx.role in p.roles and p.command in (command, "all"))


def obey(catalog: Catalog, name: Name, ctx: Context, command: str, rows: DataFrame, written: bool = True) -> None:
    """A 403 where any of the rows breaks the role's policies."""
    rule = policy(catalog, name, ctx, command, written)
    if rule is not None and rows.where(~rule).limit(1).count():
        raise ApiError("forbidden", "row_policy", f"a row of {name.name} breaks its row policy")


def visible(catalog: Catalog, name: Name, ctx: Context, rows: DataFrame) -> DataFrame:
    """Those of the rows that the role may see."""
    rule = policy(catalog, name, ctx, "select")
    return rows if rule is None else rows.where(rule)


def scan(spark: SparkSession, catalog: Catalog, table: TableDef, ctx: Context, command: str = "select", df: DataFrame | None = None) -> DataFrame:
    permitted(catalog, table.name, ctx, command)
    df = table.load(spark) if df is None else df
    rule = policy(catalog, table.name, ctx, command)
    return df if rule is None else df.where(rule)
