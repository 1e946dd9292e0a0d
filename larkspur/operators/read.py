"""Reads to DataFrames: scan, policies, filters, page, embeds, projection, aggregates.

The page (filters, order, limit, key) is taken before any embed, so children are fetched for
the page's rows only, at every level. A to-many child is aggregated by its key before it is
joined, so siblings never multiply. One lazy plan comes back. No job runs but one: below a
small page, the keys of children that nothing limits are fetched, up to BROADCAST_PAGE, to
see whether they are few enough to prune the next level by.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.catalog import Catalog, ColumnDef, Context, Name, Relationship, TableDef
from larkspur.errors import bad_request
from larkspur.functions.types import type_of
from larkspur.operators.predicates import condition, conditions, resolve
from larkspur.operators.security import scan
from larkspur.plans.ir import Aggregate, Below, Embed, Everything, Field, Filter, Item, Order, Pick, Read, Tree

#: Keys of at most so many rows are broadcast to prune the children; more are joined by shuffle.
BROADCAST_PAGE = 10_000
#: `page` of rows below a page that no limit bounds.
OPEN = -1


@dataclass(frozen=True)
class Plan:
    """A read in progress: df has the table's columns, unprojected."""

    spark: SparkSession
    catalog: Catalog
    ctx: Context
    most: int | None = None
    source: Callable[[TableDef], DataFrame | None] = lambda t: None

    def base(self, table: TableDef) -> DataFrame:
        return scan(self.spark, self.catalog, table, self.ctx, "select", self.source(table))


def order_columns(table: TableDef, order: tuple[Order, ...], of: str | None = None) -> list[Column]:
    """Nulls are last when ascending and first when descending, unless asked otherwise."""
    out = []
    for o in order:
        col, _, _ = resolve(table, o.field, of)
        nulls = o.nulls or ("first" if o.desc else "last")
        out.append(getattr(col, f"{'desc' if o.desc else 'asc'}_nulls_{nulls}")())
    return out


def is_null_embed(plan: Plan, table: TableDef, tree: Tree) -> Relationship | None:
    """A test of a relation itself: rel=is.null, rel=not.is.null."""
    if isinstance(tree, Filter) and tree.op == "is" and tree.value in ("null", "not_null") and not table.has(tree.field.name) and not tree.field.path:
        return plan.catalog.relationship(table.name, tree.field.name)
    return None


def related(plan: Plan, df: DataFrame, rel: Relationship, child: DataFrame, how: str) -> DataFrame:
    """Rows of df with (left_semi) or without (left_anti) a related row in child."""
    if rel.kind == "m2m":
        assert rel.junction is not None
        link = plan.base(plan.catalog.table(rel.junction.name, rel.junction.schema))
        (pc, jc), (jt, tc) = rel.columns[0], rel.junction_columns[0]
        link = link.select(F.col(jc).alias("_p0"), F.col(jt).alias("_j")).distinct().join(child.select(F.col(tc).alias("_t")).distinct(), F.col("_j") == F.col("_t"), "left_semi").select("_p0")
        return df.join(link, F.col(f"`{pc}`") == F.col("_p0"), how)
    keys = child.select(*[F.col(f"`{c}`").alias(f"_p{i}") for i, (_, c) in enumerate(rel.columns)])
    on = None
    for i, (p, _) in enumerate(rel.columns):
        eq = F.col(f"`{p}`") == F.col(f"_p{i}")
        on = eq if on is None else on & eq
    return df.join(keys, on, how)


def filtered(plan: Plan, table: TableDef, df: DataFrame, where: tuple[Tree, ...]) -> DataFrame:
    for tree in where:
        if rel := is_null_embed(plan, table, tree):
            target = plan.catalog.table(rel.target.name, rel.target.schema)
            absent = (tree.value == "null") != tree.negated  # type: ignore[union-attr]
            df = related(plan, df, rel, plan.base(target), "left_anti" if absent else "left_semi")
        else:
            df = df.where(condition(table, tree))
    return df


def child_rows(plan: Plan, rel: Relationship, embed: Embed, below: dict[tuple[str, ...], Below], path: tuple[str, ...]) -> tuple[TableDef, DataFrame, Below]:
    """The target's rows under the filters for this embed and under its own inner embeds."""
    target = plan.catalog.table(rel.target.name, rel.target.schema)
    own = below.get(path) or below.get((*path[:-1], embed.relation)) or Below()
    child = plan.base(target)
    if rel.compute:
        child = rel.compute(child)
    child = filtered(plan, target, child, own.where)
    for item in embed.items:
        if isinstance(item, Embed) and item.inner:
            r = plan.catalog.relationship(target.name, item.relation, item.hint)
            _, rows, _ = child_rows(plan, r, item, below, (*path, item.name))
            child = related(plan, child, r, rows, "left_semi")
    return target, child, own


def expand(table: TableDef, items: tuple[Item, ...]) -> list[Item]:
    """`*` and nothing at all are every column."""
    out: list[Item] = []
    for item in items or (Everything(),):
        if isinstance(item, Everything):
            out += [Pick(Field(c.name)) for c in table.columns]
        else:
            out.append(item)
    return out


def picked(table: TableDef, item: Pick, of: str | None = None) -> Column:
    col, _, _ = resolve(table, item.field, of)
    if item.cast:
        col = col.cast(type_of(item.cast))
    last = item.field.path[-1][1] if item.field.path else None
    name = item.alias or (str(last) if last is not None else item.field.name)
    return col.alias(name)


def name_of(item: Item) -> str:
    if isinstance(item, Pick):
        return item.alias or (str(item.field.path[-1][1]) if item.field.path else item.field.name)
    if isinstance(item, Aggregate):
        return item.alias or item.func
    if isinstance(item, Embed):
        return item.name
    raise AssertionError(item)


def aggregate_column(table: TableDef, item: Aggregate) -> Column:
    if item.field is None:
        col = F.count(F.lit(1))
    else:
        of, kind, _ = resolve(table, item.field)
        if item.field.path and item.func in ("sum", "avg"):
            of = of.cast("double")
        col = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[item.func](of)
    if item.cast:
        col = col.cast(type_of(item.cast))
    return col.alias(name_of(item))


def grouped(table: TableDef, df: DataFrame, items: list[Item], having: tuple[Tree, ...]) -> DataFrame:
    """Aggregates by every other item. Conditions of `having` name the result's columns."""
    keys = [picked(table, i) for i in items if isinstance(i, Pick)]
    aggs = [aggregate_column(table, i) for i in items if isinstance(i, Aggregate)]
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if having:
        out = out.where(conditions(result_table(out), having))
    return out.select(*[F.col(f"`{name_of(i)}`") for i in items])


def result_table(df: DataFrame) -> TableDef:
    cols = tuple(ColumnDef(f.name, f.dataType, f.nullable) for f in df.schema.fields)
    return TableDef(Name("", "result"), lambda s: df, cols)


def embed(plan: Plan, table: TableDef, df: DataFrame, item: Embed, below: dict[tuple[str, ...], Below], path: tuple[str, ...], page: int | None, out: str) -> DataFrame:
    """df and a column `out`: the related rows as array<struct> (to-many) or a struct or null (to-one)."""
    rel = plan.catalog.relationship(table.name, item.relation, item.hint)
    target, child, own = child_rows(plan, rel, item, below, path)
    items = expand(target, item.items)
    n = len(rel.columns)
    keys = [f"_k{i}_{out}" for i in range(n)]

    if rel.kind == "m2m":
        assert rel.junction is not None
        link = plan.base(plan.catalog.table(rel.junction.name, rel.junction.schema))
        (_, jc), (jt, tc) = rel.columns[0], rel.junction_columns[0]
        key = set(plan.catalog.table(rel.junction.name, rel.junction.schema).pk)
        link = link.select(F.col(f"`{jc}`").alias(keys[0]), F.col(f"`{jt}`").alias("_jt"))
        link = _prune(plan.spark, df, [rel.columns[0][0]], link, keys, page)
        link = link if key and key <= {jc, jt} else link.distinct()
        child = child.join(link, F.col(f"`{tc}`") == F.col("_jt")).drop("_jt")
    else:
        child = child.withColumns({k: F.col(f"`{c}`") for k, (_, c) in zip(keys, rel.columns, strict=True)})
        child = _prune(plan.spark, df, [p for p, _ in rel.columns], child, keys, page)
        child = child.where(F.col(keys[0]).isNotNull())

    limit = own.limit if own.limit is not None else None
    if plan.most is not None and rel.to_many:
        limit = plan.most if limit is None else min(limit, plan.most)
    rank = order_columns(target, own.order) + [F.col(f"`{c}`").asc_nulls_last() for c in target.pk]
    if rel.to_many and (limit is not None or own.offset):
        w = Window.partitionBy(*keys).orderBy(*(rank or [F.lit(0)]))
        child = child.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > own.offset)
        if limit is not None:
            child = child.where(F.col("_n") <= own.offset + limit)

    if any(isinstance(i, Aggregate) for i in items):
        picks = [picked(target, i) for i in items if isinstance(i, Pick)]
        aggs = [aggregate_column(target, i) for i in items if isinstance(i, Aggregate)]
        child = child.groupBy(*keys, *picks).agg(*aggs)
        value = F.struct(*[F.col(f"`{name_of(i)}`") for i in items])
        sort: list[Column] = [F.col(f"`{name_of(i)}`") for i in items if isinstance(i, Pick)]
        ordered = False
    else:
        columns: list[Column] = []
        below_page = None if page is None else page if not rel.to_many or page == OPEN else OPEN if limit is None else page * limit
        for at, i in enumerate(items):
            if isinstance(i, Embed):
                inner = f"_e{at}_{out}"
                if i.spread:
                    child, spread = spread_columns(plan, target, child, i, below, (*path, i.name), below_page, inner)
                    columns += spread
                else:
                    child = embed(plan, target, child, i, below, (*path, i.name), below_page, inner)
                    columns.append(F.col(inner).alias(i.name))
            else:
                columns.append(picked(target, i))  # type: ignore[arg-type]
        value = F.struct(*columns)
        ordered = bool(own.order)
        sort = [F.col(f"`{c}`") for c in target.pk]

    if rel.to_many:
        if ordered:
            child = child.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank)))
            sort = [F.col("_r")]
        tagged = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(sort)], value.alias("v"))
        side = child.select(*keys, tagged.alias("t")).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("t")) if sort and _sortable(child, sort) else child.select(*keys, F.struct(value.alias("v")).alias("t")).groupBy(*keys).agg(F.collect_list("t").alias("t"))
        side = side.select(*keys, F.transform("t", lambda t: t["v"]).alias(out))
    else:
        side = child.select(*keys, value.alias(out))
    joined = df.join(side, _on(rel, keys), "left").drop(*keys)
    if rel.to_many:
        kind = next(f.dataType for f in side.schema.fields if f.name == out)
        joined = joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(kind)))
    return joined


def _sortable(df: DataFrame, sort: list[Column]) -> bool:
    """Arrays of structs are sorted whole: the payload must be orderable, which maps are not."""
    return not any(isinstance(f.dataType, T.MapType) for f in df.schema.fields)


def _on(rel: Relationship, keys: list[str]) -> Column:
    on = None
    for k, (p, _) in zip(keys, rel.columns, strict=True):
        eq = F.col(f"`{p}`") == F.col(k)
        on = eq if on is None else on & eq
    return on


def _prune(spark: SparkSession, df: DataFrame, parents: list[str], child: DataFrame, keys: list[str], page: int | None) -> DataFrame:
    """Children of the page alone, where the page's rows are few by limits, or, where it is OPEN, by count."""
    if page is None:
        return child
    own = df.select(*[F.col(f"`{p}`").alias(f"_q{i}") for i, p in enumerate(parents)]).distinct()
    small = page != OPEN and page <= BROADCAST_PAGE
    if not small:
        found = own.limit(BROADCAST_PAGE + 1).toArrow()
        small = found.num_rows <= BROADCAST_PAGE
        own = spark.createDataFrame(found) if small else own
    on = None
    for i, k in enumerate(keys):
        eq = F.col(k) == F.col(f"_q{i}")
        on = eq if on is None else on & eq
    return child.join(F.broadcast(own) if small else own, on, "left_semi")


def spread_columns(plan: Plan, table: TableDef, df: DataFrame, item: Embed, below: dict, path: tuple[str, ...], page: int | None, out: str) -> tuple[DataFrame, list[Column]]:
    """A to-one relation's columns among the parent's own."""
    rel = plan.catalog.relationship(table.name, item.relation, item.hint)
    if rel.to_many:
        raise bad_request(f"only a to-one relation can be spread, and {item.relation} is to-many")
    target = plan.catalog.table(rel.target.name, rel.target.schema)
    df = embed(plan, table, df, replace(item, spread=False), below, path, page, out)
    names: list[str] = []
    for i in expand(target, item.items):
        names.append(name_of(i))
    return df, [F.col(out)[n].alias(n) for n in names]


def with_relation_order(plan: Plan, table: TableDef, df: DataFrame, order: tuple[Order, ...]) -> tuple[DataFrame, list[Column], list[str]]:
    """Order terms as columns; those of a to-one relation are joined in first. The names of helper columns come back."""
    cols, helpers = [], []
    for i, o in enumerate(order):
        if o.relation is None:
            cols += order_columns(table, (o,))
            continue
        rel = plan.catalog.relationship(table.name, o.relation)
        if rel.to_many:
            raise bad_request(f"cannot order by {o.relation}: it is to-many")
        target = plan.catalog.table(rel.target.name, rel.target.schema)
        name = f"_o{i}"
        keys = [f"{name}_{j}" for j in range(len(rel.columns))]
        value, _, _ = resolve(target, o.field)
        side = plan.base(target).select(*[F.col(f"`{c}`").alias(k) for k, (_, c) in zip(keys, rel.columns, strict=True)], value.alias(name))
        df = df.join(side, _on(rel, keys), "left").drop(*keys)
        helpers.append(name)
        nulls = o.nulls or ("first" if o.desc else "last")
        cols.append(getattr(F.col(name), f"{'desc' if o.desc else 'asc'}_nulls_{nulls}")())
    return df, cols, helpers


def source_rows(plan: Plan, read: Read) -> tuple[TableDef, DataFrame, list[Item]]:
    """Rows under policies, filters and inner embeds: what is counted, before any page."""
    table = plan.catalog.table(read.table, read.schema)
    items = expand(table, read.select)
    df = filtered(plan, table, plan.base(table), read.where)
    for item in items:
        if isinstance(item, Embed) and item.inner:
            rel = plan.catalog.relationship(table.name, item.relation, item.hint)
            _, rows, _ = child_rows(plan, rel, item, read.below, (item.name,))
            df = related(plan, df, rel, rows, "left_semi")
    return table, df, items


def read_frame(plan: Plan, read: Read) -> DataFrame:
    """The result of a read, one lazy plan."""
    read = read.capped(plan.most)
    table, df, items = source_rows(plan, read)
    if any(isinstance(i, Aggregate) for i in items):
        if any(isinstance(i, Embed) for i in items):
            raise bad_request("aggregates and embeds cannot stand side by side at the root")
        out = grouped(table, df, items, read.having)
        if read.order:
            shape = result_table(out)
            out = out.orderBy(*order_columns(shape, read.order))
        return _page(out, read)
    if read.having:
        raise bad_request("having needs an aggregate")
    embeds = any(isinstance(i, Embed) for i in items)
    if read.distinct:
        if embeds:
            raise bad_request("distinct rows cannot have embeds")
        out = df.select(*[picked(table, i) for i in items]).distinct()  # type: ignore[arg-type]
        if read.order:
            out = out.orderBy(*order_columns(result_table(out), read.order))
        return _page(out, read)
    df, order, helpers = with_relation_order(plan, table, df, read.order)
    paged = read.limit is not None or read.offset
    if embeds and paged:  # the page is read for its rows and for its children: both must be the same rows
        order = order + [F.col(f"`{c}`").asc_nulls_last() for c in table.pk]
    if order and (paged or not embeds):
        df = df.orderBy(*order)
    df = _page(df, read)
    page = read.limit if table.pk else None  # without a key to order by, two readings of a page may differ
    columns: list[Column] = []
    for at, item in enumerate(items):
        if isinstance(item, Embed):
            name = f"_e{at}"
            if item.spread:
                df, more = spread_columns(plan, table, df, item, read.below, (item.name,), page, name)
                columns += more
            else:
                df = embed(plan, table, df, item, read.below, (item.name,), page, name)
                columns.append(F.col(name).alias(item.name))
        else:
            columns.append(picked(table, item))  # type: ignore[arg-type]
    if embeds and order:  # a join keeps no order
        df = df.orderBy(*order)
    return df.select(*columns)


def _page(df: DataFrame, read: Read) -> DataFrame:
    if read.offset:
        df = df.offset(read.offset)
    return df if read.limit is None else df.limit(read.limit)


def count_rows(plan: Plan, read: Read, kind: str = "exact") -> int:
    """Rows without the page. planned: the optimizer's estimate; estimated: the exact count up to a threshold, then the estimate."""
    table, df, items = source_rows(plan, read)
    if any(isinstance(i, Aggregate) for i in items):
        df = grouped(table, df, items, read.having)
    elif read.distinct:
        df = df.select(*[picked(table, i) for i in items]).distinct()  # type: ignore[arg-type]
    if kind == "exact":
        return df.count()
    if kind == "estimated":
        n = df.limit(1001).count()
        if n <= 1000:
            return n
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    known = stats.rowCount()
    if known.isDefined():
        return int(str(known.get()))
    row = sum(f.dataType.defaultSize() if hasattr(f.dataType, "defaultSize") else 16 for f in df.schema.fields) + 8
    return int(int(str(stats.sizeInBytes())) / max(row, 1))


