"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

Built-in DataFrame functions only. What is planned is one row per source; documents are
read once for their sizes, and the plan comes back to them as a per-source cut-off.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, keep

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), (3, 2), 2, "mix-17"


def with_order(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs and the columns _size (words), _source (never null) and _at (the seeded order within a source)."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "_source": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")),
            "_at": F.struct(F.md5(F.concat(F.lit(seed + ":"), doc).cast("binary")).alias("k"), F.md5(text.cast("binary")).alias("t")),
        }
    )


def plan_sources(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source: _s (its words), _target, _whole (repetitions of all its documents), _cut (the last _at that gets one more) and, of the equal rows at the cut, how many there are (_ties) and how many of them get it (_take).

    Sources are ordered by code point, null last, and weigh `weights` in turn. The mix has
    share[0]/share[1] of all words. Targets are min(epochs * s, level * weight) with one level
    for all: sorted by the level at which a source is full, the full ones are a prefix, found
    with running sums. The comparison is of whole numbers, so ties are exact. This sorts one
    row per source in a single task, which streams and spills; no document passes through it.

    A source's order is cut into 4096 hash ranges; running sums over ranges, then within
    ranges, so a source with a third of all rows is spread over 4096 groups. Equal rows are
    added up before any window, so a row that is repeated without end is one.
    """
    num, den = share
    unit = lcm(*weights)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    by_range = slim.groupBy("_source", F.substring("_at.k", 1, 3).alias("_range")).agg(F.sum("_size").alias("rs"))
    sources = by_range.groupBy("_source").agg(F.sum("rs").alias("s"))
    turn = (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights)
    sources = sources.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (turn + 1).cast("int")))
    sources = sources.withColumn("full_at", F.col("s") * (F.lit(unit) / F.col("w")).cast("long"))
    before = Window.orderBy("full_at", "_source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("full_at", "_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns({"p": F.coalesce(F.sum("s").over(before), F.lit(0)) * epochs, "w0": F.coalesce(F.sum("w").over(before), F.lit(0)), "all_s": F.sum("s").over(every), "all_w": F.sum("w").over(every)})
    sources = sources.withColumn("full", d("s") * (epochs * den) * (d("all_w") - d("w0")) <= d("w") * (d("all_s") * num - d("p") * den))
    flags = {"fp": F.coalesce(F.sum(F.when(F.col("full"), F.col("s"))).over(every), F.lit(0)) * epochs, "fw": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))}
    sources = sources.withColumns(flags)
    open_target = (F.col("all_s") * num - F.col("fp") * den).cast("double") * F.col("w") / (F.col("all_w") - F.col("fw")).cast("double") / den
    sources = sources.withColumn("target", F.when(F.col("full"), (F.col("s") * epochs).cast("double")).otherwise(open_target))
    sources = sources.withColumn("whole", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(F.lit(0)).cast("int"))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("s"))

    upto = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.withColumn("r0", F.coalesce(F.sum("rs").over(upto), F.lit(0)))
    edge = ranges.join(sources.select("_source", "extra"), "_source").where("r0 <= extra and r0 + rs >= extra").select("_source", "_range", "r0", "extra")
    inside = Window.partitionBy("_source", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.select("_source", F.substring("_at.k", 1, 3).alias("_range"), "_at", "_size").join(edge, ["_source", "_range"])
    rows = rows.groupBy("_source", "_range", "_at", "_size", "r0", "extra").agg(F.count("*").alias("g"))
    rows = rows.withColumn("c", F.col("r0") + F.coalesce(F.sum(F.col("g") * F.col("_size")).over(inside), F.lit(0)))
    # The j-th of equal rows (from 0) is taken while half of it still fits; a quotient that rounding has moved by one is put right.
    fits = lambda j: 2 * (F.col("c") + j * F.col("_size")) + F.col("_size") <= 2 * F.col("extra")
    guess = F.when(F.col("_size") == 0, F.col("g")).otherwise(F.least(F.col("g"), F.floor((2 * F.col("extra") - 2 * F.col("c") + F.col("_size")) / (2 * F.col("_size")))))
    rows = rows.where(fits(F.lit(0))).withColumn("m", F.greatest(F.lit(1), guess))
    more, less = (F.col("m") < F.col("g")) & fits(F.col("m")), ~fits(F.col("m") - 1)
    rows = rows.withColumn("m", F.col("m") + F.when(more, 1).otherwise(0) - F.when(less, 1).otherwise(0))
    cut = rows.groupBy("_source").agg(F.max(F.struct("_at", "g", "m")).alias("edge_cut"))
    least = edge.groupBy("_source").agg(F.min("_range").alias("least"))
    # With no document of the edge range taken, all of the ranges before it are: any key of the edge range is larger than its three digits.
    under = F.struct(F.col("least").alias("k"), F.lit("").alias("t"))
    at_cut = F.coalesce(F.col("edge_cut")["_at"], F.when(F.col("least").isNotNull(), under))
    return sources.join(cut, "_source", "left").join(least, "_source", "left").select("_source", F.col("s").alias("_s"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), at_cut.alias("_cut"), F.coalesce(F.col("edge_cut")["g"], F.lit(0)).alias("_ties"), F.coalesce(F.col("edge_cut")["m"], F.lit(0)).alias("_take"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows, kept, and the column _nth: 0, 1, ... within each _source. Counts by task and running sums over tasks, so any number of equal rows may be one source's."""
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-ties")
    rows = rows.withColumn("_task", F.shiftright("_row", 33))
    counts = rows.groupBy("_source", "_task").agg(F.count("*").alias("_n"))
    # Rows of one task are numbered within it by source; a task's part of a source is at most one task's rows.
    within = F.row_number().over(Window.partitionBy("_source", "_task").orderBy("_row")) - 1
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_source", "_task", ahead.alias("_ahead"))
    return rows.join(bases, ["_source", "_task"]).withColumn("_nth", F.col("_ahead") + within).drop("_row", "_task", "_ahead")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with _copies, how often the mix repeats each document, and _s and _target of its source.

    A source's documents are all repeated `whole` times; the seeded order is then followed
    until half of the next document would overshoot the target, so a source misses its
    target by half a document at most. Of rows with equal doc_id and text as many are taken as
    fit; which of them is open. Null text has size 0; null source is a source of its own; null
    doc_id is a value like any other. An empty table gives an empty table. Other columns pass
    through; the names that begin with an underscore here are reserved.
    """
    ordered = with_order(docs, seed)
    slim = keep(ordered.select("_source", "_at", "_size"), "mix-slim")
    plan = keep(plan_sources(slim, weights, share, epochs), "mix-plan")
    rows = ordered.join(plan, "_source", "left")
    extra = lambda taken: F.col("_whole") + F.when(F.col("_whole") >= epochs, 0).otherwise(F.coalesce(taken.cast("int"), F.lit(0)))
    if plan.where(f"_take < _ties and _whole < {int(epochs)}").limit(1).count() == 0:
        return rows.withColumn("_copies", extra(F.col("_at") <= F.col("_cut")))
    tied = F.coalesce((F.col("_at") == F.col("_cut")) & (F.col("_take") < F.col("_ties")), F.lit(False))
    apart = rows.where(~tied).withColumn("_copies", extra(F.col("_at") <= F.col("_cut")))
    cut = numbered(rows.where(tied))
    return apart.unionByName(cut.withColumn("_copies", extra(F.col("_nth") < F.col("_take"))).drop("_nth"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_s").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").cast("int").alias("copies"))


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix-17:' || coalesce(doc_id::varchar, 'null')) as k, md5(coalesce(text, '')) as t from documents),
s0 as (select source, sum(size)::bigint as s from d group by source),
s1 as (select *, [5, 2, 1][((row_number() over (order by source nulls last)) - 1) % 3 + 1]::bigint as w from s0),
s2 as (select *, s * (10 // w) as full_at from s1),
s3 as (select *, coalesce(sum(s) over b, 0)::bigint * 2 as p, coalesce(sum(w) over b, 0)::bigint as w0, (sum(s) over ())::bigint as all_s, (sum(w) over ())::bigint as all_w
       from s2 window b as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, s::hugeint * 4 * (all_w - w0) <= w::hugeint * (all_s::hugeint * 3 - p::hugeint * 2) as full_ from s3),
s5 as (select *, coalesce(sum(s) filter (where full_) over (), 0)::bigint * 2 as fp, coalesce(sum(w) filter (where full_) over (), 0)::bigint as fw from s4),
s6 as (select *, case when full_ then (s * 2)::double else (all_s * 3 - fp * 2)::double * w / (all_w - fw)::double / 2 end as target from s5),
s7 as (select *, case when s > 0 then floor(target / s)::bigint else 0 end as whole from s6),
c as (select d.*, coalesce(sum(size) over (partition by source order by k, t rows between unbounded preceding and 1 preceding), 0)::bigint as before from d)
select c.doc_id, c.size, s7.s as source_size, s7.target,
       (c.size * (whole + case when whole < 2 and 2 * before + c.size <= 2 * (target - whole * s7.s) then 1 else 0 end))::bigint as taken,
       (whole + case when whole < 2 and 2 * before + c.size <= 2 * (target - whole * s7.s) then 1 else 0 end)::int as copies
from c join s7 on c.source is not distinct from s7.source
"""
