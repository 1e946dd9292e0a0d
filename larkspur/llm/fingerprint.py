"""Threshold-scaled document sketches: every 5-word shingle hash in a fixed fraction of the hash range is retained.

Built-in functions only. Sketches of one fraction merge by union, and the share of a small
document's sketch that a large one holds estimates how much of it the large one contains,
however unequal the two are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, keep

#: A hash is retained if, as a signed number, it is in [0, 2^62): a quarter of all hashes.
LIMIT = 1 << 62
SHINGLE, ROWS_PER_RANGE, QUANTILES, MOST_RANGES = 5, 16384, 256, 1 << 20


def _retained(g: Column) -> Column:
    """The hashes under the limit; where there is none, the smallest one, which is known for a stand-in by its value."""
    return _bind(F.filter(g, lambda h: (h >= 0) & (h < LIMIT)), lambda k: F.when((F.size(k) > 0) | (F.size(g) == 0), k).otherwise(F.array(F.array_min(g))))


def _bind(value: Column, body) -> Column:
    """A step bound through a one-element array, so that it is not computed twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column) -> Column:
    """array<bigint>: the retained 64-bit hashes, distinct and sorted.

    A text of fewer than five words is one shingle. The smallest hash stands in where none is
    retained, so only texts without words (null, empty, white space) have an empty sketch; in
    a merge it gives way to any retained hash, so merged sketches are those of the union.
    """
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))

    def of(h: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        few = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) == 0, empty).when(F.size(h) < SHINGLE, few).otherwise(_bind(grams(h), _retained))

    return F.array_sort(F.array_distinct(_bind(hashes, of)))


def as_text(sk: Column) -> Column:
    """Sixteen hexadecimal digits for each retained hash."""
    return F.array_join(F.transform(sk, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge(a: Column, b: Column) -> Column:
    """The sketch of the shingles of two documents taken together."""
    return F.array_sort(_bind(F.array_union(a, b), _retained))


def containment(a: Column, b: Column) -> Column:
    """Share of a's sketch that b holds; 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger one, 0 to 1."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def _ranges(docs: DataFrame) -> Column:
    """A number for each row's range, rising with doc_id (null first), and within a hot doc_id with the text's hash.

    doc_id is cut at approximate quantiles, each a literal, and between two of them evenly; a
    doc_id that takes up several quantiles, and null, are cut by the hash of the text.
    """
    n, nulls, low, high, quantiles = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(1, QUANTILES)], 20_000)).first()
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE)
    if ranges < 2:
        return F.lit(0).cast("bigint")
    top = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 32)  # the hash's order, as 32 bits
    by_hash = lambda k: F.shiftright(top * F.lit(k).cast("bigint"), 32)
    none = by_hash(max(1, ranges * nulls // n))
    if low is None:
        return none
    bounds = sorted(set(quantiles))
    hot = [b for b in bounds if quantiles.count(b) > 1]
    i = F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in bounds]), lambda b: b < F.col("doc_id")))
    edge = lambda xs: F.get(F.array(*[F.lit(float(x)) for x in xs]), i)
    start, stop = edge([low, *bounds]), edge([*bounds, max(high, bounds[-1])])
    each = -(-ranges // QUANTILES)
    even = F.least(F.lit(each - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id").cast("double") - start) / (stop - start + 1) * each)))
    is_hot = F.col("doc_id").isin(hot) if hot else F.lit(False)
    own = (2 * i + F.when(is_hot, 1).otherwise(0)).cast("bigint") * (1 << 32) + F.when(is_hot, by_hash(ranges)).otherwise(even)
    return F.when(F.col("doc_id").isNull(), none).otherwise(own + (1 << 32))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with sk, next_text and next_sk: those of the next document by doc_id, the first after the last.

    Null doc_ids come first; equal ones are ordered by text. Windows work inside ranges of some
    ROWS_PER_RANGE rows (more, beyond MOST_RANGES of them); the last row of a range takes the
    first row of the next one from a table with one row a range, which is broadcast at most at
    MOST_RANGES numbers.
    """
    docs = docs.withColumn("range", _ranges(docs))
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = keep(docs.groupBy("range").agg(F.min(least).alias("first_id")).withColumnRenamed("range", "own"), "fp-ranges")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    heads = docs.join(F.broadcast(ids), (F.col("range") == F.col("own")) & (least == F.col("first_id"))).select("own", "doc_id", "text")
    heads = heads.withColumn("i", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where("i = 1")
    line = Window.orderBy("own")  # over ranges, never over documents
    before = F.coalesce(F.lag("own").over(line), F.last("own").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.join(F.broadcast(ids.select("own", before.alias("before"))), "own")
    heads = keep(heads.select(F.col("before").alias("range"), F.struct("text", sketch(F.col("text")).alias("sk")).alias("head")), "fp-heads")
    # Only texts are shuffled; the second window finds its rows sorted.
    w = Window.partitionBy("range").orderBy(*order)
    rows = docs.withColumn("next_text", F.lead("text").over(w)).withColumn("sk", sketch(F.col("text")))
    rows = rows.withColumn("next_sk", F.lead("sk").over(w)).join(heads, "range", "left")
    return rows.select("doc_id", "text", "sk", F.coalesce("next_text", "head.text").alias("next_text"), F.coalesce("next_sk", "head.sk").alias("next_sk"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document. Null text counts as empty; null doc_ids come first; repeated
    rows follow each other; an empty table gives an empty table; only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sk", "next_sk", sketch(F.col("edited")).alias("edited_sk"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sk")).alias("fingerprint"), as_text(F.col("edited_sk")).alias("edited_fingerprint"), likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"))


def op9_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
