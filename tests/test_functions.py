import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import ApiError
from larkspur.functions import fts, names, ranges, vectors
from larkspur.functions.types import array_items, lit, type_of, value_of
from larkspur.operators.builder import Delete, Insert, Select, Update
from larkspur.operators.predicates import and_all, in_list, or_all
from larkspur.plans.grammar import parse_filter, parse_list, parse_logic, parse_order, parse_query, parse_select
from larkspur.plans.ir import Embed, Everything, Field
from larkspur.plans.request import parse_prefer, parse_range


def test_names():
    assert names.pascal("post_categories") == "PostCategories" and names.camel("post_categories") == "postCategories"
    assert [names.singular(x) for x in ("users", "categories", "boxes", "status", "class")] == ["user", "category", "box", "status", "class"]
    assert [names.plural(x) for x in ("user", "category", "box", "day")] == ["users", "categories", "boxes", "days"]
    assert names.quote("a`b") == "`a``b`" and names.is_keyword("UNION") and names.is_valid("a_1") and not names.is_valid("1a")


def test_values():
    assert array_items('{a,"b,c",NULL,"NULL","x\\"y"}') == ["a", "b,c", None, "NULL", 'x"y']
    assert value_of("{1,2}", type_of("int[]")) == [1, 2] and value_of("ON", type_of("bool")) is True
    for text, kind in (("1.5", "int"), ("300000", "smallint"), ("maybe", "bool"), ("2024-13-01", "date"), ("x", "numeric"), ("{1", "int[]")):
        with pytest.raises(ApiError):
            value_of(text, type_of(kind))
    with pytest.raises(ApiError):
        type_of("no_such")


def test_grammar_errors():
    for text in ("a,", "a(b", "a b)", "sum()", "*x", "a::", "a!inner"):
        with pytest.raises(ApiError):
            parse_select(text)
    for text in ("xx.1", "eq", "is.perhaps", "in.1,2", "in(any).(1)"):
        with pytest.raises(ApiError):
            parse_filter(Field("a"), text)
    assert parse_select("") == () and parse_select("*,r(*)") == (Everything(), Embed("r", (Everything(),)))
    assert parse_list('(a,"b,c", d )') == ["a", "b,c", "d"] and parse_list("()") == []
    assert parse_filter(Field("a"), "not.not.eq.1").negated is False
    assert [(o.field.name, o.desc, o.nulls) for o in parse_order("a.desc.nullslast,b.whatever")] == [("a", True, "last"), ("b", False, None)]
    assert parse_logic("or", "(a.eq.1,not.and(b.gt.2,c.cs.{1,2}))").children[1].negated
    q = parse_query("order=a&order=b.desc&select=x&select=y", "t").read
    assert len(q.order) == 2 and q.select[0].field.name == "y"
    assert parse_query("a=eq.x%26y%3Dz+1", "t").read.where[0].value == "x&y=z+1"
    with pytest.raises(ApiError):
        parse_prefer("handling=strict, nonsense=1")
    assert parse_prefer("return=minimal, count=exact, max-affected=5").max_affected == 5
    assert parse_range("items=5-9") == (5, 5) and parse_range("3-") == (3, None) and parse_range("x") is None


NAME = st.from_regex(r"[a-z][a-z_]{0,6}", fullmatch=True).filter(lambda n: n not in ("sum", "avg", "min", "max", "count", "and", "or", "not"))
VALUE = st.text(st.characters(codec="utf-8", exclude_categories=("Cs",)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(NAME, st.sampled_from(["eq", "neq", "gt", "like", "ilike"]), VALUE, st.booleans())
def test_filters_round_trip(name, op, value, negated):
    f = parse_filter(Field(name), ("not." if negated else "") + f"{op}.{value}")
    assert (f.op, f.value, f.negated) == (op, value, negated)


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUE, min_size=1, max_size=5))
def test_lists_round_trip(values):
    quoted = ",".join('"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' for v in values)
    assert parse_list(f"({quoted})") == values


@settings(max_examples=300, deadline=None)
@given(st.text("abc().,:!*->\"{}[] ", max_size=20))
def test_parsers_fail_cleanly(text):
    for parse in (parse_select, lambda t: parse_logic("and", t), parse_order, lambda t: parse_filter(Field("a"), t)):
        try:
            parse(text)
        except ApiError as e:
            assert e.status == 400


def test_ranges_against_points(spark):
    """Every predicate on small whole-number ranges against the sets of points they hold."""
    texts = ["empty"] + [f"{a}{x},{y}{b}" for a, b in itertools.product("[(", "])") for x, y in itertools.combinations_with_replacement(range(0, 4), 2)] + ["(,2)", "[1,)", "(,)"]
    kind = type_of("int4range")

    def points(t):
        if t == "empty":
            return set()
        lo, hi = t[1:-1].split(",")
        low = -20 if lo == "" else int(lo) + (t[0] == "(")
        high = 20 if hi == "" else int(hi) - (t[-1] == ")")
        return set(range(low, high + 1))

    pairs = [(a, b) for a in texts for b in texts]
    ops = list(ranges.PREDICATES)
    value = spark.range(1).select(*[lit(t, kind).alias(str(i)) for i, t in enumerate(texts)]).first()
    of = dict(zip(texts, value, strict=True))
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("a", kind), T.StructField("b", kind)])
    df = spark.createDataFrame([(i, of[a], of[b]) for i, (a, b) in enumerate(pairs)], schema)
    got = {r.i: r for r in df.select("i", *[ranges.PREDICATES[op](F.col("a"), F.col("b"), T.IntegerType()).alias(op) for op in ops]).collect()}
    for i, (a, b) in enumerate(pairs):
        x, y = points(a), points(b)
        both = bool(x) and bool(y)
        want = {
            "ov": bool(x & y), "cs": y <= x, "cd": x <= y, "sl": both and max(x) < min(y), "sr": both and min(x) > max(y),
            "nxr": both and max(x) <= max(y), "nxl": both and min(x) >= min(y), "adj": both and (max(x) + 1 == min(y) or max(y) + 1 == min(x)),
        }
        for op in ops:
            assert got[i][op] == want[op], (a, op, b)
    with pytest.raises(ApiError):
        lit("[3,1]", kind)


def test_full_text(spark):
    df = spark.createDataFrame([(1, "The quick brown-fox"), (2, "brown quick dogs"), (3, None), (4, "Quicksand; straße é")], "id int, t string")
    found = lambda op, q: [r.id for r in df.where(fts.search(op, F.col("t"), q)).orderBy("id").collect()]
    assert found("plfts", "QUICK brown") == [1, 2] and found("phfts", "brown fox") == [1] and found("phfts", "quick brown") == [1]
    assert found("fts", "quick & !dogs") == [1] and found("fts", "quick:* | fox") == [1, 2, 4] and found("fts", "brown <-> fox") == [1]
    assert found("wfts", '"quick brown" or dogs') == [1, 2] and found("wfts", "quick -fox") == [2] and found("plfts", "straße É") == [4]
    assert found("plfts", "...") == []
    for q in ("a &", "(a", "& b"):
        with pytest.raises(ApiError):
            fts.boolean(F.col("t"), q)
    with pytest.raises(ApiError):
        fts.search("fts", F.col("t"), "a", "klingon")


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id int, v array<float>")
    r = df.orderBy("id").select(vectors.l2(F.col("v"), [0.0, 1.0]).alias("l"), vectors.negative_inner(F.col("v"), [0.0, 1.0]).alias("n"), vectors.cosine(F.col("v"), [0.0, 1.0]).alias("c"), vectors.cosine(F.col("v"), F.col("v")).alias("s")).collect()
    assert [round(x.l, 6) for x in r] == [1.414214, 1.0, 1.0] and [x.n for x in r] == [0.0, -2.0, 0.0] and [x.c for x in r] == [1.0, 0.0, None] and r[0].s == 0.0
    assert [x.id for x in vectors.nearest(df, "v", [0.0, 3.0], 2, "id", "l2").collect()] == [2, 3]


def test_builders(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "a", 7)], "id int, k string, n int")
    q = Select(spark, lambda n: df).from_table_as("t", "x").column_raw(F.sum("n").alias("s")).group_by("k").having("s > 1").order_by("k").limit(5)
    assert [tuple(r) for r in q.build().collect()] == [("a", 12)]
    assert Select(spark, lambda n: df).from_table("t").column("k").distinct().build().count() == 2
    assert [r.id for r in Select(spark, lambda n: df).from_table("t").all_columns().order_by("n", desc=True).offset(1).build().collect()] == [3, 1]
    assert df.where(in_list(F.col("k"), [], T.StringType())).count() == 0 and df.where(and_all([])).count() == 3 and df.where(or_all([])).count() == 0
    new, got = Insert(df, {"k": "z"}).values(id=3, n=1).values(id=4).on_conflict_do_nothing("id").build()
    assert new.count() == 4 and [tuple(r) for r in got.collect()] == [(4, "z", None)]
    new, _ = Insert(df).values(id=3, n=1).on_conflict_do_update(("id",)).build()
    assert sorted(map(tuple, new.collect())) == sorted([(1, "a", 5), (2, "b", None), (3, "a", 1)])
    assert sorted(r.n for r in Update(df).set_raw("n", "n + 1").where("k = 'a'").build()[1].collect()) == [6, 8]
    assert [r.id for r in Delete(df).where("n > 5").build()[0].orderBy("id").collect()] == [1, 2]
    other = spark.createDataFrame([("b",)], "k string")
    assert [r.id for r in Delete(df).using(other, "t.k = u.k").build()[1].collect()] == [2]
