import datetime

import pytest

import feldspar as fs
from feldspar import EngineError, ErrorCode, asc, col, desc, lit
from feldspar import types as t
from feldspar.types import Kind, promote

N = {"id": t.INT32.to_nullable(), "s": t.STRING.to_nullable()}


def frame(spark, rows, schema):
    names = list(schema)
    return fs.from_records([dict(zip(names, r)) for r in rows], schema, spark)


def values(f, *names):
    return sorted((tuple(r[n] for n in names or f.column_names) for r in f.to_list()), key=repr)


def code(call):
    with pytest.raises(EngineError) as e:
        call()
    return e.value.code


@pytest.fixture(scope="module")
def ab(spark):
    return frame(spark, [(1, None), (2, 0), (3, 5), (None, None)], {"a": t.INT32.to_nullable(), "b": t.INT32.to_nullable()})


def test_filter_keeps_the_matching_rows(spark):
    f = frame(spark, [(v,) for v in [1.0, 2, 3, 10, 11, 12, 4, 5, 6]], {"value": t.FLOAT64})
    assert sorted(r["value"] for r in f.filter(col("value").gt(5)).to_list()) == [6, 10, 11, 12]
    assert f.filter(col("value").gt(0)).count() == 9
    assert f.filter(col("value").gt(100)).is_empty()
    assert f.filter_rows(lambda v: v % 2 == 1, "value").count() == 4


def test_two_valued_predicates(ab):
    assert values(ab.filter(col("a").eq(col("b")))) == [(None, None)]
    assert ab.filter(col("a").neq(col("b"))).count() == 3
    assert values(ab.filter(fs.not_(col("b").lt(3))), "a") == [(1,), (3,), (None,)]
    assert values(ab.filter(fs.not_(col("b").between(0, 1))), "a") == [(1,), (3,), (None,)]
    assert ab.filter(fs.and_()).count() == 4 and ab.filter(fs.or_()).count() == 0
    assert ab.filter(col("b").is_null()).count() == 2


def test_predicates_against_plain_python(ab, spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    rows = [(r["a"], r["b"]) for r in ab.to_list()]
    ops = {"eq": lambda x, y: x == y, "neq": lambda x, y: x != y, **{k: (lambda f: lambda x, y: x is not None and y is not None and f(x, y))(f) for k, f in {"lt": int.__lt__, "lte": int.__le__, "gt": int.__gt__, "gte": int.__ge__}.items()}}
    side = st.one_of(st.sampled_from(["a", "b"]), st.integers(0, 5))
    leaf = st.tuples(st.sampled_from(sorted(ops)), side, side)
    tree = st.recursive(leaf, lambda s: st.one_of(st.tuples(st.just("not"), s), st.tuples(st.sampled_from(["and", "or"]), s, s)), max_leaves=5)

    def build(x):
        if x[0] in ops:
            a, b = (col(v) if isinstance(v, str) else lit(v) for v in x[1:])
            return getattr(a, x[0])(b)
        parts = [build(p) for p in x[1:]]
        return fs.not_(*parts) if x[0] == "not" else (fs.and_ if x[0] == "and" else fs.or_)(*parts)

    def holds(x, r):
        if x[0] in ops:
            a, b = (r["ab".index(v)] if isinstance(v, str) else v for v in x[1:])
            return ops[x[0]](a, b)
        parts = [holds(p, r) for p in x[1:]]
        return not parts[0] if x[0] == "not" else all(parts) if x[0] == "and" else any(parts)

    @settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
    @given(tree)
    def check(x):
        assert values(ab.filter(build(x))) == sorted((r for r in rows if holds(x, r)), key=repr)

    check()


def test_negation_is_pushed_down_and_comparisons_reach_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "p"))
    plan = fs.read_parquet(str(tmp_path / "p"), spark).filter(fs.not_(col("id").lt(5))).explain()
    assert "GreaterThanOrEqual(id,5)" in plan


def test_strings_in_predicates(spark):
    f = frame(spark, [(1, "abc"), (2, None), (3, "xbc")], N)
    assert values(f.filter(col("s").contains("bc")), "id") == [(1,), (3,)]
    assert values(f.filter(fs.not_(col("s").starts_with("a"))), "id") == [(2,), (3,)]
    assert code(lambda: f.filter(col("id").contains("1"))) == ErrorCode.TypeMismatch


def test_projection(spark):
    f = frame(spark, [(1, "x")], N)
    assert f.rename({"id": "s", "s": "id", "no": "x"}).to_list() == [{"s": 1, "id": "x"}]
    assert f.select_as([("id", "a"), ("id", "b")]).to_list() == [{"a": 1, "b": 1}]
    assert f.drop("s", "absent").column_names == ["id"]
    assert code(lambda: f.drop("id", "s")) == ErrorCode.EmptySchema
    assert code(lambda: f.select("ID")) == ErrorCode.UnknownColumn
    assert code(lambda: f.select("id", "id")) == ErrorCode.DuplicateColumn
    assert f.with_columns({"id": col("id") + 1, "old": col("id")}).to_list() == [{"id": 2, "s": "x", "old": 1}]


def test_arithmetic_gives_null_instead_of_errors(spark):
    f = frame(spark, [(7, 0), (2**31 - 1, 2), (None, 1)], {"a": t.INT32.to_nullable(), "b": t.INT32})
    g = f.with_columns({"d": fs.div("a", "b"), "m": fs.mod("a", "b"), "p": col("a") + col("b"), "n": fs.neg("a")})
    assert values(g, "d", "m", "p", "n") == sorted([(None, None, 7, -7), (1073741823, 1, None, -(2**31 - 1)), (None, None, None, None)], key=repr)
    assert promote(Kind.Int64, Kind.Float32) is Kind.Float32 and promote(Kind.Int8, Kind.UInt8) is Kind.Int16
    assert code(lambda: f.with_column("x", fs.add("a", lit("s")))) == ErrorCode.TypeIncompatible
    assert code(lambda: f.with_column("x", fs.add("zz", lit(1)))) == ErrorCode.UnknownColumn


def test_casts(spark):
    f = frame(spark, [(i, s) for i, s in enumerate([" 3.7", "zz", "YES", "off", "", None, "12"])], N)
    g = f.with_columns({"i": col("s").cast(t.INT32), "b": col("s").cast(t.BOOLEAN)})
    assert [(r["i"], r["b"]) for r in sorted(g.to_list(), key=lambda r: r["id"])] == [(3, None), (None, None), (None, True), (None, False), (None, None), (None, None), (12, None)]
    h = frame(spark, [(1.0,), (2.5,), (1e30,)], {"x": t.FLOAT64}).with_columns({"s": col("x").cast(t.STRING), "i": col("x").cast(t.INT32), "t": col("x").cast(t.BOOLEAN)})
    assert values(h, "s", "i") == [("1", 1), ("1.0E30", None), ("2.5", 2)]


def test_groups(spark):
    f = frame(spark, [(1, 10.0), (2, 20), (None, 30), (1, 30), (2, 40)], {"k": t.INT32.to_nullable(), "v": t.FLOAT64})
    assert values(f.group_by("k").sum("v")) == sorted([(1, 40.0), (2, 60.0), (None, 30.0)], key=repr)
    assert values(f.group_by("k").count()) == sorted([(1, 2), (2, 2), (None, 1)], key=repr)
    assert f.group_by("k").max("v").column_names == ["k", "max(v)"]
    big = frame(spark, [(9007199254740993, 1.0), (9007199254740994, 1), (9007199254740993, 1)], {"id": t.INT64, "v": t.FLOAT64})
    assert big.group_by("id").count().count() == 2
    assert code(lambda: f.group_by([])) == ErrorCode.EmptySchema
    assert code(lambda: f.group_by("k", [("k", fs.count())])) == ErrorCode.DuplicateColumn
    assert code(lambda: frame(spark, [(1, "x")], N).agg([("x", fs.sum_("s"))])) == ErrorCode.TypeIncompatible


def test_aggregates_without_rows_and_with_nulls(spark):
    f = frame(spark, [(1, None, float("nan")), (2, "b", 1.0), (3, "c", 2.0), (4, None, None)], {"id": t.INT32, "s": t.STRING.to_nullable(), "x": t.FLOAT64.to_nullable()})
    got = f.agg({"f": fs.first("s"), "l": fs.last("s"), "lo": fs.min_("x"), "hi": fs.max_("x"), "n": fs.count("s"), "all": fs.count()}, order_by="id").to_list()
    assert got == [{"f": "b", "l": "c", "lo": 1.0, "hi": 2.0, "n": 2, "all": 4}]
    none = f.filter(lit(False))
    assert none.agg({"n": fs.count(), "s": fs.sum_("id"), "m": fs.max_("s")}).to_list() == [{"n": 0, "s": None, "m": None}]
    assert none.group_by("id").count().is_empty()
    assert (f.min("id"), f.max("id"), f.mean("id")) == (1, 4, 2.5)
    assert f.describe()["id"]["count"] == 4


def test_joins(spark):
    a = frame(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], {"k": t.INT32.to_nullable(), "v": t.STRING})
    b = frame(spark, [(1, "x"), (1, "y"), (None, "z"), (3, "w")], {"k": t.INT32.to_nullable(), "v": t.STRING})
    assert a.inner_join(b, "k").count() == 4 and a.join(b, "k").count() == 7 and a.right_join(b, "k").count() == 6
    assert a.semi_join(b, "k").count() == 2 and a.anti_join(b, "k").count() == 3 and a.cross_join(b).count() == 20
    assert a.inner_join(b, "k").column_names == ["k", "v", "v_right"]
    assert (3, None, "w") in values(a.right_join(b, "k"))
    text = frame(spark, [("1", 9)], {"k": t.STRING, "z": t.INT32})
    assert a.inner_join(text, "k").count() == 2
    assert code(lambda: a.with_column("v_right", lit(1)).inner_join(b, "k")) == ErrorCode.DuplicateColumn
    assert code(lambda: a.inner_join(b, "nope")) == ErrorCode.UnknownColumn


def test_order(spark):
    f = frame(spark, [(1, "b"), (2, None), (3, "A"), (4, "a")], N)
    ids = lambda g: [r["id"] for r in g.to_list()]
    assert ids(f.sort("s")) == [3, 4, 1, 2] and ids(f.sort([desc("s")])) == [1, 4, 3, 2] and ids(f.sort([asc("s", nulls_first=True)]))[0] == 2
    assert ids(f.sort([asc("s", collation="UNICODE")])) == [4, 3, 1, 2]
    ten = fs.Frame(spark.range(1, 11, numPartitions=1))
    assert ids(ten.limit(5)) == [1, 2, 3, 4, 5] and ids(ten.slice(3, 5)) == [4, 5, 6, 7, 8] and ids(ten.tail(2)) == [9, 10] and ids(ten.head())[-1] == 5
    assert code(lambda: f.sort([])) == ErrorCode.InvalidExpression


def test_fills_and_nulls(spark):
    f = frame(spark, [(i, v) for i, v in enumerate([None, 2, None, None, 5, None])], {"i": t.INT32, "v": t.INT32.to_nullable()})
    get = lambda g: [r["v"] for r in sorted(g.to_list(), key=lambda r: r["i"])]
    assert get(f.fill_null_forward("v", "i")) == [None, 2, 2, 2, 5, 5]
    assert get(f.fill_null_backward("v", "i")) == [2, 2, 5, 5, 5, None]
    assert get(f.fill_null("v", 0)) == [0, 2, 0, 0, 5, 0]
    assert f.drop_null().count() == 2 and f.count_nulls().to_list() == [{"i": 0, "v": 4}] and f.has_any_null() and not f.has_any_null("i")
    assert code(lambda: f.fill_null("v", "x")) == ErrorCode.InvalidFillValue


def test_fill_over_many_ranges(spark, monkeypatch):
    from feldspar.operators import cleaning

    monkeypatch.setattr(cleaning, "LEAST", 300)
    f = fs.Frame(spark.range(2000).selectExpr("id", "case when id % 37 = 5 then id end as v"))
    got = {r["id"]: r["v"] for r in f.fill_null_forward("v", "id").to_list()}
    assert got == {i: (i - 5) // 37 * 37 + 5 if i >= 5 else None for i in range(2000)}


def test_unique(spark):
    f = frame(spark, [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], N)
    assert values(f.unique("s", order_by="id"), "id") == [(1,), (3,), (5,)]
    assert values(f.unique("s", keep_first=False, order_by="id"), "id") == [(2,), (4,), (5,)]
    assert f.distinct().count() == 5 and f.count_unique("s") == 3 and f.filter(lit(False)).count_unique("s") == 0


def test_text(spark):
    f = frame(spark, [(1, " \t a.b.a \n"), (2, None)], N).trim("s")
    one = lambda g: g.filter(col("id").eq(1)).to_list()[0]["s"]
    assert one(f) == "a.b.a" and one(f.replace("s", "a", "xy")) == "xy.b.xy" and one(f.replace("s", ".", "", every=False)) == "ab.a"
    assert one(f.pad("s", 8, "*")) == "***a.b.a" and one(f.pad("s", 8, "*", "both")) == "*a.b.a**" and one(f.pad("s", 2)) == "a.b.a"
    assert one(f.substring("s", 2)) == "b.a" and one(f.substring("s", 0, 3)) == "a.b" and one(f.upper("s").lower("s")) == "a.b.a"
    assert code(lambda: f.trim("id")) == ErrorCode.TypeMismatch


def test_concat_and_explode(spark):
    f = frame(spark, [(1, "a")], N)
    assert f.concat(f).count() == 2
    assert code(lambda: f.concat(f.rename({"s": "z"}))) == ErrorCode.SchemaMismatch
    arrays = fs.Frame(spark.createDataFrame([(1, [1, 2])], "id int, a array<int>"))
    assert values(arrays.explode("a")) == [(1, 1), (1, 2)]
    assert code(lambda: f.explode("s")) == ErrorCode.TypeMismatch


def test_csv(spark, tmp_path):
    schema = {"id": t.INT32.to_nullable(), "s": t.STRING.to_nullable(), "ok": t.BOOLEAN.to_nullable(), "d": t.DATE.to_nullable()}
    text = 'h1,h2,h3,h4\r\n1,"x, ""y""",True,2024-01-31\r\n\r\n3.7, z ,no\r\nzz,,1,bad,extra\r\n'
    want = [(1, 'x, "y"', True, datetime.date(2024, 1, 31)), (None, "z", False, None), (None, None, True, None)]
    assert values(fs.from_csv_string(text, schema, spark=spark)) == sorted(want, key=repr)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    assert values(fs.read_csv(str(path), schema, spark=spark)) == sorted(want, key=repr)
    assert fs.read_csv(str(path), schema, skip_rows=1, max_rows=1, projection=[1, 0], spark=spark).column_names == ["s", "id"]
    assert fs.from_csv_string("a\n1\n2\n", {"id": t.INT32}, skip_rows=1, spark=spark).to_list() == [{"id": 2}]


def test_schema_rules():
    assert code(lambda: fs.Schema({})) == ErrorCode.EmptySchema
    assert code(lambda: fs.Schema({"1a": t.INT32})) == ErrorCode.InvalidColumnName
    assert code(lambda: fs.Schema([("a", t.INT32), ("a", t.INT32)])) == ErrorCode.DuplicateColumn
    s = fs.Schema({"a": t.INT32, "b": t.STRING.to_nullable()})
    assert s.format() == "a: int32\nb: string?" and s.rename("a", "c").names == ["c", "b"] and s.drop("a").names == ["b"] and s.row_size == 8
    assert int(ErrorCode.UnknownColumn) == 101 and fs.error_message(ErrorCode.UnknownColumn) == "Unknown column"


def test_pipelines(spark):
    schema = fs.Schema({"k": t.INT32, "v": t.FLOAT64})
    f = frame(spark, [(1, 1.0), (1, 5), (2, 9)], {"k": t.INT32, "v": t.FLOAT64})
    b = fs.from_schema(schema, spark).filter(col("v").gt(2)).group_by("k", {"n": fs.count()})
    r = b.execute(f)
    assert (r.rows_in, r.rows_out) == (3, 2) and b.execute(f).rows_out == 2
    broken = fs.from_schema(schema, spark).select("zz").limit(1)
    assert code(broken.build) == ErrorCode.UnknownColumn
    assert code(fs.from_schema(schema, spark).build) == ErrorCode.InvalidPipeline


def test_looking_at_frames(spark):
    f = frame(spark, [(1, "a"), (2, "b")], N)
    assert "│ id │ s │" in f.show_string(1) and f.show_string(1).endswith("...")
    assert f.filter(lit(False)).show_string() == "Empty frame"
    assert f.dtypes() == {"id": "int32", "s": "string"} and f.format_schema() == "id: int32?\ns: string?"
    assert fs.format_expr(fs.and_(col("a").gt(1), fs.not_(col("b").is_null()))) == "((col(a) > 1) AND not(is_null(col(b))))"
    assert f.collect().count() == 2 and sum(b.num_rows for b in f.batches()) == 2


def test_inference(spark):
    df = frame(spark, [(1, "a")], N).df
    assert fs.infer_expr_type(fs.div("id", lit(2.5)), df) is Kind.Float64 and fs.infer_expr_type(col("id").gt(1), df) is Kind.Boolean
    assert fs.validate_expr(fs.neg("s"), df).code == ErrorCode.TypeIncompatible and fs.validate_expr(col("id").add(1), df) is None
    assert df.select(fs.compile_value(col("id").add(1), df)).first()[0] == 2 and df.where(fs.compile_predicate(col("id").eq(1), df)).count() == 1


def test_stream(spark, tmp_path):
    from feldspar.streaming import run_to_end, stream_parquet

    spark.range(10).write.parquet(str(tmp_path / "in"))
    f = stream_parquet(str(tmp_path / "in"), spark=spark).filter(col("id").gte(7))
    run_to_end(f, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_whole_sort_with_nulls_first(spark):
    from feldspar.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = [tuple(r) for r in QUERIES["q_sort_nulls_whole"](spark, folder).collect()]
    rows = [(r[0], None if r[1] == "F" else r[1]) for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderstatus").collect()]
    want = [r for flag in (None, "P", "O") for r in sorted(x for x in rows if x[1] == flag)]
    assert got == want and len(got) == 1500


def test_csv_in_pieces_equals_csv_at_once(spark):
    import random

    kinds = {"id": t.INT32.to_nullable(), "name": t.STRING, "x": t.FLOAT64}
    text = 'id,name,x\r\n1,"a\n,""b""",1.5\r\n\r\n2,é 漢,\r3,,7\n,last'
    want = [tuple(r.values()) for r in fs.from_csv_string(text, kinds, spark=spark).to_list()]
    assert want == [(1, 'a\n,"b"', 1.5), (2, "é 漢", 0.0), (3, "", 7.0), (None, "last", 0.0)]
    r, data = random.Random(1), text.encode()
    for _ in range(6):
        parser = fs.CsvParser(kinds, spark=spark)
        parser.parse(b"junk to forget")
        parser.reset()
        cuts = [0, *sorted(r.sample(range(1, len(data)), 5)), len(data)]
        parts = [f for f in (*[parser.parse(data[a:b]) for a, b in zip(cuts, cuts[1:])], parser.finish()) if f is not None]
        assert [tuple(x.values()) for f in parts for x in f.to_list()] == want
    assert fs.CsvSource.from_string("a\n1\n2\n3\n", {"a": t.INT32}, max_rows=2, spark=spark).collect().count() == 2
    assert fs.CsvSource.from_string("", {"a": t.INT32}, spark=spark).batches() == [] or fs.from_csv_string("", {"a": t.INT32}, spark=spark).count() == 0


def test_guards_and_values(spark):
    e = fs.col("a").add(1)
    assert fs.is_arithmetic(e) and fs.is_column(e.args[0]) and fs.is_literal(e.args[1]) and fs.is_comparison(e.gt(2)) and fs.is_cast(e.cast(t.INT32))
    assert not any(g(fs.sum_("a")) for g in (fs.is_arithmetic, fs.is_column, fs.is_literal, fs.is_comparison, fs.is_cast))
    f = fs.from_columns({"a": [1, None], "b": [True, None], "s": ["x", None]}, {"a": t.INT64.to_nullable(), "b": t.BOOLEAN.to_nullable(), "s": t.STRING.to_nullable()}, spark)
    assert [str(r["value"]) for e in ("a", "b", "s") for r in f.apply_value(fs.col(e)).to_list()] == ["1.0", "nan", "1.0", "nan", "nan", "nan"]


def test_every_query_has_sql_and_runs(spark):
    """On small tables; the comparison of all with the SQL is the driver's."""
    from feldspar.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "part", "orders", "events"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    for name in ("q_join_anti_rows", "q_cast_string_bool_values", "q_cast_string_numbers", "q_csv_file", "q_csv_defaults", "q_csv_incremental", "q_stream_parquet", "q_apply_value", "q_pad_both"):
        df = QUERIES[name](spark, folder)
        want = con.sql(ORACLE_SQL[name])
        key = lambda r: tuple(map(repr, r))
        assert sorted(map(tuple, df.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key) != [], name
