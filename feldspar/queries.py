"""One query for each operator of the library, and the same as SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types as t
from .functions import Expr, and_, avg, coalesce, col, count, div, first, last, lit, max_, min_, mod, mul, neg, not_, or_, sub, sum_, typed_lit
from .operators import Frame, agg, asc, concat, desc, inner_join, left_join
from .plans.pipeline import Pipeline, from_schema
from .schema import Schema
from .sources import CsvParser, CsvSource, empty, from_batches, from_columns, from_csv_string, from_records, parquet_schema, read_csv, read_parquet
from .streaming import run_to_end, stream_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *tables: str):
    """Registers a function of frames of the tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_parquet(f"{sf_dir}/{x}.parquet", spark) for x in tables]).df
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- filters


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount <= 0.02", "lineitem")
def q_filter_cmp(f):
    return f.filter(and_(col("l_quantity").gt(45), col("l_discount").lte(0.02))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice between 2000 and 3000", "lineitem")
def q_filter_between(f):
    return f.filter(col("l_extendedprice").between(2000, 3000)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select l_orderkey, l_linenumber from lineitem where not ((l_quantity < 10 or l_returnflag = 'R') and l_tax >= 0.03)", "lineitem")
def q_filter_and_or_not(f):
    return f.filter(not_(and_(or_(col("l_quantity").lt(10), col("l_returnflag").eq("R")), col("l_tax").gte(0.03)))).select("l_orderkey", "l_linenumber")


def _with_null(f: Frame) -> Frame:
    """o_flag: the order's status, null for F."""
    return Frame(f.df.selectExpr("*", "nullif(o_orderstatus, 'F') as o_flag"))


@query("select o_orderkey, nullif(o_orderstatus, 'F') as o_flag from orders where nullif(o_orderstatus, 'F') is distinct from 'O'", "orders")
def q_filter_neq_nullsafe(f):
    return _with_null(f).filter(col("o_flag").neq("O")).select("o_orderkey", "o_flag")


@query("select o_orderkey from orders where coalesce(not (nullif(o_orderstatus, 'F') < 'P'), true)", "orders")
def q_filter_not_keeps_null(f):
    return _with_null(f).filter(not_(col("o_flag").lt("P"))).select("o_orderkey")


@query("select o_orderkey from orders where nullif(o_orderstatus, 'F') is null", "orders")
def q_filter_is_null(f):
    return _with_null(f).filter(col("o_flag").is_null()).select("o_orderkey")


@query("select p_partkey, p_name from part where contains(p_name, 'a')", "part")
def q_filter_contains(f):
    return f.filter(col("p_name").contains("a")).select("p_partkey", "p_name")


@query("select p_partkey, p_type from part where p_type like 'S%'", "part")
def q_filter_startswith(f):
    return f.filter(col("p_type").starts_with("S")).select("p_partkey", "p_type")


@query("select c_custkey, c_name from customer where c_name like '%7'", "customer")
def q_filter_endswith(f):
    return f.filter(col("c_name").ends_with("7")).select("c_custkey", "c_name")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity % 7 = 0", "lineitem")
def q_filter_udf(f):
    return f.filter_rows(lambda q: q % 7 == 0, "l_quantity").select("l_orderkey", "l_linenumber")


# ---- projection


@query("select c_custkey as key, c_mktsegment as segment, c_nationkey from customer", "customer")
def q_select_drop_rename(f):
    return f.select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal").drop("c_acctbal", "absent").rename({"c_custkey": "key", "c_mktsegment": "segment"})


@query("select c_name as c_custname, c_custkey as c_name, c_name as twice from customer", "customer")
def q_select_as(f):
    return f.select_as([("c_name", "c_custname"), ("c_custkey", "c_name"), ("c_name", "twice")])


@query("select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) as net, l_extendedprice + l_tax as l_tax from lineitem", "lineitem")
def q_with_column_arith(f):
    return f.with_columns({"net": mul("l_extendedprice", sub(lit(1), col("l_discount"))), "l_tax": col("l_extendedprice") + col("l_tax")}).select("l_orderkey", "l_linenumber", "net", "l_tax")


@query("select l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) as ratio, l_linenumber // nullif(l_linenumber - 1, 0) as whole from lineitem", "lineitem")
def q_div_zero_null(f):
    return f.with_columns({"ratio": div("l_extendedprice", "l_discount"), "whole": div("l_linenumber", col("l_linenumber") - 1)}).select("l_orderkey", "l_linenumber", "ratio", "whole")


@query("select p_partkey, p_size % 7 as r, -p_size % 7 as s, p_size % nullif(p_size - 5, 0) as z from part", "part")
def q_mod(f):
    return f.with_columns({"r": mod("p_size", lit(7)), "s": neg("p_size").mod(7), "z": mod("p_size", col("p_size") - 5)}).select("p_partkey", "r", "s", "z")


@query("select c_custkey, -c_acctbal as owed, -c_custkey as minus from customer", "customer")
def q_neg(f):
    return f.with_columns([("owed", neg("c_acctbal")), ("minus", neg("c_custkey"))]).select("c_custkey", "owed", "minus")


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), o_orderpriority) as v, nullif(o_orderstatus, 'F') is not distinct from 'O' as is_open from orders", "orders")
def q_coalesce(f):
    return _with_null(f).with_columns({"v": coalesce("o_flag", "o_orderpriority"), "is_open": col("o_flag").eq("O")}).select("o_orderkey", "v", "is_open")


@query("select vec_id, unnest(embedding) as embedding from embeddings", "embeddings")
def q_explode(f):
    return f.select("vec_id", "embedding").explode("embedding")


# ---- cleaning


@query("select o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '?') as o_flag from orders", "orders")
def q_fill_null(f):
    return _with_null(f).fill_null("o_flag", "?").select("o_orderkey", "o_flag")


@query("select o_orderkey, o_orderstatus as o_flag from orders where o_orderstatus <> 'F'", "orders")
def q_drop_null(f):
    return _with_null(f).drop_null("o_flag").select("o_orderkey", "o_flag")


@query("select count(*) filter (o_orderstatus = 'F') as o_flag, 0::bigint as o_orderkey from orders", "orders")
def q_count_nulls(f):
    return _with_null(f).select("o_flag", "o_orderkey").count_nulls()


@query("select o_orderkey, o_custkey::varchar as o_custkey, (o_custkey::varchar)::int as back, (l % 3 <> 0) as odd from (select *, o_orderkey as l from orders)", "orders")
def q_cast_num_string(f):
    return f.cast("o_custkey", t.STRING).with_columns({"back": col("o_custkey").cast(t.INT32), "odd": mod("o_orderkey", lit(3)).cast(t.BOOLEAN)}).select("o_orderkey", "o_custkey", "back", "odd")


@query("select event_id, case when event_type in ('true', '1', 'yes', 'y', 'on') then true when event_type in ('false', '0', 'no', 'n', 'off') then false end as flag, null::integer as number from events", "events")
def q_cast_string_bool(f):
    return f.with_columns({"flag": col("event_type").cast(t.BOOLEAN), "number": col("event_type").cast(t.INT32)}).select("event_id", "flag", "number")


@query("select c_custkey, trunc(c_acctbal)::bigint as whole, trunc(c_acctbal)::bigint % 2 = 0 as even from customer", "customer")
def q_cast_float_int(f):
    return f.with_column("whole", col("c_acctbal").cast(t.INT64)).with_column("even", mod("whole", lit(2)).eq(0)).select("c_custkey", "whole", "even")


def _gappy(f: Frame) -> Frame:
    """v: the event's value, null unless the id is divisible by 3."""
    return Frame(f.df.selectExpr("event_id", "user_id", "case when event_id % 3 = 0 then value end as v"))


@query("select event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over (order by event_id rows between unbounded preceding and current row) as v from events", "events")
def q_ffill(f):
    return _gappy(f).fill_null_forward("v", "event_id").select("event_id", "v")


@query("select event_id, first_value(case when event_id % 3 = 0 then value end ignore nulls) over (order by event_id rows between current row and unbounded following) as v from events", "events")
def q_bfill(f):
    return _gappy(f).fill_null_backward("v", "event_id").select("event_id", "v")


@query("select event_id, last_value(case when event_id % 3 = 0 then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as v from events", "events")
def q_ffill_by_user(f):
    return _gappy(f).fill_null_forward("v", "event_id", partition_by="user_id").select("event_id", "v")


@query("select distinct o_orderstatus, o_orderpriority from orders", "orders")
def q_distinct(f):
    return f.select("o_orderstatus", "o_orderpriority").distinct()


@query("select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1", "orders")
def q_unique_keep_first(f):
    return f.unique("o_custkey", order_by="o_orderkey").select("o_custkey", "o_orderkey")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1", "orders")
def q_unique_keep_last(f):
    return f.drop_duplicates("o_custkey", keep_first=False, order_by="o_orderkey").select("o_custkey", "o_orderkey")


@query("select count(distinct nullif(o_orderstatus, 'F')) + 1 as n from orders", "orders")
def q_count_unique(f):
    from .operators.cleaning import count_unique

    return Frame(_with_null(f).df.agg(count_unique("o_flag").alias("n")))


# ---- text


@query("select p_partkey, p_name from part", "part")
def q_trim(f):
    return Frame(f.df.selectExpr("p_partkey", "concat(' \t ', p_name, '\n ') as p_name")).trim("p_name")


@query("select p_partkey, replace(p_name, 'a', '<a>') as p_name from part", "part")
def q_replace_all(f):
    return f.replace("p_name", "a", "<a>").select("p_partkey", "p_name")


@query("select p_partkey, case when instr(p_name, 'a') > 0 then substr(p_name, 1, instr(p_name, 'a') - 1) || '<a>' || substr(p_name, instr(p_name, 'a') + 1) else p_name end as p_name from part", "part")
def q_replace_first(f):
    return f.replace("p_name", "a", "<a>", every=False).select("p_partkey", "p_name")


@query("select n_nationkey, upper(n_name) as n_name, lower(n_name) as low from nation", "nation")
def q_upper_lower(f):
    return f.with_column("low", coalesce("n_name")).upper("n_name").lower("low").select("n_nationkey", "n_name", "low")


@query("select n_nationkey, case when length(n_name) < 9 then lpad(n_name, 9, '*') else n_name end as n_name, case when length(n_name) < 9 then rpad(n_name, 9, '.') else n_name end as r from nation", "nation")
def q_pad(f):
    return f.with_column("r", coalesce("n_name")).pad("n_name", 9, "*").pad("r", 9, ".", "right").select("n_nationkey", "n_name", "r")


@query("select n_nationkey, substr(n_name, 2, 3) as n_name, substr(n_name, 3) as rest from nation", "nation")
def q_substring(f):
    return f.with_column("rest", coalesce("n_name")).substring("n_name", 1, 3).substring("rest", 2).select("n_nationkey", "n_name", "rest")


# ---- aggregation


@query("select count(*) as n, sum(trunc(l_extendedprice * 100)::bigint)::double as s, min(l_shipdate)::varchar as lo, max(l_quantity) as hi, round(avg(l_quantity), 6) as mean from lineitem", "lineitem")
def q_agg_global(f):
    g = f.with_column("cents", mul("l_extendedprice", lit(100)).cast(t.INT64)).agg([("n", count()), ("s", sum_("cents")), ("lo", min_("l_shipdate")), ("hi", max_("l_quantity")), ("mean", avg("l_quantity"))])
    return Frame(g.df.selectExpr("n", "s", "date_format(lo, 'yyyy-MM-dd HH:mm:ss') as lo", "hi", "round(mean, 6) as mean"))


@query("select 0::bigint as n, null::double as s, null::double as hi", "lineitem")
def q_agg_empty(f):
    return f.filter(col("l_quantity").lt(0)).agg({"n": count(), "s": sum_("l_quantity"), "hi": max_("l_quantity")})


@query("select l_returnflag, sum(l_quantity) as s, round(avg(l_quantity), 6) as mean, min(l_discount) as lo, max(l_discount) as hi, count(*) as n, count(nullif(l_linestatus, 'F')) as n_open from lineitem group by 1", "lineitem")
def q_groupby_sum_avg_min_max_count(f):
    g = Frame(f.df.selectExpr("*", "nullif(l_linestatus, 'F') as open")).group_by("l_returnflag", {"s": sum_("l_quantity"), "mean": avg("l_quantity"), "lo": min_("l_discount"), "hi": max_("l_discount"), "n": count(), "n_open": count("open")})
    return Frame(g.df.selectExpr("l_returnflag", "s", "round(mean, 6) as mean", "lo", "hi", "n", "n_open"))


@query("select l_returnflag, l_linestatus, sum(l_quantity * 2) as twice, count(*) as n from lineitem group by 1, 2", "lineitem")
def q_groupby_multi_key(f):
    return f.group_by(["l_returnflag", "l_linestatus"]).agg([("twice", sum_(mul("l_quantity", lit(2)))), ("n", count())])


@query("select nullif(o_orderstatus, 'F') as o_flag, count(*) as count from orders group by 1", "orders")
def q_groupby_null_key(f):
    return _with_null(f).group_by("o_flag").count()


@query('select p_brand, max(p_size) as "max(p_size)" from part group by 1', "part")
def q_groupby_shortcuts(f):
    return f.group_by("p_brand").max("p_size")


@query("select o_custkey, min_by(o_totalprice, o_orderkey) as a, max_by(o_totalprice, o_orderkey) as b, min_by(o_orderstatus, o_orderkey) filter (o_orderstatus <> 'F') as c from orders group by 1", "orders")
def q_first_last(f):
    return _with_null(f).group_by("o_custkey", {"a": first("o_totalprice"), "b": last("o_totalprice"), "c": first("o_flag")}, order_by="o_orderkey")


@query("select 'p_size' as \"column\", count(p_size) as count, round(avg(p_size), 6) as mean, round(stddev(p_size), 6) as std, min(p_size)::double as min, max(p_size)::double as max from part", "part")
def q_describe(f):
    return Frame(f.select("p_size").describe_frame().df.selectExpr("column", "count", "round(mean, 6) as mean", "round(std, 6) as std", "min", "max"))


# ---- joins


@query("select o_orderkey, c_name, c_nationkey from orders join customer on o_custkey = c_custkey", "orders", "customer")
def q_join_inner(o, c):
    return o.inner_join(c, "o_custkey", "c_custkey").select("o_orderkey", "c_name", "c_nationkey")


@query("select c_custkey, o_orderkey from customer left join orders on o_custkey = c_custkey", "customer", "orders")
def q_join_left(c, o):
    return c.left_join(o, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey")


@query("select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey", "orders", "customer")
def q_join_right(o, c):
    return o.right_join(c, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)", "customer", "orders")
def q_join_semi(c, o):
    big = o.filter(col("o_totalprice").gt(200000)).select_as([("o_custkey", "c_custkey")])
    return c.semi_join(big, "c_custkey").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)", "customer", "orders")
def q_join_anti(c, o):
    return c.anti_join(o.select_as([("o_custkey", "c_custkey")]), "c_custkey").select("c_custkey")


@query("select r_regionkey, r_name, n_nationkey, n_name from region cross join nation", "region", "nation")
def q_join_cross(r, n):
    return r.cross_join(n.select("n_nationkey", "n_name"))


@query("select a.n_regionkey, a.n_name, b.n_name as n_name_right from nation a left join nation b on a.n_regionkey = b.n_regionkey", "nation")
def q_join_suffix(n):
    n = n.select("n_regionkey", "n_name")
    return n.join(n, "n_regionkey")


@query("select l_orderkey, l_linenumber, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 49", "lineitem", "orders")
def q_join_fanout(li, o):
    return li.filter(col("l_quantity").gt(49)).inner_join(o, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("select a.s_suppkey, b.c_custkey from supplier a join customer b on a.s_suppkey = b.c_custkey and a.s_nationkey = b.c_nationkey", "supplier", "customer")
def q_join_multi_key(s, c):
    return s.inner_join(c, ["s_suppkey", "s_nationkey"], ["c_custkey", "c_nationkey"]).select("s_suppkey", "c_custkey")


# ---- order


@query("select o_orderkey, nullif(o_orderstatus, 'F') as o_flag from orders order by nullif(o_orderstatus, 'F') desc nulls first, o_orderkey limit 50", "orders")
def q_sort_nulls(f):
    return _with_null(f).sort([desc("o_flag", nulls_first=True), asc("o_orderkey")]).head(50).select("o_orderkey", "o_flag")


@query("select o_orderkey, nullif(o_orderstatus, 'F') as o_flag from orders order by nullif(o_orderstatus, 'F') desc nulls first, o_orderkey", "orders")
def q_sort_nulls_whole(f):
    return _with_null(f).sort([desc("o_flag", nulls_first=True), asc("o_orderkey")]).select("o_orderkey", "o_flag")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10", "orders")
def q_topk(f):
    return f.order_by([desc("o_totalprice"), asc("o_orderkey")]).limit(10).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders order by o_orderkey limit 20 offset 30", "orders")
def q_slice(f):
    return f.sort("o_orderkey").slice(30, 20).select("o_orderkey")


@query("select o_orderkey from orders order by o_orderkey desc limit 7", "orders")
def q_tail(f):
    return f.tail(7, order_by="o_orderkey").select("o_orderkey")


# ---- unions, pipelines, sources


@query("select n_nationkey, n_name from nation union all select n_nationkey, n_name from nation where n_regionkey = 1", "nation")
def q_concat(f):
    return f.select("n_nationkey", "n_name").concat(f.filter(col("n_regionkey").eq(1)).select("n_nationkey", "n_name"))


@query("select l_returnflag, sum(l_quantity) as s from lineitem where l_discount > 0.05 group by 1", "lineitem")
def q_pipeline(f):
    builder = from_schema(Schema({"l_returnflag": t.STRING, "l_quantity": t.FLOAT64, "l_discount": t.FLOAT64}), f.df.sparkSession)
    steps = builder.filter(col("l_discount").gt(0.05)).select("l_returnflag", "l_quantity").group_by("l_returnflag", {"s": sum_("l_quantity")}).build()
    return Pipeline(*steps.steps)(f.select("l_returnflag", "l_quantity", "l_discount"))


@query("select * from (values (1, 'x, y', true), (2, 'say \"hi\"', false), (null, 'z', null)) as v(id, name, ok)", "region")
def q_csv_string(f):
    text = 'id,name,ok\r\n1,"x, y",true\r\n2,"say ""hi""",no\r\n3.7, z ,\r\n\r\n'
    return from_csv_string(text, {"id": t.INT32.to_nullable(), "name": t.STRING.to_nullable(), "ok": t.BOOLEAN.to_nullable()}, spark=f.df.sparkSession)


@query("select * from (values (1::bigint, 'a,b', 1.5::double), (2, null, null)) as v(id, name, amount)", "region")
def q_records(f):
    return from_records([{"id": 1, "name": "a,b", "amount": 1.5}, {"id": 2}], {"id": t.INT64, "name": t.STRING.to_nullable(), "amount": t.FLOAT64.to_nullable()}, f.df.sparkSession)


@query("select 1::bigint as id, 'a' as name where false", "region")
def q_empty(f):
    return empty({"id": t.INT64, "name": t.STRING}, f.df.sparkSession)


@query(
    "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n "
    "from lineitem where l_quantity >= 5 and l_returnflag <> 'X' group by 1, 2 order by revenue desc limit 10",
    "lineitem",
)
def q_flagship(f):
    g = (
        f.filter(and_(col("l_quantity").gte(5), col("l_returnflag").neq("X")))
        .with_column("net", mul("l_extendedprice", sub(lit(1), col("l_discount"))))
        .group_by(["l_returnflag", "l_linestatus"], {"sum_qty": sum_("l_quantity"), "revenue": sum_("net"), "avg_disc": avg("l_discount"), "n": count()})
        .sort([desc("revenue")])
        .limit(10)
    )
    return Frame(g.df.selectExpr("l_returnflag", "l_linestatus", "sum_qty", "round(revenue, 2) as revenue", "round(avg_disc, 6) as avg_disc", "n"))


# ---- the rest of the interface: sources, actions, scalars, free functions


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only where the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set")
    return f"{(base or tempfile.mkdtemp(prefix='feldspar')).rstrip('/')}/feldspar-{uuid.uuid4().hex}"


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 200000)", "customer", "orders")
def q_join_anti_rows(c, o):
    return c.anti_join(o.filter(col("o_totalprice").gt(200000)).select_as([("o_custkey", "c_custkey")]), "c_custkey").select("c_custkey")


_SAID = ["true", "1", "Yes", " y ", "ON", "false", "0", "No", "n", "off", "maybe", ""]


@query(f"select event_id, case when lower(trim(s)) in ('true', '1', 'yes', 'y', 'on') then true when lower(trim(s)) in ('false', '0', 'no', 'n', 'off') then false end as flag from (select event_id, ({_SAID!r})[1 + event_id % {len(_SAID)}] as s from events)", "events")
def q_cast_string_bool_values(f):
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("event_id") % len(_SAID) + 1).cast("int"))
    return Frame(f.df.select("event_id", said.alias("s"))).with_column("flag", col("s").cast(t.BOOLEAN)).select("event_id", "flag")


_NUMBERS = ["7", " -12 ", "3.9", "-0.5", "1e3", "x", "", "300", "99999999999"]


@query(f"select event_id, case i when 0 then 7 when 1 then -12 when 2 then 3 when 3 then 0 when 4 then 1000 when 7 then 300 end as whole, case i when 0 then 7 when 1 then -12 when 2 then 3 when 3 then 0 end as small, case i when 0 then 7 when 1 then -12 when 2 then 3.9 when 3 then -0.5 when 4 then 1000 when 7 then 300 when 8 then 99999999999 end::double as real from (select event_id, event_id % {len(_NUMBERS)} as i from events)", "events")
def q_cast_string_numbers(f):
    said = F.element_at(F.array(*[F.lit(x) for x in _NUMBERS]), (F.col("event_id") % len(_NUMBERS) + 1).cast("int"))
    g = Frame(f.df.select("event_id", said.alias("s"))).with_columns({"whole": col("s").cast(t.INT32), "small": col("s").cast(t.INT8), "real": col("s").cast(t.FLOAT64)}).select("event_id", "whole", "small", "real")
    return Frame(g.df.withColumn("small", F.col("small").cast("int")))


@query("select o_orderkey, o_custkey, 'say \"hi\"; ' || o_orderpriority as note, o_totalprice, case when o_orderkey % 3 = 0 then 0 else o_orderkey end as gap, o_orderkey % 2 = 0 as even from orders", "orders")
def q_csv_file(f):
    spark, path = f.df.sparkSession, _scratch(f.df.sparkSession)
    rows = f.df.selectExpr("o_orderkey", "o_custkey", "concat('  say \"hi\"; ', o_orderpriority, ' ') as note", "o_totalprice", "if(o_orderkey % 3 = 0, null, o_orderkey) as gap", "if(o_orderkey % 2 = 0, 'Yes', 'no') as even")
    rows.write.option("sep", ";").option("escape", '"').option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(path, {"o_orderkey": t.INT64, "o_custkey": t.INT64, "note": t.STRING, "o_totalprice": t.FLOAT64, "gap": t.INT64, "even": t.BOOLEAN}, delimiter=";", spark=spark)


@query("select * from (values (0, '', 0.0::double, false, 0::bigint), (5, 'a', 1.5, true, 86400000), (null, 'b', null, false, null)) as v(i, s, d, b, ms)", "region")
def q_csv_defaults(f):
    text = "i,s,d,b,ts\n,,,,\n5,a,1.5,Y,1970-01-02T00:00:00Z\nx,b,y,nope,z\n"
    g = from_csv_string(text, {"i": t.INT32, "s": t.STRING, "d": t.FLOAT64, "b": t.BOOLEAN, "ts": t.TIMESTAMP}, spark=f.df.sparkSession)
    return Frame(g.df.selectExpr("i", "s", "d", "b", "unix_millis(ts) as ms"))


@query("select * from (values (0, 1, 'a'), (1, 2, 'b\nc'), (2, 3, 'dé')) as v(piece, id, name)", "region")
def q_csv_incremental(f):
    spark, parser = f.df.sparkSession, CsvParser({"id": t.INT32, "name": t.STRING}, spark=f.df.sparkSession)
    pieces = [b"id,na", b'me\n1,a\r\n2,"b', b'\nc"\n3,d\xc3', b"\xa9"]
    found = [x for x in [*map(parser.parse, pieces), parser.finish()] if x is not None]
    out = [Frame(x.df.select(F.lit(k).alias("piece"), "id", "name")) for k, x in enumerate(found)]
    return out[0].concat(out[1]).concat(out[2]) if len(out) == 3 else empty({"piece": t.INT32, "id": t.INT32, "name": t.STRING}, spark)


@query("select * from (values (1, 'b'), (2, null)) as v(id, name)", "region")
def q_csv_source(f):
    source = CsvSource.from_string("name|x|id\nskipped|0|0\nb|9|1\n|9|2\nc|9|3", {"name": t.STRING.to_nullable(), "x": t.INT32, "id": t.INT32}, delimiter="|", skip_rows=1, max_rows=2, projection=[2, 0], spark=f.df.sparkSession)
    return from_records(list(source.rows()), {"id": t.INT32, "name": t.STRING.to_nullable()}, f.df.sparkSession)


@query("select n_nationkey, n_name from nation", "nation")
def q_batches(f):
    return from_batches(f.select("n_nationkey", "n_name").batches(), f.df.sparkSession)


@query("select * from (values (1::bigint, 'a', null::double), (2, null, 2.0)) as v(id, name, x)", "region")
def q_from_columns(f):
    return from_columns({"id": [1, 2], "name": ["a", None], "x": [None, 2]}, {"id": t.INT64, "name": t.STRING.to_nullable(), "x": t.FLOAT64.to_nullable()}, f.df.sparkSession)


@query("select 'r_regionkey' as name, 'int' as type union all select 'r_name', 'string'", "region")
def q_parquet_schema(f):
    found = parquet_schema(f.df.inputFiles()[0], f.df.sparkSession)
    return from_records([{"name": x.name, "type": x.dataType.simpleString()} for x in found], {"name": t.STRING, "type": t.STRING}, f.df.sparkSession)


def q_stream_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, kinds = _scratch(spark), Schema.of(parquet_schema(f"{sf_dir}/orders.parquet", spark))
    # a pattern, as a stream takes folders and patterns but no single file
    stream = stream_parquet(f"{sf_dir}/order[s].parquet", kinds, spark).filter(col("o_totalprice").gt(100000)).with_column("twice", mul("o_totalprice", lit(2))).select("o_orderkey", "twice")
    run_to_end(stream, f"{out}/rows", f"{out}/checkpoint")
    return read_parquet(f"{out}/rows", spark).df


QUERIES["q_stream_parquet"] = q_stream_parquet
ORACLE_SQL["q_stream_parquet"] = "select o_orderkey, o_totalprice * 2 as twice from orders where o_totalprice > 100000"


@query("select n_nationkey, n_name from nation where n_regionkey < 3", "nation")
def q_collect(f):
    return f.where(col("n_regionkey").lt(3)).collect().select("n_nationkey", "n_name")


@query("select n_nationkey::bigint as n_nationkey, n_name from nation", "nation")
def q_to_list_rows(f):
    f = f.select("n_nationkey", "n_name")
    kinds = {"n_nationkey": t.INT64, "n_name": t.STRING}
    first_half = [r for r in f.to_list() if r["n_nationkey"] < 12]
    return from_records(first_half, kinds, f.df.sparkSession).union(from_records((r for r in f.rows() if r["n_nationkey"] >= 12), kinds, f.df.sparkSession))


@query("select count(*) as n, count(*) filter (l_quantity > 45) as matching, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_quantity), 6) as mean, false as is_empty, true as none_is_empty, false as any_null from lineitem", "lineitem")
def q_scalars(f):
    row = {"n": f.count(), "matching": f.count_matching(col("l_quantity").gt(45)), "lo": f.min("l_quantity"), "hi": f.max("l_quantity"), "mean": round(f.mean("l_quantity"), 6), "is_empty": f.is_empty(), "none_is_empty": f.filter(col("l_quantity").lt(0)).is_empty(), "any_null": f.has_any_null(["l_quantity", "l_orderkey"])}
    kinds = {"n": t.INT64, "matching": t.INT64, "lo": t.FLOAT64, "hi": t.FLOAT64, "mean": t.FLOAT64, "is_empty": t.BOOLEAN, "none_is_empty": t.BOOLEAN, "any_null": t.BOOLEAN}
    return from_records([row], kinds, f.df.sparkSession)


@query("select count(*) filter (nullif(o_orderstatus, 'F') is null) > 0 as flag, false as o_orderkey from orders", "orders")
def q_has_any_null(f):
    g = _with_null(f)
    return from_records([{"flag": g.has_any_null("o_flag"), "o_orderkey": g.has_any_null("o_orderkey")}], {"flag": t.BOOLEAN, "o_orderkey": t.BOOLEAN}, f.df.sparkSession)


@query("select * from (values ('n_nationkey', 'int32', 'n_nationkey: int32?'), ('n_name', 'string', 'n_name: string?')) as v(name, kind, line)", "nation")
def q_schema(f):
    f = f.select("n_nationkey", "n_name")
    lines = f.format_schema().split("\n")
    return from_records([{"name": n, "kind": f.dtypes()[n], "line": line} for n, line in zip(f.column_names, lines) if f.schema.has(n)], {"name": t.STRING, "kind": t.STRING, "line": t.STRING}, f.df.sparkSession)


@query("select * from (values (0, '┌────┬───┐'), (1, '│ id │ n │'), (2, '├────┼───┤'), (3, '│ 1  │ a │'), (4, '└────┴───┘'), (5, '...')) as v(i, line)", "region")
def q_show(f):
    shown = from_records([{"id": 1, "n": "a"}, {"id": 2, "n": "b"}], {"id": t.INT32, "n": t.STRING}, f.df.sparkSession).show_string(1)
    return from_records([{"i": i, "line": line} for i, line in enumerate(shown.split("\n"))], {"i": t.INT32, "line": t.STRING}, f.df.sparkSession)


@query("select true as filtered, true as scanned", "orders")
def q_explain(f):
    plan = f.filter(col("o_totalprice").gt(1)).select("o_orderkey").explain()
    return from_records([{"filtered": "GreaterThan(o_totalprice,1" in plan, "scanned": "Scan parquet" in plan}], {"filtered": t.BOOLEAN, "scanned": t.BOOLEAN}, f.df.sparkSession)


@query("select o_orderkey, o_totalprice + 1 as more from orders", "orders")
def q_alias(f):
    return f.with_column("more", (col("o_totalprice") + 1).alias("other")).select("o_orderkey", "more")


@query("select l_orderkey, l_linenumber, l_quantity * 2 as twice from lineitem where l_quantity * 2 > 90 order by all limit 40 offset 5", "lineitem")
def q_pipeline_columns(f):
    start = Schema({"l_orderkey": t.INT64, "l_linenumber": t.INT32, "l_quantity": t.FLOAT64})
    builder = from_schema(start, f.df.sparkSession).add_column("twice", mul("l_quantity", lit(2))).step(lambda x: x).filter(col("twice").gt(90)).select("l_orderkey", "l_linenumber", "twice")
    return builder.sort([asc("l_orderkey"), asc("l_linenumber"), asc("twice")]).limit(40, offset=5).execute(f.select("l_orderkey", "l_linenumber", "l_quantity")).frame


@query("select count(*) as rows_in, count(*) filter (l_quantity > 45) as rows_out, count(*) filter (l_quantity > 45) as measured from lineitem", "lineitem")
def q_metrics(f):
    done = Pipeline(lambda x: x.filter(col("l_quantity").gt(45)))
    run = done.execute(f.select("l_quantity"))
    return from_records([{"rows_in": run.rows_in, "rows_out": run.rows_out, "measured": done(f).measured()["rows_out"]}], {"rows_in": t.INT64, "rows_out": t.INT64, "measured": t.INT64}, f.df.sparkSession)


@query("select o_orderkey from orders where o_orderstatus = 'O'", "orders")
def q_filter_boolean_column(f):
    return f.with_column("open", col("o_orderstatus").eq("O")).filter(col("open")).select("o_orderkey")


@query("select n_nationkey from nation", "nation")
def q_filter_literal(f):
    f = f.select("n_nationkey")
    return concat(f.where(lit(True)), f.where(lit(False)))


@query("select n_nationkey, 7::tinyint::int as small, 7::bigint as wide, '7' as said, 7::double as real, n_nationkey < 7 as less from nation", "nation")
def q_typed_lit(f):
    g = f.with_columns({"small": typed_lit(7, t.INT8), "wide": typed_lit(7, t.INT64), "said": typed_lit("7", t.STRING), "real": typed_lit(7, t.FLOAT64), "less": col("n_nationkey").lt(typed_lit(7, t.INT32))})
    return Frame(g.df.selectExpr("n_nationkey", "cast(small as int) as small", "wide", "said", "real", "less"))


@query("select coalesce(sum(v) filter (not isnan(v)), 0) as s, count(*) filter (isnan(v)) as gaps, count(*) as n from (select case when event_id % 3 = 0 then event_id::double else 'nan'::double end as v from events union all select (event_id % 2 = 0)::int::double from events union all select 'nan'::double from events)", "events")
def q_apply_value(f):
    g = Frame(f.df.selectExpr("event_id", "if(event_id % 3 = 0, event_id, null) as v", "event_type"))
    parts = g.apply_value(col("v")).concat(g.apply_value(mod("event_id", lit(2)).eq(0))).concat(g.apply_value(col("event_type")))
    return Frame(parts.df.selectExpr("sum(if(isnan(value), 0, value)) as s", "count_if(isnan(value)) as gaps", "count(*) as n"))


@query('select p_brand, min(p_size) as "min(p_size)", max(p_size) as "max(p_size)", sum(p_size)::double as "sum(p_size)", round(avg(p_size), 6) as "mean(p_size)" from part group by 1', "part")
def q_group_shortcuts(f):
    g = f.group_by("p_brand")
    out = g.min("p_size").join(g.max("p_size"), "p_brand").join(g.sum("p_size"), "p_brand").join(g.mean("p_size"), "p_brand")
    return Frame(out.df.withColumn("mean(p_size)", F.round("`mean(p_size)`", 6)))


@query("select o_orderstatus, count(*) as n, max(o_totalprice) as hi from orders group by 1", "orders")
def q_agg_helper(f):
    return f.group_by("o_orderstatus", [agg("n", count()), agg("hi", max_("o_totalprice"))])


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey union all select r_name, n_name from region left join nation on r_regionkey = n_regionkey and n_nationkey < 3", "nation", "region")
def q_join_free_functions(n, r):
    inner = inner_join(n, r, "n_regionkey", "r_regionkey").select_as([("n_name", "n_name"), ("r_name", "r_name")])
    left = left_join(r, n.filter(col("n_nationkey").lt(3)), "r_regionkey", "n_regionkey").select_as([("r_name", "n_name"), ("n_name", "r_name")])
    return concat(inner, left)


@query("select n_nationkey, n_name from nation where n_nationkey < 5 union all select n_nationkey, n_name from nation where n_nationkey >= 20", "nation")
def q_union_pipe(f):
    f = f.select("n_nationkey", "n_name")
    below = lambda x, n: x.filter(col("n_nationkey").lt(n))
    return f.pipe(below, 5).union(f.pipe(lambda x: x.filter(not_(Expr("lt", col("n_nationkey"), lit(20))))))


@query("select n_nationkey, case when length(n_name) < 12 then rpad(lpad(n_name, length(n_name)::int + ((12 - length(n_name)) // 2)::int, '*'), 12, '*') else n_name end as n_name from nation", "nation")
def q_pad_both(f):
    return f.pad("n_name", 12, "*", "both").select("n_nationkey", "n_name")


@query("select true as differing_names, true as differing_kinds, true as same", "nation", "region")
def q_union_schema_check(n, r):
    from .errors import EngineError

    def refused(a, b):
        try:
            a.concat(b)
        except EngineError:
            return True
        return False

    row = {"differing_names": refused(n, r), "differing_kinds": refused(n.select("n_name"), r.select_as([("r_regionkey", "n_name")])), "same": not refused(n, n)}
    return from_records([row], dict.fromkeys(row, t.BOOLEAN), n.df.sparkSession)
