"""The engine's queries over the driver's tables, and the SQL of each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.chars import bucket_of, char_equal, char_fit, hash_key
from .operators import changes as C
from .operators import relational as R
from .plans import stats as S
from .plans.query import Query
from .sources.tables import literal, scan, work_dir

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__.lstrip("_")] = (f, sql)
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan(spark, f"{sf}/{name}.parquet")


def _engine(spark: SparkSession, sf: str, *tables: str) -> Engine:
    """An engine with tables of its own, filled with the driver's."""
    engine = Engine(spark, work_dir(spark, "catalogue"))
    for name in tables:
        engine.create(name, _t(spark, sf, name))
    return engine


def _filter(name: str, table: str, condition, sql: str) -> None:
    _QUERIES[name] = (lambda spark, sf: R.where(_t(spark, sf, table), *condition()), sql)


_filter("scan_seq", "nation", lambda: [], "select * from nation")
_filter("filter_eq_int", "orders", lambda: [R.compare("o_custkey", "=", 42)], "select * from orders where o_custkey = 42")
_filter("filter_eq_char", "customer", lambda: [R.compare("c_mktsegment", "=", "BUILDING")], "select * from customer where c_mktsegment = 'BUILDING'")
_filter("filter_lt", "part", lambda: [R.compare("p_size", "<", 10)], "select * from part where p_size < 10")
_filter("filter_gt", "part", lambda: [R.compare("p_size", ">", 40)], "select * from part where p_size > 40")
_filter("filter_le", "part", lambda: [R.compare("p_size", "<=", 10)], "select * from part where p_size <= 10")
_filter("filter_ge", "part", lambda: [R.compare("p_size", ">=", 40)], "select * from part where p_size >= 40")
_filter("filter_between", "part", lambda: [R.compare("p_size", "between", 10, 20)], "select * from part where p_size between 10 and 20")
_filter("filter_and", "part", lambda: [R.compare("p_size", ">", 10), R.compare("p_size", "<", 20)], "select * from part where p_size > 10 and p_size < 20")


@_query("select * from lineitem where l_orderkey = 7")
def scan_index_eq(spark, sf):
    engine = _engine(spark, sf, "lineitem")
    engine.execute("CREATE INDEX by_order ON lineitem (l_orderkey)")
    return engine.execute("SELECT * FROM lineitem WHERE l_orderkey = 7").df


@_query("select * from (select c_custkey, c_acctbal, c_acctbal > 0 as in_credit from customer) t where in_credit = true")
def filter_eq_bool(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("in_credit"))
    return R.where(df, R.compare("in_credit", "=", True))


@_query("select distinct * from (select o_orderstatus, o_orderpriority from orders) t")
def distinct_hash(spark, sf):
    return Query(_t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")).distinct().build()


_NATION_REGION = "select n.n_nationkey as nation_n_nationkey, n.n_name as nation_n_name, r.r_name as region_r_name from nation n join region r on n.n_regionkey = r.r_regionkey"


def _nation_region(spark, sf, prefer=None):
    q = Query(_t(spark, sf, "nation"), "nation").join(_t(spark, sf, "region"), "region").on("n_regionkey", "r_regionkey")
    return (q.prefer(prefer) if prefer else q).build().select("nation_n_nationkey", "nation_n_name", "region_r_name")


@_query("select distinct * from (select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey) t")
def distinct_sort_join(spark, sf):
    df = R.join(_t(spark, sf, "nation"), _t(spark, sf, "region"), [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")
    return R.distinct(df, ordered=True)


@_query("select n.n_nationkey as nation_n_nationkey, n.n_name as nation_n_name, r.r_name as region_r_name from nation n, region r where n.n_regionkey = r.r_regionkey")
def join_comma(spark, sf):
    got = _engine(spark, sf, "nation", "region").execute("SELECT * FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey").df
    return got.select("nation_n_nationkey", "nation_n_name", "region_r_name")


@_query(_NATION_REGION)
def join_on(spark, sf):
    got = _engine(spark, sf, "nation", "region").execute("SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey").df
    return got.select("nation_n_nationkey", "nation_n_name", "region_r_name")


@_query(_NATION_REGION)
def join_bnl(spark, sf):
    return _nation_region(spark, sf, "bnl")


def _orders_customers(spark, sf, left=(), right=()):
    q = Query(_t(spark, sf, "orders"), "o").where(*left).join(_t(spark, sf, "customer"), "c").where_right(*right).on("o_custkey", "c_custkey")
    return q.build().select(F.col("o_o_orderkey").alias("o_orderkey"), F.col("c_c_name").alias("c_name"))


@_query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 400000")
def join_filter_left(spark, sf):
    return _orders_customers(spark, sf, left=[R.compare("o_totalprice", ">", 400000)])


@_query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_mktsegment = 'BUILDING'")
def join_filter_right(spark, sf):
    return _orders_customers(spark, sf, right=[R.compare("c_mktsegment", "=", "BUILDING")])


@_query("select l.l_orderkey, l.l_linenumber, o.o_custkey from lineitem l join orders o on l.l_orderkey = o.o_orderkey")
def join_merge(spark, sf):
    df = R.join(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), _t(spark, sf, "orders").select("o_orderkey", "o_custkey"), [("l_orderkey", "o_orderkey")], "merge")
    return df.select("l_orderkey", "l_linenumber", "o_custkey")


@_query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey")
def join_presorted(spark, sf):
    """Merge join of bucketed, sorted tables: no exchange."""
    mark = uuid.uuid4().hex
    orders = R.write_sorted(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), f"orders_{mark}", "o_custkey", 8)
    customers = R.write_sorted(_t(spark, sf, "customer").select("c_custkey", "c_name"), f"customers_{mark}", "c_custkey", 8)
    return R.join_presorted(orders, customers, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@_query("select c.c_custkey, s.s_suppkey from customer c join supplier s on c.c_nationkey = s.s_nationkey")
def join_many_many(spark, sf):
    return R.join(_t(spark, sf, "customer"), _t(spark, sf, "supplier"), [("c_nationkey", "s_nationkey")]).select("c_custkey", "s_suppkey")


@_query("select a.n_nationkey as l_key, b.n_nationkey as r_key from nation a join nation b on a.n_regionkey = b.n_regionkey")
def join_self(spark, sf):
    df = R.self_join(_t(spark, sf, "nation"), "n_regionkey", ["n_nationkey"], ("a", "b"))
    return df.select(F.col("a_n_nationkey").alias("l_key"), F.col("b_n_nationkey").alias("r_key"))


def _keys(spark, sf, table, column, name, *conditions):
    return R.where(_t(spark, sf, table), *conditions).select(F.col(column).alias(name))


@_query("select c_nationkey as nationkey from customer union select s_nationkey as nationkey from supplier")
def union(spark, sf):
    return R.union(_keys(spark, sf, "customer", "c_nationkey", "nationkey"), _keys(spark, sf, "supplier", "s_nationkey", "nationkey"))


@_query("select o_custkey as k from orders where o_totalprice > 400000 intersect select c_custkey as k from customer where c_mktsegment = 'BUILDING'")
def intersect(spark, sf):
    return R.intersect(_keys(spark, sf, "orders", "o_custkey", "k", R.compare("o_totalprice", ">", 400000)), _keys(spark, sf, "customer", "c_custkey", "k", R.compare("c_mktsegment", "=", "BUILDING")))


@_query("select c_custkey as k from customer except select o_custkey as k from orders where o_totalprice > 200000")
def _except(spark, sf):
    return R.subtract(_keys(spark, sf, "customer", "c_custkey", "k"), _keys(spark, sf, "orders", "o_custkey", "k", R.compare("o_totalprice", ">", 200000)))


@_query("select o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_mktsegment='BUILDING')")
def except_bag(spark, sf):
    return R.subtract_keeping(_keys(spark, sf, "orders", "o_custkey", "k"), _keys(spark, sf, "customer", "c_custkey", "k", R.compare("c_mktsegment", "=", "BUILDING")))


@_query("select c_nationkey as k from customer except all select s_nationkey as k from supplier")
def except_all(spark, sf):
    return R.subtract_counting(_keys(spark, sf, "customer", "c_nationkey", "k"), _keys(spark, sf, "supplier", "s_nationkey", "k"))


@_query("select r_regionkey, r_name from region union all select 99 as r_regionkey, 'ATLANTIS' as r_name")
def dml_insert(spark, sf):
    engine = _engine(spark, sf, "region")
    engine.execute("INSERT INTO region VALUES (99, 'ATLANTIS')")
    return engine.table("region")


@_query("select r_regionkey, case when r_name='ASIA' then 'APAC' else r_name end as r_name from region")
def dml_update(spark, sf):
    engine = _engine(spark, sf, "region")
    engine.execute("UPDATE region SET r_name = 'APAC' WHERE r_name = 'ASIA'")
    return engine.table("region")


@_query("select r_regionkey, 'NOWHERE' as r_name from region")
def dml_update_all(spark, sf):
    engine = _engine(spark, sf, "region")
    engine.execute("UPDATE region SET r_name = 'NOWHERE'")
    return engine.table("region")


@_query("select * from orders where not (o_orderstatus = 'F')")
def dml_delete(spark, sf):
    engine = _engine(spark, sf, "orders")
    engine.execute("DELETE FROM orders WHERE o_orderstatus = 'F'")
    return engine.table("orders")


@_query("select * from part where not (p_size between 10 and 20)")
def dml_delete_between(spark, sf):
    engine = _engine(spark, sf, "part")
    engine.execute("DELETE FROM part WHERE p_size BETWEEN 10 AND 20")
    return engine.table("part")


@_query("select * from orders where not (o_custkey = 42)")
def dml_delete_eq(spark, sf):
    engine = _engine(spark, sf, "orders")
    engine.execute("CREATE INDEX by_customer ON orders (o_custkey)")
    engine.execute("DELETE FROM orders WHERE o_custkey = 42")
    return engine.table("orders")


@_query("select n_nationkey, rpad(n_name, 7, ' ') as n_name from nation")
def char_pad(spark, sf):
    return _t(spark, sf, "nation").select("n_nationkey", char_fit(F.col("n_name"), 7).alias("n_name"))


@_query("select n_nationkey, n_name from nation where rpad(n_name, 8, ' ') = rpad('NATION_10', 8, ' ')")
def char_trunc_eq(spark, sf):
    return R.where(_t(spark, sf, "nation"), char_equal(F.col("n_name"), "NATION_10", 8)).select("n_nationkey", "n_name")


@_query("select least(cast(floor((case when p_size<=1 then 0 else p_size-1 end)/5.0) as int),9) as bucket, count(*) as cnt from part group by 1")
def stats_hist(spark, sf):
    return S.histogram(_t(spark, sf, "part"), "p_size", 1, 50, 10)


@_query("select count(distinct c_mktsegment) as ndv, count(*) as row_count from customer")
def stats_ndv(spark, sf):
    return S.distinct_count(_t(spark, sf, "customer"), "c_mktsegment")


@_query("select 1e0 / count(distinct c_mktsegment) as selectivity from customer")
def stats_selectivity(spark, sf):
    return S.categorical_selectivity(_t(spark, sf, "customer"), "c_mktsegment")


@_query("select (o_custkey & 2147483647) & 7 as bucket, count(*) as entries from orders group by 1")
def hash_bucket(spark, sf):
    return _t(spark, sf, "orders").groupBy(bucket_of(hash_key(F.col("o_custkey"), "INT"), 3, 7).alias("bucket")).agg(F.count("*").alias("entries"))


@_query("select case when h & 7 > 5 then (h & 7) - 4 else h & 7 end as bucket, count(*) as entries from (select o_custkey & 2147483647 as h from orders) t group by 1")
def hash_bucket_fold(spark, sf):
    return _t(spark, sf, "orders").groupBy(bucket_of(hash_key(F.col("o_custkey"), "INT"), 3, 5).alias("bucket")).agg(F.count("*").alias("entries"))


@_query("select hash, case when hash & 7 > 5 then (hash & 7) - 4 else hash & 7 end as bucket, count(*) as entries from (select list_reduce(list_prepend(0::bigint, list_transform(string_split(trim(c_name), ''), lambda c: unicode(c)::bigint)), lambda a, b: (a * 31 + b) % 4294967296) & 2147483647 as hash from customer) t group by 1, 2")
def hash_bucket_char(spark, sf):
    hashed = _t(spark, sf, "customer").select(hash_key(F.col("c_name"), "CHAR").alias("hash"))
    return hashed.groupBy("hash", bucket_of(F.col("hash"), 3, 5).alias("bucket")).agg(F.count("*").alias("entries"))


@_query("select c_custkey, c_mktsegment as segment from customer where c_mktsegment = 'BUILDING'")
def select_derived_char(spark, sf):
    """CHAR columns keep their comparison through a derived table."""
    engine = Engine(spark, work_dir(spark, "catalogue"))
    engine.execute("CREATE TABLE customer (c_custkey BIGINT, c_mktsegment CHAR(20))")
    engine.load("customer", _t(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    got = engine.execute("SELECT * FROM (SELECT c_custkey, c_mktsegment AS segment FROM customer) q WHERE q.segment = 'BUILDING'").df
    return got.select("c_custkey", F.rtrim("segment").alias("segment"))


@_query("select * from (values (1, 'a'), (2, 'b')) as t(id, name)")
def src_literal(spark, sf):
    return literal(spark, [(1, "a"), (2, "b")], "id int, name string")


@_query("select n_name, n_regionkey from nation")
def proj_columns(spark, sf):
    return R.project(_t(spark, sf, "nation"), "n_name", "n_regionkey")


@_query("select * from part order by p_size")
def sort_by_column(spark, sf):
    return R.sort(_t(spark, sf, "part"), "p_size")


@_query(None)
def explain_trace(spark, sf):
    """The decisions for a join with a filter and distinct, a line a row."""
    engine = Engine(spark, work_dir(spark, "catalogue"))
    engine.execute("create table nations (id int, name char(25), region int)")
    engine.execute("create table regions (id int, name char(25))")
    engine.load("nations", _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    engine.load("regions", _t(spark, sf, "region").select("r_regionkey", "r_name"))
    got = engine.execute("select distinct * from nations n join regions r on n.region = r.id where r.name = 'ASIA'", explain=True)
    lines = got.explain.split("=== Spark Plan ===")[0].strip().splitlines()
    return spark.createDataFrame(list(enumerate(lines, 1)), "line int, step string")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of one region: scan, filter, join."""
    q = Query(_t(spark, sf, "nation"), "nation").join(_t(spark, sf, "region"), "region").on("n_regionkey", "r_regionkey")
    return q.where_right(R.compare("r_name", "=", "ASIA")).build()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}
