"""One registered query per operator over the star schema, and the SQL that each must agree with."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable
from typing import Annotated

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import Database, Delete, Files, Insert, Int, Json, Store, Update, Upsert, avg_of, column, count_all, count_distinct_of, count_of, ddl, excluded, exists, items, max_of, min_of, outer, query, raw, row_number, sql, sum_of
from .functions.codecs import Codec
from .plans.schema import Table
from .streaming.events import windowed_counts


class Region(Table, name="region"):
    r_regionkey: Int = column(key=True)
    r_name: str


class Nation(Table, name="nation"):
    n_nationkey: Int = column(key=True)
    n_name: str
    n_regionkey: Int


class Customer(Table, name="customer"):
    c_custkey: int = column(key=True)
    c_name: str
    c_nationkey: Int
    c_acctbal: float
    c_mktsegment: str


class Supplier(Table, name="supplier"):
    s_suppkey: int = column(key=True)
    s_name: str
    s_nationkey: Int
    s_acctbal: float


class Part(Table, name="part"):
    p_partkey: int = column(key=True)
    p_name: str
    p_brand: str
    p_type: str
    p_size: Int
    p_retailprice: float


class Orders(Table, name="orders"):
    o_orderkey: int = column(key=True)
    o_custkey: int
    o_orderstatus: str
    o_totalprice: float
    o_orderdate: dt.datetime
    o_orderpriority: str


class Lineitem(Table, name="lineitem"):
    l_orderkey: int
    l_partkey: int
    l_suppkey: int
    l_linenumber: Int
    l_quantity: float
    l_extendedprice: float
    l_discount: float
    l_tax: float
    l_returnflag: str
    l_linestatus: str
    l_shipdate: dt.datetime


class Events(Table, name="events"):
    event_id: int = column(key=True)
    ts: dt.datetime
    user_id: int
    event_type: str
    value: float
    props: Json[dict]


class Embeddings(Table, name="embeddings"):
    vec_id: int = column(key=True)
    embedding: Annotated[list, Codec("vector", T.ArrayType(T.FloatType()))]
    label: Int


TABLES = (Region, Nation, Customer, Supplier, Part, Orders, Lineitem, Events, Embeddings)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, Files(sf_dir))


def _register(name: str, oracle: str | None, make: Callable[[], object]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _database(spark, sf_dir).df(make())

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def flagship():
    """Large line items of large orders in one market segment, the greatest orders first."""
    return (
        query(Customer)
        .join(Orders, Customer.c_custkey == Orders.o_custkey)
        .join(Lineitem, Orders.o_orderkey == Lineitem.l_orderkey)
        .where(Customer.c_mktsegment == "BUILDING")
        .where(Orders.o_totalprice > 400000)
        .where(Lineitem.l_quantity >= 45)
        .order_by(Orders.o_totalprice.desc(), Orders.o_orderkey, Lineitem.l_linenumber, Lineitem.l_partkey)
        .limit(20)
        .select(Customer.c_custkey, Customer.c_name, Orders.o_orderkey, Orders.o_totalprice, Lineitem.l_linenumber, Lineitem.l_partkey, Lineitem.l_quantity)
    )


def _valuable(columns=()):
    q = query(Orders).where(Orders.o_totalprice > 450000)
    return (q.select(*columns) if columns else q).as_table("hv")


def _right_join():
    hv = _valuable()
    return query(hv).right_join(Customer, hv.o_custkey == Customer.c_custkey)


def _left_join():
    hv = _valuable()
    return query(Customer).left_join(hv, Customer.c_custkey == hv.o_custkey), hv


def _full_join():
    n = query(Nation).where(Nation.n_nationkey < 10).as_table("n")
    r = query(Region).where(Region.r_regionkey != 0).as_table("r")
    return query(n).full_join(r, n.n_regionkey == r.r_regionkey).all()


def _self_join():
    a, b = Nation.as_("a"), Nation.as_("b")
    return query(a).join(b, (a.n_regionkey == b.n_regionkey) & (a.n_nationkey < b.n_nationkey)).all().select(a_key=a.n_nationkey, b_key=b.n_nationkey)


def _null_side():
    hv = _valuable()
    return query(hv).right_join(Customer, hv.o_custkey == Customer.c_custkey).where(hv.o_orderkey.is_null()).select(Customer.c_custkey, hv.o_orderkey)


def _sorted_nulls(ascending: bool):
    q, hv = _left_join()
    first = hv.o_orderkey.asc(nulls_first=True) if ascending else hv.o_orderkey.desc(nulls_first=False)
    return q.order_by(first, Customer.c_custkey).limit(50).select(Customer.c_custkey, hv.o_orderkey)


def _rich(price: int):
    return query(Orders).where(Orders.o_totalprice > price).select(Orders.o_custkey)


def _correlated(price: int):
    return exists(query(Orders).where(Orders.o_custkey == outer(Customer.c_custkey)).where(Orders.o_totalprice > price))


_HV = "(select * from orders where o_totalprice>450000) hv"
_OPEN = query(Orders).where(Orders.o_orderstatus == "O")

_register(
    "flagship",
    "select c_custkey,c_name,o_orderkey,o_totalprice,l_linenumber,l_partkey,l_quantity from customer join orders on c_custkey=o_custkey join lineitem "
    "on o_orderkey=l_orderkey where c_mktsegment='BUILDING' and o_totalprice>400000 and l_quantity>=45 order by o_totalprice "
    "desc,o_orderkey,l_linenumber,l_partkey limit 20",
    flagship,
)
_register("scan_all", "select * from region", lambda: query(Region).all())
_register("select_cols", "select c_custkey,c_name from customer", lambda: query(Customer).all().select(Customer.c_custkey, Customer.c_name))
_register(
    "select_named",
    "select o_orderkey,o_totalprice*2 as twice,case when o_totalprice>100000 then 'big' else 'small' end as size from orders",
    lambda: query(Orders).all().select(Orders.o_orderkey, twice=lambda env: Orders.o_totalprice.column(env) * 2, size=F.when(F.col("o_totalprice") > 100000, "big").otherwise("small")),
)
_register("select_distinct", "select distinct o_orderstatus from orders", lambda: query(Orders).all().select(Orders.o_orderstatus).distinct())
_register("where_eq", "select * from customer where c_mktsegment='BUILDING'", lambda: query(Customer).where(Customer.c_mktsegment == "BUILDING"))
_register("where_eq_null", "select * from customer where c_mktsegment=null", lambda: query(Customer).where(Customer.c_mktsegment == None))  # noqa: E711
_register(
    "where_cmp",
    "select * from orders where o_totalprice>=400000 and o_orderstatus<>'F'",
    lambda: query(Orders).where(Orders.o_totalprice >= 400000).where(Orders.o_orderstatus != "F"),
)
_register(
    "where_lt_lte",
    "select * from orders where o_totalprice<2000 or o_orderkey<=10",
    lambda: query(Orders).where((Orders.o_totalprice < 2000) | (Orders.o_orderkey <= 10)),
)
_register(
    "where_date",
    "select * from orders where o_orderdate>=timestamp '2001-07-01 00:00:00'",
    lambda: query(Orders).where(Orders.o_orderdate >= dt.datetime(2001, 7, 1)),
)
_register("where_like", "select * from part where p_name like 'small%'", lambda: query(Part).where(Part.p_name.like("small%")))
_register("where_not_like", "select * from part where p_name not like 'small%'", lambda: query(Part).where(Part.p_name.not_like("small%")))
_register("where_ilike", "select * from part where p_type ilike 'economy%'", lambda: query(Part).where(Part.p_type.ilike("economy%")))
_register(
    "where_similar",
    "select * from part where regexp_full_match(p_brand,'Brand#(1|2).*')",
    lambda: query(Part).where(Part.p_brand.similar_to("Brand#(1|2)%")),
)
_register("where_regex", "select * from customer where regexp_matches(c_name,'[05]$')", lambda: query(Customer).where(Customer.c_name.matches("[05]$")))
_register(
    "where_regex_ci",
    "select * from customer where regexp_matches(c_name,'(?i)CUSTOMER#0000000.5')",
    lambda: query(Customer).where(Customer.c_name.imatches("CUSTOMER#0000000.5")),
)
_register("where_in", "select * from nation where n_nationkey in (1,2,3)", lambda: query(Nation).where(Nation.n_nationkey.in_([1, 2, 3, 2])))
_register("where_not_in", "select * from nation where n_nationkey not in (1,2,3)", lambda: query(Nation).where(Nation.n_nationkey.not_in([1, 2, 3])))
_register(
    "where_between",
    "select * from orders where o_totalprice between 1000 and 5000",
    lambda: query(Orders).where(Orders.o_totalprice.between(1000, 5000)),
)
_register(
    "where_group",
    "select * from orders where o_orderstatus='O' and ((o_totalprice<2000 or o_totalprice>450000) and o_orderpriority='1-URGENT')",
    lambda: query(Orders).where(Orders.o_orderstatus == "O").where((Orders.o_totalprice < 2000).or_(Orders.o_totalprice > 450000).and_(Orders.o_orderpriority == "1-URGENT")),
)
_register(
    "where_raw",
    "select * from orders where o_totalprice % 7 < 0.5 and o_orderpriority = '1-URGENT'",
    lambda: query(Orders).where(raw("o_totalprice % 7 < 0.5 and o_orderpriority = :p", p="1-URGENT")),
)
_register("where_null", f"select c_custkey,o_orderkey from {_HV} right join customer on hv.o_custkey=c_custkey where hv.o_orderkey is null", _null_side)
_register(
    "where_not_null",
    f"select c_custkey,o_orderkey from customer left join {_HV} on hv.o_custkey=c_custkey where hv.o_orderkey is not null",
    lambda: (lambda q, hv: q.where(hv.o_orderkey.is_not_null()).select(Customer.c_custkey, hv.o_orderkey))(*_left_join()),
)
_register(
    "join_inner",
    "select * from orders join lineitem on o_orderkey=l_orderkey where o_orderkey<100",
    lambda: query(Orders).join(Lineitem, Orders.o_orderkey == Lineitem.l_orderkey).where(Orders.o_orderkey < 100),
)
_register("join_left", f"select * from customer left join {_HV} on c_custkey=hv.o_custkey", lambda: _left_join()[0].all())
_register("join_right", f"select * from {_HV} right join customer on hv.o_custkey=c_custkey", lambda: _right_join().all())
_register(
    "join_full",
    "select * from (select * from nation where n_nationkey<10) n full join (select * from region where r_regionkey<>0) r on n.n_regionkey=r.r_regionkey",
    _full_join,
)
_register("join_cross", "select * from nation cross join region", lambda: query(Nation).cross_join(Region).all())
_register(
    "join_theta",
    "select * from nation join region on n_regionkey<r_regionkey",
    lambda: query(Nation).join(Region, Nation.n_regionkey < Region.r_regionkey).all(),
)
_register(
    "join_theta_full",
    "select * from nation full join region on n_regionkey<r_regionkey",
    lambda: query(Nation).full_join(Region, Nation.n_regionkey < Region.r_regionkey).all(),
)
_register(
    "join_like",
    "select n_name,r_name from nation join region on n_name like r_name || '%' or n_regionkey=r_regionkey",
    lambda: query(Nation).join(Region, Nation.n_name.satisfies(lambda n, r: F.like(n, F.concat(r, F.lit("%"))), Region.r_name) | (Nation.n_regionkey == Region.r_regionkey)).all().select(Nation.n_name, Region.r_name),
)
_register(
    "join_unary",
    "select n_nationkey,r_regionkey from nation join region on n_name is not null and n_regionkey=r_regionkey",
    lambda: query(Nation).join(Region, Nation.n_name.is_not_null() & (Nation.n_regionkey == Region.r_regionkey)).all().select(Nation.n_nationkey, Region.r_regionkey),
)
_register(
    "join_multi_on",
    "select * from customer join supplier on c_nationkey=s_nationkey and c_acctbal<s_acctbal where c_custkey<50",
    lambda: query(Customer).join(Supplier, (Customer.c_nationkey == Supplier.s_nationkey) & (Customer.c_acctbal < Supplier.s_acctbal)).where(Customer.c_custkey < 50),
)
_register(
    "join5",
    "select * from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join "
    "region on n_regionkey=r_regionkey where r_name='ASIA' and l_quantity>48",
    lambda: query(Lineitem).join(Orders, Lineitem.l_orderkey == Orders.o_orderkey).join(Customer, Orders.o_custkey == Customer.c_custkey).join(Nation, Customer.c_nationkey == Nation.n_nationkey).join(Region, Nation.n_regionkey == Region.r_regionkey).where(Region.r_name == "ASIA").where(Lineitem.l_quantity > 48),
)
_register(
    "join_self",
    "select a.n_nationkey as a_key,b.n_nationkey as b_key from nation a join nation b on a.n_regionkey=b.n_regionkey and a.n_nationkey<b.n_nationkey",
    _self_join,
)
_register(
    "join_semi",
    "select * from customer where c_custkey in (select o_custkey from orders)",
    lambda: query(Customer).join(Orders, Customer.c_custkey == Orders.o_custkey, "left_semi").all(),
)
_register(
    "where_col_col",
    "select * from customer join supplier on c_acctbal<s_acctbal where c_nationkey=s_nationkey and c_custkey<50",
    lambda: query(Customer).join(Supplier, Customer.c_acctbal < Supplier.s_acctbal).where(Customer.c_nationkey == Supplier.s_nationkey).where(Customer.c_custkey < 50),
)
_register("agg_max", "select max(o_totalprice) as v from orders where o_orderstatus='O'", lambda: _OPEN.aggregate(v=max_of(Orders.o_totalprice)))
_register("agg_min", "select min(o_totalprice) as v from orders where o_orderstatus='O'", lambda: _OPEN.aggregate(v=min_of(Orders.o_totalprice)))
_register("agg_sum_long", "select cast(sum(o_custkey) as bigint) as v from orders where o_orderstatus='O'", lambda: _OPEN.aggregate(v=sum_of(Orders.o_custkey)))
_register("agg_count", "select count(o_orderkey) as v from orders where o_orderstatus='O'", lambda: _OPEN.aggregate(v=count_of(Orders.o_orderkey)))
_register("agg_count_all", "select count(*) as v from orders where o_orderstatus='O'", lambda: _OPEN.aggregate(v=count_all))
_register(
    "agg_coalesce",
    "select coalesce(max(o_orderkey),0) as v from orders where o_orderstatus='none'",
    lambda: query(Orders).where(Orders.o_orderstatus == "none").aggregate(v=max_of(Orders.o_orderkey).or_else(0)),
)
_register(
    "agg_count_distinct",
    "select count(distinct o_custkey) as v from orders",
    lambda: query(Orders).all().aggregate(v=count_distinct_of(Orders.o_custkey)),
)
_register(
    "agg_derived",
    "select count(*) as v from (select * from orders where o_totalprice>450000) hv where hv.o_orderstatus='O'",
    lambda: (lambda hv: query(hv).where(hv.o_orderstatus == "O").aggregate(v=count_all))(_valuable()),
)
_register(
    "group_by",
    "select o_orderstatus,count(*) as n from orders group by o_orderstatus having count(*)>10",
    lambda: query(Orders).all().group_by(Orders.o_orderstatus).agg(n=count_all).having(lambda df: df["n"] > 10),
)
_register(
    "in_sub",
    "select * from customer where c_custkey in (select o_custkey from orders where o_totalprice>450000)",
    lambda: query(Customer).where(Customer.c_custkey.in_query(_rich(450000))),
)
_register(
    "not_in_sub",
    "select * from customer where c_custkey not in (select o_custkey from orders where o_totalprice>300000)",
    lambda: query(Customer).where(Customer.c_custkey.not_in_query(_rich(300000))),
)
_register(
    "exists_corr",
    "select * from customer c where exists (select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>450000)",
    lambda: query(Customer).where(_correlated(450000)),
)
_register(
    "not_exists",
    "select * from customer c where not exists (select 1 from orders o where o.o_custkey=c.c_custkey and o.o_totalprice>300000)",
    lambda: query(Customer).where(~_correlated(300000)),
)
_register(
    "nested_sub",
    "select * from supplier where s_suppkey in (select l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice>499900))",
    lambda: query(Supplier).where(Supplier.s_suppkey.in_query(query(Lineitem).where(Lineitem.l_orderkey.in_query(query(Orders).where(Orders.o_totalprice > 499900).select(Orders.o_orderkey))).select(Lineitem.l_suppkey))),
)
_register(
    "derived",
    "select * from (select * from orders where o_totalprice>450000) hv where hv.o_orderstatus='O'",
    lambda: (lambda hv: query(hv).where(hv.o_orderstatus == "O"))(_valuable()),
)
_register(
    "derived_join",
    "select * from (select o_orderkey,o_custkey,o_totalprice from orders where o_totalprice>450000) hv join customer on hv.o_custkey=c_custkey",
    lambda: (lambda hv: query(hv).join(Customer, hv.o_custkey == Customer.c_custkey).all())(_valuable((Orders.o_orderkey, Orders.o_custkey, Orders.o_totalprice))),
)
_register(
    "seek_after",
    "select * from orders where o_orderkey>500 order by o_orderkey asc nulls last limit 20",
    lambda: query(Orders).seek_after(Orders.o_orderkey, 500).limit(20),
)
_register(
    "seek_before",
    "select * from orders where o_orderkey<500 order by o_orderkey desc nulls first limit 20",
    lambda: query(Orders).seek_before(Orders.o_orderkey, 500).limit(20),
)
_register("offset_page", "select * from orders order by o_orderkey limit 10 offset 20", lambda: query(Orders).order_by(Orders.o_orderkey).limit(10).offset(20))
_register(
    "nulls_first",
    f"select c_custkey,o_orderkey from customer left join {_HV} on c_custkey=hv.o_custkey order by o_orderkey asc nulls first,c_custkey limit 50",
    lambda: _sorted_nulls(True),
)
_register(
    "nulls_last",
    f"select c_custkey,o_orderkey from customer left join {_HV} on c_custkey=hv.o_custkey order by o_orderkey desc nulls last,c_custkey limit 50",
    lambda: _sorted_nulls(False),
)
_register(
    "row_number",
    "select o_orderkey,cast(row_number() over(partition by o_custkey order by o_orderkey) as bigint) as rn from orders",
    lambda: query(Orders).all().select(Orders.o_orderkey, rn=lambda env: row_number([Orders.o_custkey], [Orders.o_orderkey.asc()])(env).cast("long")),
)
_register(
    "union",
    "select c_nationkey as k from customer union select s_nationkey from supplier",
    lambda: sql("select {c.c_nationkey} as k from {c} union select {s.s_nationkey} from {s}", c=Customer, s=Supplier),
)
_register(
    "union_all",
    "select c_nationkey as k from customer union all select s_nationkey from supplier",
    lambda: sql("select {c.c_nationkey} as k from {c} union all select {s.s_nationkey} from {s}", c=Customer, s=Supplier),
)
_register(
    "intersect",
    "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    lambda: sql("select {c.c_nationkey} as k from {c} intersect select {s.s_nationkey} from {s}", c=Customer, s=Supplier),
)
_register(
    "except",
    "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal>5000",
    lambda: sql("select {n.n_nationkey} as k from {n} except select {s.s_nationkey} from {s} where {s.s_acctbal} > {x}", n=Nation, s=Supplier, x=5000),
)
_register(
    "cte_recursive",
    "with recursive r(n) as (select 1 union all select n+1 from r where n<5) select n from r",
    lambda: sql("with recursive r(n) as (select {one} union all select n+1 from r where n<{five}) select n from r", one=1, five=5),
)
_register(
    "raw_window",
    "select o_orderkey,cast(rank() over(partition by o_orderstatus order by o_totalprice desc,o_orderkey) as bigint) as r from orders",
    lambda: sql("select {o.o_orderkey}, cast(rank() over (partition by {o.o_orderstatus} order by {o.o_totalprice} desc, {o.o_orderkey}) as bigint) as r from {o}", o=Orders),
)
_register(
    "raw_rollup",
    "select o_orderstatus,o_orderpriority,count(*) as n from orders group by rollup(o_orderstatus,o_orderpriority)",
    lambda: sql("select {o.o_orderstatus}, {o.o_orderpriority}, count(*) as n from {o} group by rollup({o.o_orderstatus}, {o.o_orderpriority})", o=Orders),
)
_register(
    "raw_scalar_sub",
    "select count(*) as n from orders where o_totalprice>(select avg(o_totalprice) from orders)",
    lambda: sql("select count(*) as n from {o} where {o.o_totalprice} > (select avg({i.o_totalprice}) from {i})", o=Orders, i=Orders.as_("inner_orders")),
)
_register(
    "json_extract",
    "select event_id,json_extract_string(props,'$.k') as k from events",
    lambda: query(Events).all().select(Events.event_id, k=Events.props.json("k")),
)
_register(
    "json_path",
    "select event_id from events where json_extract_string(props,'$.k')='69'",
    lambda: query(Events).where(Events.props.json("k") == "69").select(Events.event_id),
)
_register(
    "json_has",
    "select event_id from events where json_exists(props,'$.k')",
    lambda: query(Events).where(Events.props.json_has("k")).select(Events.event_id),
)
_register(
    "json_any_key",
    "select event_id from events where json_exists(props,'$.k') or json_exists(props,'$.z')",
    lambda: query(Events).where(Events.props.json_has_any("k", "z")).select(Events.event_id),
)
_register(
    "json_all_keys",
    "select event_id from events where json_exists(props,'$.k') and json_exists(props,'$.z')",
    lambda: query(Events).where(Events.props.json_has_all("k", "z")).select(Events.event_id),
)
_register(
    "json_contains",
    "select event_id from events where json_contains(props,'{\"k\": 69}')",
    lambda: query(Events).where(Events.props.json_contains({"k": 69})).select(Events.event_id),
)
_register(
    "array_contains",
    "select vec_id,list_contains(embedding,embedding[1]) as h from embeddings",
    lambda: query(Embeddings).all().select(Embeddings.vec_id, h=lambda env: F.array_contains(Embeddings.embedding.column(env), Embeddings.embedding.column(env)[0])),
)


def _query(name: str, oracle: str | None = None):
    def put(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return run

    return put


@_query("agg_sum", "select cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as v from lineitem where l_returnflag='R'")
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = query(Lineitem).where(Lineitem.l_returnflag == "R").select(p=lambda env: Lineitem.l_extendedprice.column(env).cast("decimal(18,2)")).as_table("t")
    return _database(spark, sf_dir).df(query(exact).all().aggregate(v=sum_of(exact.p))).select(F.col("v").cast("decimal(28,2)").alias("v"))


@_query("agg_avg", "select round(avg(o_custkey),4) as v from orders where o_orderstatus='O'")
def agg_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _database(spark, sf_dir).df(_OPEN.aggregate(v=avg_of(Orders.o_custkey))).select(F.round("v", 4).alias("v"))


@_query("paged_concat", "select r_regionkey,r_name from region")
def paged_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    return spark.createDataFrame(list(items(db.pages(query(Region).all(), Region.r_regionkey, 2))), Region.spark_schema())


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one stands in on a local master only, where nobody else needs to see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="tessera-store-")


def _changed(spark: SparkSession, sf_dir: str, change: Callable[[Database], object]) -> DataFrame:
    """``nation`` after a change, on a copy in a store of its own."""
    db = Database(spark, Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}"), [Nation])
    ddl.create(db, Nation)
    db.execute(Insert(Nation).from_query(_FromFrame(_database(spark, sf_dir).table(Nation))))
    change(db)
    return db.df(query(Nation).all())


class _FromFrame:
    """A DataFrame in the place of a query."""

    def __init__(self, df: DataFrame):
        self.df = df

    def lower(self, db: Database, around: object) -> DataFrame:
        return self.df


_NEW, _ADD = Nation(n_nationkey=0, n_name="NEW", n_regionkey=1), Nation(n_nationkey=99, n_name="ADD", n_regionkey=2)
_REST = "select * from nation where n_nationkey"
_CHANGES = {
    "insert": (f"{_REST} >= 0 union all select 99,'ADD',2", lambda db: db.execute(Insert(Nation).values(n_nationkey=99, n_name="ADD", n_regionkey=2))),
    "update": ("select n_nationkey, case when n_regionkey=1 then 'X' else n_name end as n_name, n_regionkey from nation", lambda db: db.execute(Update(Nation).set(Nation.n_name, "X").where(Nation.n_regionkey == 1))),
    "delete": (f"{_REST} >= 5", lambda db: db.execute(Delete(Nation).where(Nation.n_nationkey < 5))),
    "upsert": (f"{_REST} not in (0,99) union all select 0,'NEW',1 union all select 99,'ADD',2", lambda db: db.execute(Upsert.of(_NEW, _ADD).on_conflict(Nation.n_nationkey).update_all())),
    "upsert_where": (f"{_REST} >= 0 union all select 99,'ADD',2", lambda db: db.execute(Upsert.of(_NEW, _ADD).on_conflict(Nation.n_nationkey).update_all().where(Nation.n_regionkey > excluded(Nation.n_regionkey)))),
    "do_nothing": (f"{_REST} >= 0 union all select 99,'ADD',2", lambda db: db.execute(Upsert.of(_NEW, _ADD).on_conflict(Nation.n_nationkey).do_nothing())),
}
for _name, (_oracle, _change) in _CHANGES.items():
    QUERIES[_name] = lambda spark, sf_dir, change=_change: _changed(spark, sf_dir, change)
    ORACLE_SQL[_name] = _oracle


@_query("delete_returning", "select * from nation where n_nationkey < 5")
def delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = []
    _changed(spark, sf_dir, lambda db: got.extend(db.returning(Delete(Nation).where(Nation.n_nationkey < 5))))
    return spark.createDataFrame(got, Nation.spark_schema())


@_query("verify_report", "select * from (values ('missing column', 'n_name'), ('type mismatch', 'n_regionkey is string, not int')) t(kind, what)")
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds when a column is gone and another has changed its type."""
    found = []

    def change(db: Database) -> None:
        ddl.drop_column(db, Nation, "n_name")
        ddl.retype_column(db, Nation, "n_regionkey", T.StringType())
        found.extend((i.kind, i.what) for i in ddl.differences(db, Nation))
        ddl.truncate(db, Nation)
        ddl.add_column(db, Nation, Nation.field("n_name"))
        ddl.retype_column(db, Nation, "n_regionkey", T.IntegerType())

    _changed(spark, sf_dir, change)
    return spark.createDataFrame(found, "kind string, what string")


@_query("event_windows", "select time_bucket(interval '1 day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(_database(spark, sf_dir).table(Events), "ts", "1 day", ["event_type"]).select("start", "event_type", "n")


from . import change_queries  # noqa: E402, F401  registers its own
