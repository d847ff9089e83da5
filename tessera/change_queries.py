"""Registered queries over the store, results, sources, DDL, verification, raw SQL and limits; each with the SQL that it must agree with."""

from __future__ import annotations

import dataclasses
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Annotated, Any

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import (
    Catalog, Database, Delete, Files, Fragment, Insert, Int, Jdbc, Json, Store, Table, Update, Upsert, approx_distinct_of, column, count_all, count_distinct_of, ddl, excluded,
    exists, foreign_key, ident, index, items, max_of, min_of, outer, over, query, scalar, sql, unique, unsafe, value_list,
)
from .errors import QueryFailure, Unsupported, classify
from .functions.codecs import Codec
from .plans.expr import Aggregate
from .queries import Customer, Events, Lineitem, Nation, Orders, Region, _changed, _database, _FromFrame, _query, _register, shared_root
from .streaming.events import session_counts, windowed_counts

_REST = "select * from nation where n_nationkey"
_ADD = Nation(n_nationkey=99, n_name="ADD", n_regionkey=2)


class Named(Table, name="named"):
    id: Int = column(key=True, generated=True)
    name: str


class Kept(Table, name="region"):
    r_regionkey: Int = column(key=True)
    r_name: str


class Held(Table, name="nation"):
    n_nationkey: Int = column(key=True)
    n_name: str
    n_regionkey: Int | None
    constraints = (foreign_key("n_regionkey", to=Kept, at="r_regionkey", on_delete="cascade", on_update="cascade"),)


class Loose(Table, name="nation"):
    n_nationkey: Int = column(key=True)
    n_name: str
    n_regionkey: Int | None
    constraints = (foreign_key("n_regionkey", to=Kept, at="r_regionkey", on_delete="set null"), unique("n_name"))


class Qualified(Table, name="tpch.nation"):
    n_nationkey: Int = column(key=True)
    n_name: str


class Short(Table, name="nation"):
    n_name: str


def _store(spark: SparkSession, *tables: type[Table]) -> Database:
    db = Database(spark, Store(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}"), list(tables))
    for t in tables:
        ddl.create(db, t)
    return db


def _filled(spark: SparkSession, sf_dir: str, *tables: type[Table]) -> Database:
    db, source = _store(spark, *tables), _database(spark, sf_dir)
    for t in tables:
        db.execute(Insert(t).from_query(_FromFrame(source.table(t))))
    return db


def _change(name: str, oracle: str, change: Callable[[Database], Any]) -> None:
    """``nation`` after a change."""
    _query(name, oracle)(lambda spark, sf_dir: _changed(spark, sf_dir, change))


def _gives(name: str, oracle: str, schema: Any, get: Callable[[Database], list]) -> None:
    """What a statement on a copy of ``nation`` gives back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got: list = []
        _changed(spark, sf_dir, lambda db: got.extend(get(db)))
        return spark.createDataFrame(got, schema)

    _query(name, oracle)(run)


def _reads(name: str, oracle: str, schema: Any, get: Callable[[Database], list]) -> None:
    """What reading the tables gives on the driver."""
    _query(name, oracle)(lambda spark, sf_dir: spark.createDataFrame(get(_database(spark, sf_dir)), schema))


# selecting

_register(
    "distinct_sorted",
    "select distinct o_orderpriority as p, o_orderstatus from orders order by o_orderstatus desc nulls first, p limit 7",
    lambda: query(Orders).limit(7).select(Orders.o_orderstatus, p=Orders.o_orderpriority).distinct().order_by(Orders.o_orderstatus.desc(), Orders.o_orderpriority),
)
_register(
    "distinct_seek",
    "select distinct o_custkey from orders where o_custkey < 700 order by o_custkey desc limit 9",
    lambda: query(Orders).seek_before(Orders.o_custkey, 700).limit(9).select(Orders.o_custkey).distinct(),
)
_register("select_all_as", "select n_name from nation", lambda: query(Nation).all().select_all(Short))
_register(
    "prebuilt_seek",
    "select * from nation where n_nationkey > 7 order by n_nationkey limit 5",
    lambda: query(Nation).seek(Nation.n_nationkey.after(7)).limit(5),
)
_register("where_blank", f"{_REST} < 4", lambda: query(Nation).where(Nation.n_nationkey < 4).all())
_register("schema_qualified", "select n_nationkey, n_name from nation", lambda: query(Qualified).all())
_register(
    "typed_union",
    "select c_nationkey from customer union select n_nationkey from nation",
    lambda: query(Customer).all().select(Customer.c_nationkey).union(query(Nation).all().select(Nation.n_nationkey)),
)
_register(
    "typed_union_all",
    "select n_nationkey from nation union all select r_regionkey from region",
    lambda: query(Nation).all().select(Nation.n_nationkey).union_all(query(Region).all().select(Region.r_regionkey)),
)
_register(
    "typed_intersect",
    "select n_nationkey from nation intersect select r_regionkey from region",
    lambda: query(Nation).all().select(Nation.n_nationkey).intersect(query(Region).all().select(Region.r_regionkey)),
)
_register(
    "typed_except",
    "select n_nationkey from nation except select r_regionkey from region",
    lambda: query(Nation).all().select(Nation.n_nationkey).except_(query(Region).all().select(Region.r_regionkey)),
)
_register(
    "typed_scalar_sub",
    "select o_orderkey from orders where o_custkey = (select max(o_custkey) from orders)",
    lambda: query(Orders).where(Orders.o_custkey == scalar(query(Orders).all().aggregate(v=max_of(Orders.o_custkey)))).select(Orders.o_orderkey),
)
_register(
    "typed_rollup",
    "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup(o_orderstatus, o_orderpriority)",
    lambda: query(Orders).all().group_by(Orders.o_orderstatus, Orders.o_orderpriority).rollup().agg(n=count_all),
)
_register(
    "typed_cube",
    "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube(o_orderstatus, o_orderpriority)",
    lambda: query(Orders).all().group_by(Orders.o_orderstatus, Orders.o_orderpriority).cube().agg(n=count_all),
)
_register(
    "typed_windows",
    """select o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderpriority) as bigint) as r,
       lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders""",
    lambda: query(Orders).all().select(
        Orders.o_orderkey,
        r=lambda env: over(F.dense_rank(), [Orders.o_custkey], [Orders.o_orderpriority.asc()])(env).cast("long"),
        before=over(lambda env: F.lag(Orders.o_orderkey.column(env)), [Orders.o_custkey], [Orders.o_orderkey.asc()]),
    ),
)


@_query("agg_approx_distinct", "select true as close")
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate beside the exact number, as whether they are within a tenth of each other."""
    found = _database(spark, sf_dir).df(query(Orders).all().aggregate(near=approx_distinct_of(Orders.o_custkey), exact=count_distinct_of(Orders.o_custkey)))
    return found.select((F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * 0.1).alias("close"))


# results

_reads("get_by_key", f"{_REST} = 7", Nation.spark_schema(), lambda db: [tuple(db.by_key(Nation, 7).stored().values())])
_reads(
    "first_row",
    "select n_nationkey from nation order by n_name desc limit 1",
    "n_nationkey int",
    lambda db: [tuple(db.one(query(Nation).order_by(Nation.n_name.desc()).all().select(Nation.n_nationkey)))],
)
_reads(
    "scalar_value",
    "select max(n_nationkey) as v, cast(null as int) as none from nation",
    "v int, none int",
    lambda db: [(db.value(query(Nation).all().aggregate(v=max_of(Nation.n_nationkey))), db.value(query(Nation).where(Nation.n_nationkey < 0)))],
)
_reads("tuples", "select r_regionkey, r_name from region", "r_regionkey int, r_name string", lambda db: db.tuples(query(Region).all(), 2))
_reads(
    "row_stream",
    "select n_nationkey from nation order by n_nationkey limit 8",
    "n_nationkey int",
    lambda db: [(r.n_nationkey,) for _, r in zip(range(8), db.stream(query(Nation).order_by(Nation.n_nationkey).all(), Nation))],
)
_reads(
    "seeking_stream",
    f"{_REST} > 3",
    Nation.spark_schema(),
    lambda db: [tuple(r.stored().values()) for r in db.seeking(query(Nation).all(), Nation.n_nationkey, 4, after=3, into=Nation)],
)


def _checkpoints(db: Database) -> list[tuple]:
    seen: list = []
    n = len(list(items(db.pages(query(Nation).all(), Nation.n_nationkey, 10), seen.append)))
    return [(n, i, c) for i, c in enumerate(seen, 1)]


_reads("checkpoints", "select 25 as n, * from (values (1, 9), (2, 19), (3, 24)) t(page, cursor)", "n int, page int, cursor int", _checkpoints)

# sources and sinks


@_query("file_formats", "select format, n_nationkey, n_name from nation, (values ('csv'), ('json'), ('orc'), ('parquet')) f(format)")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``nation`` written and read again in every format."""
    root, source = f"{shared_root(spark)}/formats-{uuid.uuid4().hex}", _database(spark, sf_dir).table(Nation)
    out = []
    for format in ("csv", "json", "orc", "parquet"):
        source.write.format(format).save(f"{root}/nation.{format}")
        db = Database(spark, Files(root, format, schemas={"nation": Nation.spark_schema()}))
        out.append(db.df(query(Nation).all().select(Nation.n_nationkey, Nation.n_name, format=F.lit(format))))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _derby(spark: SparkSession) -> tuple[str, Any]:
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    return url, spark._jvm.java.sql.DriverManager.getConnection(url)


def _own_folder(spark: SparkSession) -> str:
    """The shared folder's path in the machines' own file system, for what doesn't open others; a temporary one stands in where this JVM runs all tasks."""
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    found = fs.resolvePath(at).toUri()
    if found.getScheme() == "file":
        return found.getPath()
    if not spark.sparkContext._jsc.sc().isLocal():
        raise Unsupported(f"an embedded database needs a shared folder that all machines mount, not {found.getScheme()}")
    return tempfile.mkdtemp(prefix="tessera-derby-")


def _archived(spark: SparkSession, name: str, fill: Callable[[Any], None]) -> str:
    """The URL of a database that ``fill`` makes, as an archive in the shared folder. A folder is one JVM's at a time; an archive is read-only, and any number may open it."""
    manager = spark._jvm.java.sql.DriverManager
    with tempfile.TemporaryDirectory(prefix="tessera-derby-") as root:
        held = manager.getConnection(f"jdbc:derby:{root}/{name};create=true")
        held.setAutoCommit(False)
        try:
            fill(held)
            held.commit()
        finally:
            held.rollback()
            held.close()
            try:
                manager.getConnection(f"jdbc:derby:{root}/{name};shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # how Derby says that it is shut
                    raise
        return f"jdbc:derby:jar:({shutil.make_archive(f'{_own_folder(spark)}/derby-{uuid.uuid4().hex}', 'zip', root)}){name}"


@_query("jdbc_source", f"{_REST} > 20")
def jdbc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a database that all JVMs open; read by ranges, one a task, conditions pushed to it. The driver fills it, a row at a time."""

    def fill(held: Any) -> None:
        held.createStatement().execute("create table nation (n_nationkey int not null primary key, n_name varchar(40) not null, n_regionkey int not null)")
        put = held.prepareStatement("insert into nation values (?, ?, ?)")
        for row in _database(spark, sf_dir).stream(query(Nation).all()):
            for i, value in enumerate(row, 1):
                put.setObject(i, value)
            put.executeUpdate()

    db = Database(spark, Jdbc(_archived(spark, "nation", fill), ranges={"nation": ("n_nationkey", 0, 24, 3)}))
    return db.df(query(Nation).where(Nation.n_nationkey > 20))


@_query(
    "jdbc_verify",
    "select * from (values ('extra column', 'UPDATED'), ('missing index', 'n_regionkey'), ('nullability mismatch', 'n_regionkey'), ('type mismatch', "
    "'n_name is int, not string')) t(kind, what)",
)
def jdbc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declaration against the database's own catalog: key, unique constraint and foreign key agree, four other things don't."""

    class Own(Table, name="nation"):
        n_nationkey: Int = column(key=True)
        n_name: str
        n_regionkey: Int | None
        constraints = (foreign_key("n_regionkey", to=Kept, at="r_regionkey"), unique("n_name"), index("n_regionkey", unique=True))

    url, held = _derby(spark)
    run = held.createStatement()
    run.execute("create table region (r_regionkey int not null primary key, r_name varchar(40))")
    run.execute("create table nation (n_nationkey int not null primary key, n_name int not null unique, n_regionkey int not null references region(r_regionkey), updated timestamp)")
    found = ddl.differences(Database(spark, Jdbc(url)), Own)
    return spark.createDataFrame([(i.kind, i.what) for i in found], "kind string, what string")


@_query("catalog_source", "select n_nationkey, n_name from nation where n_nationkey < 3")
def catalog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = f"nation_{uuid.uuid4().hex}"
    _database(spark, sf_dir).table(Nation).createOrReplaceTempView(view)
    table = type(Table)("Viewed", (Table,), {"__module__": __name__, "__annotations__": {"n_nationkey": Int, "n_name": str}}, name=view)
    return Database(spark, Catalog()).df(query(table).where(table.n_nationkey < 3))


# changes

_gives(
    "insert_returning",
    "select 99 as n_nationkey, 'ADD' as n_name, 2 as n_regionkey",
    Nation.spark_schema(),
    lambda db: [tuple(r.stored().values()) for r in db.insert(_ADD)],
)
_change("update_by_key", f"{_REST} <> 3 union all select 3, 'THREE', 4", lambda db: db.update(Nation(n_nationkey=3, n_name="THREE", n_regionkey=4)))
_change(
    "update_expression",
    "select n_nationkey, case when n_nationkey > 20 then lower(n_name) else n_name end as n_name, case when n_nationkey > 20 then n_regionkey + 10 else n_regionkey end as n_regionkey from nation",
    lambda db: db.execute(Update(Nation).set(Nation.n_name, F.lower("n_name")).set(Nation.n_regionkey, F.col("n_regionkey") + 10).where(Nation.n_nationkey > 20)),
)
_gives(
    "update_returning",
    "select n_nationkey, 'R' as n_name, n_regionkey from nation where n_regionkey = 2",
    Nation.spark_schema(),
    lambda db: db.returning(Update(Nation).set(Nation.n_name, "R").where(Nation.n_regionkey == 2)),
)
_change(
    "update_subquery",
    f"select n_nationkey, case when n_nationkey in (select min(n_nationkey) from nation) then 'LEAST' else n_name end as n_name, n_regionkey from nation",
    lambda db: db.execute(Update(Nation).set(Nation.n_name, "LEAST").where(Nation.n_nationkey.in_query(query(Nation).all().aggregate(v=min_of(Nation.n_nationkey))))),
)
_change("delete_by_key", f"{_REST} <> 11", lambda db: db.delete(Nation(n_nationkey=11, n_name="", n_regionkey=0)))
_change(
    "delete_group",
    f"{_REST} between 3 and 20 or n_name = 'JAPAN'",
    lambda db: db.execute(Delete(Nation).where((Nation.n_nationkey < 3).or_(Nation.n_nationkey > 20).and_(Nation.n_name != "JAPAN"))),
)
_gives("delete_all_returning", "select * from nation", Nation.spark_schema(), lambda db: db.returning(Delete(Nation).all()))
_change(
    "upsert_and_or",
    "select n_nationkey, case when n_nationkey in (1, 3) then 'UP' else n_name end as n_name, case when n_nationkey in (1, 3) then 1 else n_regionkey end as n_regionkey from nation",
    lambda db: db.execute(
        Upsert.of(*[Nation(n_nationkey=k, n_name="UP", n_regionkey=1) for k in range(4)])
        .on_conflict(Nation.n_nationkey)
        .update_all()
        .where((Nation.n_nationkey == 1).or_(Nation.n_nationkey > 2).and_(Nation.n_name != excluded(Nation.n_name)))
    ),
)
_gives(
    "upsert_returning",
    "select 0 as n_nationkey, 'ZERO' as n_name, 0 as n_regionkey union all select 99, 'ADD', 2",
    Nation.spark_schema(),
    lambda db: db.returning(Upsert.of(Nation(n_nationkey=0, n_name="ZERO", n_regionkey=0), _ADD).on_conflict(Nation.n_nationkey).update_all()),
)


def _affected(db: Database) -> list[tuple]:
    return [
        ("insert", db.execute(Insert(Nation).values(n_nationkey=99, n_name="ADD", n_regionkey=2).values(n_nationkey=98, n_name="ADD", n_regionkey=2))),
        ("update", db.execute(Update(Nation).set(Nation.n_name, "N").where(Nation.n_regionkey == 2))),
        ("upsert nothing", db.execute(Upsert.of(_ADD).on_conflict(Nation.n_nationkey).do_nothing())),
        ("delete", db.execute(Delete(Nation).where(Nation.n_name == "N"))),
        ("delete none", db.execute(Delete(Nation).where(Nation.n_name == "N"))),
    ]


_gives(
    "affected_rows",
    "select * from (values ('insert', 2), ('update', 7), ('upsert nothing', 0), ('delete', 7), ('delete none', 0)) t(change, n)",
    "change string, n long",
    _affected,
)


@_query("generated_ids", "select count(*) as n, 1 as low, count(*) as high, count(*) as ids from customer")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of rows from a query in several partitions: from 1, without gaps, in an int."""
    db = _store(spark, Named)
    names = _database(spark, sf_dir).table(Customer).select(F.col("c_name").alias("name")).repartition(4, "name")
    db.execute(Insert(Named).from_query(_FromFrame(names)))
    return db.df(query(Named).all()).agg(F.count("*").alias("n"), F.min("id").cast("int").alias("low"), F.max("id").cast("long").alias("high"), F.count_distinct("id").alias("ids"))


_change(
    "raw_insert",
    f"{_REST} >= 0 union all select 99, 'it''s', 2 union all select 98, 'B', 1",
    lambda db: db.execute(sql("insert into {n} (n_regionkey, n_nationkey, n_name) values (2, 99, {x}), (1, 98, 'B')", n=Nation, x="it's")),
)
_change(
    "raw_insert_select",
    f"{_REST} >= 0 union all select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = 1",
    lambda db: db.execute(sql("insert into nation select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = {r}", r=1)),
)
_change(
    "raw_update",
    "select n_nationkey, case when n_regionkey = 1 then n_name || ', where' else n_name end as n_name, n_regionkey from nation",
    lambda db: db.execute(sql("update {n} set {n.n_name} = concat({n.n_name}, ', where') where {n.n_regionkey} = {r}", n=Nation, r=1)),
)
_change("raw_delete", f"{_REST} >= 5", lambda db: db.execute(sql("delete from nation where nation.n_nationkey < {k}", k=5)))


@_query("raw_ddl", "select * from (values (1, 'a'), (2, 'b')) t(id, name)")
def raw_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _store(spark)
    db.execute(sql("create table plain (id int primary key, name string)"))
    db.execute(sql("create table if not exists plain (id int)"))
    db.execute(sql("insert into plain values (1, 'x'), (7, 'y')"))
    db.execute(sql("truncate table plain"))
    db.execute(sql("insert into plain values (1, 'a'), (2, 'b')"))
    db.execute(sql("drop table if exists nothing"))
    return db.store.read(spark, "plain")


# constraints, transactions


@_query("fk_cascade", "select * from nation where n_regionkey <> 0")
def fk_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _filled(spark, sf_dir, Kept, Held)
    db.execute(Delete(Kept).where(Kept.r_regionkey == 0))
    return db.df(query(Held).all())


@_query("fk_update_cascade", "select n_nationkey, n_name, case when n_regionkey = 0 then 70 else n_regionkey end as n_regionkey from nation")
def fk_update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _filled(spark, sf_dir, Kept, Held)
    db.execute(Update(Kept).set(Kept.r_regionkey, 70).where(Kept.r_regionkey == 0))
    return db.df(query(Held).all())


@_query("fk_set_null", "select n_nationkey, n_name, nullif(n_regionkey, 0) as n_regionkey from nation")
def fk_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _filled(spark, sf_dir, Kept, Loose)
    db.execute(Delete(Kept).where(Kept.r_regionkey == 0))
    return db.df(query(Loose).all())


def _refused(action: Callable[[], Any]) -> str:
    try:
        action()
    except QueryFailure as e:
        return type(e).__name__
    return "taken"


@_query(
    "constraints",
    "select * from (values ('foreign key', 'ConstraintViolation'), ('key', 'ConstraintViolation'), ('key missing', 'MissingKey'), ('null', "
    "'ConstraintViolation'), ('partial index', 'ConstraintViolation'), ('outside it', 'taken'), ('random', 'InvalidStatement'), ('unique', "
    "'ConstraintViolation')) t(what, outcome)",
)
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of constraint against a row that breaks it; a partial unique index, made later, counts among its rows alone."""
    db = _filled(spark, sf_dir, Kept, Loose)
    ddl.create_index(db, Loose, index("n_regionkey", name="later", unique=True, where=lambda t: t.n_nationkey > 100))
    put = lambda *v: db.execute(Insert(Loose).values(**dict(zip(("n_nationkey", "n_name", "n_regionkey"), v))))
    put(101, "first", 1)
    tries = {
        "key": lambda: put(1, "X", 1), "null": lambda: put(200, None, 1), "unique": lambda: put(201, "CHINA", 1), "foreign key": lambda: put(202, "Y", 77),
        "partial index": lambda: put(102, "second", 1), "outside it": lambda: put(60, "third", 1), "key missing": lambda: db.delete(Short(n_name="x")),
        "random": lambda: db.execute(Delete(Loose).where(Loose.n_nationkey.satisfies(lambda c: F.rand() < 0.5))),
    }
    return spark.createDataFrame([(k, _refused(t)) for k, t in tries.items()], "what string, outcome string")


@_query(
    "transaction",
    "select 'after failure' as moment, count(*) as nations, (select count(*) from region) as regions from nation union all select 'after commit', "
    "count(*) - 1, (select count(*) + 1 from region) from nation",
)
def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of two tables: none of them after a failure, all of them after a commit."""
    db = _filled(spark, sf_dir, Kept, Loose)
    counts = lambda moment: (moment, db.value(query(Loose).all().aggregate(n=count_all)), db.value(query(Kept).all().aggregate(n=count_all)))

    def both(last: Callable[[], Any]) -> None:
        with db.transaction():
            db.execute(Insert(Kept).values(r_regionkey=9, r_name="NINE"))
            db.execute(Delete(Loose).where(Loose.n_nationkey == 4))
            last()

    _refused(lambda: both(lambda: db.execute(Insert(Kept).values(r_regionkey=9, r_name="AGAIN"))))
    out = [counts("after failure")]
    both(lambda: None)
    return spark.createDataFrame([*out, counts("after commit")], "moment string, nations long, regions long")


@_query("write_conflict", f"select 'Retryable' as outcome, count(*) + 1 as n from nation")
def write_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two writers one wins; the other gets a failure that may be tried again."""
    db = _filled(spark, sf_dir, Nation)
    other = Database(spark, Store(spark, db.store.folder.root), [Nation])

    def mine() -> None:
        with db.transaction():
            db.execute(Delete(Nation).where(Nation.n_nationkey == 1))
            other.insert(_ADD)

    outcome = _refused(mine)
    return spark.createDataFrame([(outcome, db.value(query(Nation).all().aggregate(n=count_all)))], "outcome string, n long")


# DDL and verification


class Wider(Table, name="nation"):
    n_nationkey: Int = column(key=True)
    n_name: str
    n_regionkey: Int
    note: str | None
    grade: Int = 5


def _altered(name: str, oracle: str, change: Callable[[Database], Any]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = _filled(spark, sf_dir, Nation)
        change(db)
        return db.store.read(spark, "nation")

    _query(name, oracle)(run)


_altered(
    "add_columns",
    "select *, cast(null as varchar) as note, 5 as grade from nation",
    lambda db: [ddl.add_column(db, Nation, Wider.field(c)) for c in ("note", "grade")],
)
_altered("drop_column", "select n_nationkey, n_regionkey from nation", lambda db: ddl.drop_column(db, Nation, "n_name"))
_altered(
    "rename_retype",
    "select cast(n_nationkey as bigint) as n_nationkey, n_name as title, n_regionkey from nation",
    lambda db: (ddl.rename_column(db, Nation, "n_name", "title"), ddl.retype_column(db, Nation, "n_nationkey", T.LongType())),
)
_altered("truncate_refill", f"{_REST} = 99 or n_nationkey < 0 union all select 99, 'ADD', 2", lambda db: (ddl.truncate(db, Nation), db.insert(_ADD)))
_altered(
    "drop_create",
    "select 99 as n_nationkey, 'ADD' as n_name, 2 as n_regionkey",
    lambda db: (ddl.drop(db, Nation), ddl.drop(db, Nation, if_exists=True), ddl.create(db, Nation), ddl.create(db, Nation, if_not_exists=True), db.insert(_ADD)),
)

@_query(
    "verify_presets",
    "select * from (values ('default', 'extra column', 1), ('default', 'missing column', 1), ('default', 'missing index', 1), ('minimal', 'missing "
    "column', 1), ('strict', 'extra column', 1), ('strict', 'index name mismatch', 1), ('strict', 'missing column', 1), ('strict', 'missing index', 1), "
    "('strict', 'type mismatch', 1)) t(preset, kind, n)",
)
def verify_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a column of the same type family, a renamed one, an index under another name and none where one should be."""

    class Own(Table, name="nation"):
        n_nationkey: Int = column(key=True)
        n_name: str
        n_regionkey: Int
        constraints = (index("n_regionkey"), index("n_name", "n_regionkey"))

    db = _filled(spark, sf_dir, Own)
    ddl.retype_column(db, Own, "n_regionkey", T.LongType())
    for name in ("idx_nation_n_regionkey", "idx_nation_n_name_n_regionkey"):
        ddl.drop_index(db, Own, name)
    ddl.create_index(db, Own, index("n_regionkey", name="another"))
    ddl.rename_column(db, Own, "n_name", "title")
    presets = {"default": ddl.DEFAULT, "minimal": ddl.MINIMAL, "strict": ddl.STRICT}
    rows = [(p, i.kind) for p, checks in presets.items() for i in ddl.differences(db, Own, checks)]
    return spark.createDataFrame(rows, "preset string, kind string").groupBy("preset", "kind").agg(F.count("*").cast("int").alias("n"))


@_query("verify_files", "select * from (values ('nation', 'fine'), ('nowhere', 'table not found')) t(name, outcome)")
def verify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations against plain files, which know columns and types alone."""

    class Nowhere(Table, name="nowhere"):
        a: int

    db = _database(spark, sf_dir)
    found = {t._name: [i.kind for i in ddl.differences(db, t)] for t in (Nation, Nowhere)}
    return spark.createDataFrame([(k, v[0] if v else "fine") for k, v in found.items()], "name string, outcome string")


# codecs


@dataclasses.dataclass
class Props:
    k: int


class Typed(Table, name="events"):
    event_id: int = column(key=True)
    props: Json[Props]


class Spoken(Table, name="region"):
    r_regionkey: Int
    r_name: Annotated[str, Codec("quiet", T.StringType(), decode=str.lower)]


_reads(
    "json_codec",
    "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where event_id < 50",
    "event_id long, k long",
    lambda db: [(e.event_id, e.props.k) for e in db.all(query(Typed).where(Typed.event_id < 50), Typed)],
)
_reads(
    "own_codec",
    "select r_regionkey, lower(r_name) as r_name from region",
    "r_regionkey int, r_name string",
    lambda db: [(r.r_regionkey, r.r_name) for r in db.all(query(Spoken).all(), Spoken)],
)

# raw SQL, errors and limits

_register(
    "raw_fragments",
    "select n_nationkey as \"a key\" from nation where n_name in ('CHINA', 'JAPAN') and n_regionkey > 1",
    lambda: sql("select {n.n_nationkey} as ", n=Nation) + ident("a key") + sql(" from {n} where ", n=Nation) + sql("{n.n_name} in ", n=Nation) + value_list(["CHINA", "JAPAN", "CHINA"]) + unsafe(" and n_regionkey > 1"),
)


@_query(
    "fragment_texts",
    "select * from (values ('issues', '1'), ('show', 'select * from nation as nation where nation.n_name = ''it''''s'''), ('text', 'select * from "
    "nation as nation where nation.n_name = ?'), ('values', 'it''s')) t(what, got)",
)
def fragment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f: Fragment = sql("select * from {n} where {n.n_name} = {x}", n=Nation, x="it's")
    bad = value_list([])
    return spark.createDataFrame([("text", f.text()), ("show", f.show()), ("values", f.values()[0]), ("issues", str(len(bad.issues)))], "what string, got string")


@_query(
    "error_kinds",
    "select * from (values ('data', 'DataFailure'), ('issue', 'InvalidStatement'), ('late', 'StatementTimeout'), ('late page', 'StatementTimeout'), "
    "('late stream', 'StatementTimeout'), ('schema', 'SchemaMismatch'), ('state 08', 'Retryable'), ('syntax', 'SyntaxFailure')) t(what, kind)",
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes wrong, by its type; time limits hold for pages and streams as well."""
    db, limited = _database(spark, sf_dir), Database(spark, Files(sf_dir), timeout=1, most_at_once=2)
    slow = query(Lineitem).where(exists(query(Orders).where(Orders.o_orderkey.satisfies(lambda o, line: F.expr("aggregate(sequence(1, 20000), 0L, (a, i) -> a + i * 3 % 7)") + o != line - 1, outer(Lineitem.l_orderkey)))))

    class Lost(Exception):
        state = "08006"

    tries = {
        "syntax": lambda: db.all(sql("selec 1")), "data": lambda: db.all(sql("select cast({x} as int)", x="no")), "issue": lambda: db.all(query(Nation).where(Nation.n_nationkey.in_([]))),
        "late": lambda: limited.all(slow), "late page": lambda: list(limited.pages(slow, Lineitem.l_orderkey, 5)), "late stream": lambda: list(limited.stream(slow)),
        "schema": lambda: ddl.verify(db, type(Table)("Odd", (Table,), {"__module__": __name__, "__annotations__": {"n_nationkey": str}}, name="nation")),
    }
    rows = [(k, _refused(t)) for k, t in tries.items()] + [("state 08", type(classify(Lost())).__name__)]
    return spark.createDataFrame(rows, "what string, kind string")


# event streams


@_query(
    "session_windows",
    """with gaps as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as fresh from events),
       numbered as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from gaps)
       select user_id, min(ts) as start, count(*) as n from numbered group by user_id, s""",
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(_database(spark, sf_dir).table(Events), "ts", "6 hours", ["user_id"]).select("user_id", "start", "n")


@_query(
    "sliding_windows",
    "with t as (select time_bucket(interval '12 hours', ts) as b from events) select start, count(*) as n from (select b as start from t union all "
    "select b - interval '12 hours' from t) group by start",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(_database(spark, sf_dir).table(Events), "ts", "1 day", [], slide="12 hours").select("start", "n")


# functions and joins of one's own


@F.pandas_udf(T.LongType())
def _doubled(x: pd.Series) -> pd.Series:
    return x * 2


@F.pandas_udf(T.LongType())
def _squares(x: pd.Series) -> int:
    return int((x * x).sum())


_register("user_function", "select n_name, n_nationkey * 2 as twice from nation", lambda: query(Nation).all().select(Nation.n_name, twice=lambda env: _doubled(Nation.n_nationkey.column(env).cast("long"))))
_register(
    "user_aggregate",
    "select n_regionkey, cast(sum(n_nationkey * n_nationkey) as bigint) as squares from nation group by n_regionkey",
    lambda: query(Nation).all().group_by(Nation.n_regionkey).agg(squares=Aggregate(lambda env: _squares(Nation.n_nationkey.column(env).cast("long")))),
)


def _as_of() -> Any:
    """Each event of a customer beside the last order before it: of the orders that an inequality admits the first by time."""
    nearest = over(lambda env: F.row_number(), [Events.event_id], [Orders.o_orderdate.desc(), Orders.o_orderkey.desc()])
    met = query(Events).left_join(Orders, (Events.user_id == Orders.o_custkey) & (Orders.o_orderdate <= Events.ts)).all()
    ranked = met.select(Events.event_id, Orders.o_orderkey, r=nearest).as_table("ranked")
    return query(ranked).where(ranked.r == 1).select(ranked.event_id, ranked.o_orderkey)


_register(
    "asof_join",
    """select event_id, o_orderkey from (
         select event_id, o_orderkey, row_number() over (partition by event_id order by o_orderdate desc nulls last, o_orderkey desc) as r
         from events left join orders on user_id = o_custkey and o_orderdate <= ts) where r = 1""",
    _as_of,
)
_register(
    "interval_join",
    "select event_id, o_orderkey from events join orders on user_id = o_custkey and o_orderdate between ts - interval '9000 days' and ts - interval '8970 days'",
    lambda: query(Events).join(
        Orders, (Events.user_id == Orders.o_custkey) & Orders.o_orderdate.satisfies(lambda o, t: o.between(t - F.expr("interval 9000 days"), t - F.expr("interval 8970 days")), Events.ts)
    ).all().select(Events.event_id, Orders.o_orderkey),
)
