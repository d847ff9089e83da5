"""Changes, constraints, transactions, DDL, verification, raw SQL, errors and limits."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import Database, Delete, Insert, Int, Store, Table, Update, Upsert, column, count_all, ddl, excluded, foreign_key, ident, index, query, sql, sum_of, unique, value_list
from tessera.errors import ConstraintViolation, DataFailure, InvalidStatement, MissingKey, Retryable, SchemaMismatch, StatementTimeout, SyntaxFailure, classify
from tessera.streaming.events import run_to_end, windowed_counts


class People(Table, name="people"):
    id: Int = column(key=True, generated=True)
    name: str
    age: Int | None = 18
    constraints = (unique("name"), index("age", unique=True, where=lambda t: t.name.like("VIP%")))


class Notes(Table, name="notes"):
    id: Int = column(key=True, generated=True)
    person: Int | None
    text: str | None
    constraints = (foreign_key("person", to=People, at="id", on_delete="cascade"),)


class Tags(Table, name="tags"):
    id: Int = column(key=True)
    person: Int | None
    constraints = (foreign_key("person", to=People, at="id", on_delete="set null", on_update="cascade"),)


class Locks(Table, name="locks"):
    name: str = column(key=True)
    node: str
    until: dt.datetime


class Keyless(Table, name="keyless"):
    a: Int


@pytest.fixture
def db(spark, tmp_path):
    out = Database(spark, Store(spark, f"file://{tmp_path}/store"), [People, Notes, Tags, Locks])
    for t in (People, Notes, Tags, Locks, Keyless):
        ddl.create(out, t)
    return out


def names(db):
    return sorted(r["name"] for r in db.all(query(People).all()))


def test_insert_update_delete(db):
    a, b = db.insert(People(name="Ann"), People(name="Bob", age=40))
    assert {a.id, b.id} == {1, 2} and a.age == 18
    assert db.execute(Insert(People).values(name="Cid")) == 1 and db.by_key(People, 3) == People(id=3, name="Cid", age=18)
    assert db.execute(Update(People).set(People.age, 50).where(People.age == 18)) == 2
    assert [r.age for r in db.returning(Update(People).set(People.age, F.col("age") + 1).where(People.name == "Ann"), People)] == [51]
    assert db.update(People(id=2, name="Bea", age=None)) == 1 and db.by_key(People, 2).name == "Bea"
    gone = db.returning(Delete(People).where(People.age.is_null()), People)
    assert [g.name for g in gone] == ["Bea"] and names(db) == ["Ann", "Cid"]
    assert db.execute(Delete(People).all()) == 2 and names(db) == []
    with pytest.raises(InvalidStatement):
        db.execute(Delete(People))
    with pytest.raises(MissingKey):
        db.delete(Keyless(a=1))


def test_constraints(db):
    db.insert(People(name="VIP a", age=1))
    for bad in (People(name=None), People(name="VIP a", age=9), People(name="VIP b", age=1), People(id=1, name="x")):
        with pytest.raises(ConstraintViolation):
            db.insert(bad)
    db.insert(People(name="c", age=1))
    with pytest.raises(ConstraintViolation):
        db.insert(Notes(person=77, text="orphan"))
    db.insert(Notes(person=1, text="n"), Notes(person=None, text="free"))
    db.insert(Tags(id=1, person=1), Tags(id=2, person=2))
    with pytest.raises(ConstraintViolation):
        db.execute(Update(People).set(People.id, 9).where(People.id == 1))  # notes take no action
    assert db.by_key(People, 1) is not None and db.by_key(Tags, 1).person == 1
    db.execute(Delete(People).where(People.id == 1))
    assert [r["text"] for r in db.all(query(Notes).all())] == ["free"] and db.by_key(Tags, 1).person is None
    db.execute(Update(People).set(People.id, 9).where(People.id == 2))
    assert db.by_key(Tags, 2).person == 9


def test_upsert(db):
    now = dt.datetime(2024, 1, 1)
    lock = lambda node, hours: Locks(name="l", node=node, until=now + dt.timedelta(hours=hours))
    up = lambda row: Upsert.of(row).on_conflict(Locks.name)
    assert db.execute(up(lock("n1", 1)).update_all()) == 1
    expired = lambda u: u.update_all().where((Locks.until < now).or_(Locks.node == excluded(Locks.node)))
    assert db.execute(expired(up(lock("n2", 2)))) == 0 and db.by_key(Locks, "l").node == "n1"
    assert [r.until.hour for r in db.returning(expired(up(lock("n1", 3))), Locks)] == [3]
    assert db.execute(up(lock("n3", 4)).do_nothing()) == 0
    with pytest.raises(ConstraintViolation):
        db.execute(Upsert.of(lock("a", 1), lock("b", 1)).on_conflict(Locks.name).update_all())
    assert db.by_key(Locks, "l").node == "n1"


def test_transactions_and_conflicts(db, spark):
    with pytest.raises(SyntaxFailure):
        with db.transaction():
            db.insert(People(name="x"))
            assert names(db) == ["x"]
            db.all(sql("selec 1"))
    assert names(db) == []
    with db.transaction():
        db.insert(People(name="x"))
        db.insert(Notes(person=1, text="t"))
    assert names(db) == ["x"]
    other = Database(spark, Store(spark, db.store.folder.root), [People])
    with pytest.raises(Retryable):
        with db.transaction():
            db.insert(People(name="mine"))
            other.insert(People(name="theirs"))
    assert names(db) == ["theirs", "x"]
    before = db.store.folder.names("people")
    db.store.vacuum("people")  # all too young
    assert db.store.folder.names("people") == before
    db.store.vacuum("people", older=0)
    assert len(db.store.folder.names("people")) < len(before) and names(db) == ["theirs", "x"]


def test_a_transaction_without_a_verdict(db, spark, monkeypatch):
    """A writer that dies between its manifests and its verdict changes nothing; others wait for it, and take it back when it is old."""
    put = type(db.store.folder).put_new

    def dies(self, name, text):
        if name.startswith("_transactions/"):
            raise KeyboardInterrupt
        return put(self, name, text)

    monkeypatch.setattr(type(db.store.folder), "put_new", dies)
    with pytest.raises(KeyboardInterrupt), db.transaction():
        db.insert(People(name="x"))
        db.insert(Notes(person=1, text="t"))
    monkeypatch.undo()
    other = Database(spark, Store(spark, db.store.folder.root), [People, Notes])
    assert names(other) == [] and other.all(query(Notes).all()) == []
    with pytest.raises(Retryable):
        other.insert(People(name="y"))
    late = Database(spark, Store(spark, db.store.folder.root, patience=0), [People, Notes])
    late.insert(People(name="y"))
    assert names(late) == names(other) == ["y"] and other.all(query(Notes).all()) == []


def test_numbers_of_queries_and_raw_statements(db, spark):
    class Source(Table, name="source"):
        name: str

    frame = spark.range(0, 40, numPartitions=4).select(F.concat(F.lit("n"), "id").alias("name"))
    ddl.create(db, Source)
    db.execute(Insert(Source).from_query(type("Q", (), {"lower": lambda self, db, around: frame})()))
    assert db.execute(Insert(People).from_query(query(Source).all())) == 40
    assert sorted(r["id"] for r in db.all(query(People).all())) == list(range(1, 41))
    assert db.execute(sql("update {p} set age = age + {n}, name = concat({p.name}, ' (a, b)') where {p.id} <= 3 and name <> 'x, where y'", p=People, n=1)) == 3
    assert db.by_key(People, 2).age == 19 and db.by_key(People, 2).name.endswith(" (a, b)")
    assert [r["id"] for r in db.returning(sql("delete from people where id > {n}", n=38))] in ([39, 40], [40, 39])
    for bad, kind in ((sql("update people set nothing = 1"), SyntaxFailure), (sql("insert into people (name) values ('a', 'b')"), SyntaxFailure), (sql("select 1"), InvalidStatement), (sql("insert into people (id, name) values (1, 'again')"), ConstraintViolation), (sql("delete from nowhere"), SyntaxFailure)):
        with pytest.raises(kind):
            db.execute(bad)


def test_unique_indexes_made_later(db):
    db.insert(People(name="a", age=1), People(name="b", age=1), People(name="VIP", age=7))
    with pytest.raises(ConstraintViolation):
        ddl.create_index(db, People, index("age", name="ages", unique=True))
    ddl.create_index(db, People, index("age", name="olds", unique=True, where=lambda t: t.age > 5))
    db.insert(People(name="c", age=1))
    with pytest.raises(ConstraintViolation):
        db.insert(People(name="d", age=7))
    assert {i["name"]: i["where"] for i in db.store.need("people").rules["indexes"]}["olds"] == "(age > 5)"
    ddl.drop_index(db, People, "olds")
    db.insert(People(name="d", age=7))


def test_ddl_and_verification(db):
    db.insert(People(name="a"))
    ddl.verify(db, People)
    ddl.verify(db, People, ddl.STRICT)
    ddl.rename_column(db, People, "age", "years")
    ddl.retype_column(db, People, "name", T.BinaryType())
    with pytest.raises(SchemaMismatch) as e:
        ddl.verify(db, People, ddl.STRICT)
    assert {i.kind for i in e.value.issues} == {"missing column", "type mismatch", "extra column"}
    ddl.verify(db, Tags, ddl.MINIMAL)
    with pytest.raises(SyntaxFailure):
        ddl.create(db, People)
    ddl.create(db, People, if_not_exists=True)
    ddl.drop(db, People)
    assert [i.kind for i in ddl.differences(db, People)] == ["table not found"]
    ddl.create(db, People)
    ddl.truncate(db, People)
    ddl.drop_index(db, People, "idx_people_age")
    assert "missing index" in {i.kind for i in ddl.differences(db, People)}
    ddl.create_index(db, People, index("age", unique=True))
    assert "missing index" in {i.kind for i in ddl.differences(db, People)}  # it is a partial one that is declared
    ddl.drop_index(db, People, "idx_people_age")
    ddl.create_index(db, People, People.constraints[1])
    ddl.verify(db, People)


def test_raw_sql(db):
    db.insert(People(name="a'b", age=1), People(name="c", age=2))
    q = sql("select {p.name} from {p} where {p.name} in ", p=People) + value_list(["a'b", "a'b", "zz"])
    assert [r[0] for r in db.all(q)] == ["a'b"] and q.values() == ["a'b", "zz"]
    assert q.show().endswith("in ('a''b', 'zz')") and q.text().endswith("(?, ?)")
    assert db.value(sql("select count(*) from {p} where name = {x}", p=People, x="' or '1'='1")) == 0
    assert db.value(sql("select {n} as ", n=Decimal("1.50")) + ident("odd`name")) == Decimal("1.50")
    with pytest.raises(InvalidStatement):
        db.all(sql("select 1 where 1 in ") + value_list([]))


def test_errors_and_limits(db, spark):
    with pytest.raises(SyntaxFailure):
        db.all(sql("select * from nowhere_at_all"))
    with pytest.raises(DataFailure):
        db.all(sql("select cast({x} as int)", x="no"))

    class Lost(Exception):
        def getSqlState(self):
            return "08006"

    assert isinstance(classify(Lost()), Retryable)
    tries = []

    def twice():
        tries.append(1)
        if len(tries) < 2:
            raise Lost()
        return "ok"

    assert db.retrying(twice, wait=0.01) == "ok"
    slow = sql("select sum(a.id * b.id) from range(4000000) a join range(4000000) b on a.id % 7 < b.id % 5")
    with pytest.raises(StatementTimeout), db.within(1):
        db.all(slow)


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, i), "a" if i % 2 else "b") for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string")
    df.write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counts = windowed_counts(live.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "5 minutes", ["kind"], late="1 minute")
    run_to_end(counts, f"{tmp_path}/out", f"{tmp_path}/cp")
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("kind", "n").collect()} == {("a", 2), ("b", 3)}
