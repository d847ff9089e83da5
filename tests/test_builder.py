"""Predicates, groups, joins, subqueries, sorting and paging against small hand-computed fixtures."""

import datetime as dt
from decimal import Decimal
from typing import Annotated

import pytest

from tessera import Database, Dec, Files, Frames, Int, Json, Table, avg_of, column, count_all, exists, items, max_of, min_of, outer, query, raw, scalar, sum_of
from tessera.errors import DataFailure, InvalidStatement
from tessera.functions.text import similar_to_regex


class Users(Table, name="users"):
    id: Int = column(key=True)
    name: str
    age: Int | None
    mail: str | None = column(label="email")


class Orders(Table, name="prd.orders"):
    id: Int = column(key=True)
    user_id: Int | None = column(label="userId")
    amount: Annotated[Decimal, Dec(12, 2)]
    status: str


class Docs(Table, name="docs"):
    id: Int = column(key=True)
    data: Json[dict] | None


USERS = [(1, "Alice", 30, "alice@example.com"), (2, "Bob", 25, "bob@example.com"), (3, "Charlie", None, "charlie@example.com"), (4, "Diana", 28, None)]
ORDERS = [(1, 1, Decimal("100.50"), "paid"), (2, 1, Decimal("20.25"), "open"), (3, 2, Decimal("7.00"), "paid"), (4, None, Decimal("1.00"), "open")]
DOCS = [(1, '{"email":"a","verified":true,"role":"admin","tags":["x","y"],"o":{"v":1}}'), (2, '{"email":"b","verified":false,"role":"user","a.b":null}'), (3, '{"it\'s":1,"tags":["y"]}'), (4, None), (5, "not json")]


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark, Frames({"users": spark.createDataFrame(USERS, Users.spark_schema()), "prd.orders": spark.createDataFrame(ORDERS, Orders.spark_schema()), "docs": spark.createDataFrame(DOCS, Docs.spark_schema())}))


def ids(db, q):
    return sorted(r["id"] for r in db.all(q))


@pytest.mark.parametrize(
    "predicate, want",
    [
        (Users.name == "Alice", [1]), (Users.name != "Alice", [2, 3, 4]), (Users.age < 28, [2]), (Users.age <= 28, [2, 4]), (Users.age > 28, [1]), (Users.age >= 28, [1, 4]),
        (Users.age == None, []), (Users.age != None, []), (Users.age.is_null(), [3]), (Users.mail.is_not_null(), [1, 2, 3]),  # noqa: E711
        (Users.name.like("%li%"), [1, 3]), (Users.name.ilike("a%"), [1]), (Users.name.similar_to("(Al|Bo)%"), [1, 2]), (Users.name.matches("[ae]$"), [1, 3, 4]), (Users.name.imatches("^ALICE$"), [1]),
        (Users.id.in_([2, 4, 2]), [2, 4]), (Users.id.not_in([2, 4]), [1, 3]), (Users.age.between(25, 28), [2, 4]), (Users.name.not_like("A%"), [2, 3, 4]),
        ((Users.id == 1).or_(Users.id == 2).and_(Users.age > 28), [1]), ((Users.id == 1) | ((Users.id == 2) & (Users.age > 28)), [1]), (~(Users.id == 1), [2, 3, 4]),
        (raw("age > :x and name <> ':x'", x=26), [1, 4]), (raw("name = :n", n="' or 1=1 --"), []), (raw("name = :n", n="a\\' or 1=1 --"), []),
    ],
)
def test_predicates(db, predicate, want):
    assert ids(db, query(Users).where(predicate)) == want


def test_similar_to():
    assert similar_to_regex("a%b_[c%]\\%.") == r"^(?s:a.*b.[c%]%\.)$"


def test_empty_lists_are_issues_everywhere(db):
    bad = query(Users).where(Users.id.in_([])).where(Users.name.not_in([]))
    with pytest.raises(InvalidStatement) as e:
        db.all(bad)
    assert len(e.value.issues) == 2
    inner = query(Orders).where(Orders.id.in_([])).select(Orders.user_id)
    for q in (query(Users).where(Users.id.in_query(inner)), query(Users).where(exists(inner)), query(query(Users).where(Users.id.in_([])).as_table("t")).all(), query(Users).where(Users.id.in_([])).aggregate(n=count_all)):
        with pytest.raises(InvalidStatement):
            db.all(q)


def test_joins_and_null_sides(db):
    q = query(Users).left_join(Orders, Users.id == Orders.user_id)
    rows = db.all(q.all())
    assert len(rows) == 5 and set(rows[0].asDict()) == {"users_ref_1__id", "name", "age", "email", "orders_ref_1__id", "userId", "amount", "status"}
    assert db.value(q.where(Orders.id.is_null()).aggregate(n=count_all)) == 2
    assert len(db.all(query(Users).full_join(Orders, Users.id == Orders.user_id).all())) == 6
    assert len(db.all(query(Users).right_join(Orders, (Users.id == Orders.user_id) & (Users.age > 26)).all())) == 4
    a, b = Users.as_("a"), Users.as_("b")
    assert len(db.all(query(a).join(b, a.age < b.age).all())) == 3
    with pytest.raises(ValueError, match="more than once"):
        db.all(query(Users).join(Users, Users.id == Users.id).all())


def test_derived_table_lives_through_many_joins(db):
    paid = query(Orders).where(Orders.status == "paid").select(Orders.user_id, Orders.amount).as_table("paid")
    q = query(paid).join(Users, paid.userId == Users.id).join(Orders, Orders.user_id == Users.id).all()
    assert len(db.all(q)) == 3
    assert db.value(query(paid).all().aggregate(s=sum_of(paid.amount))) == Decimal("107.50")


def test_subqueries(db):
    assert ids(db, query(Users).where(Users.id.in_query(query(Orders).where(Orders.status == "paid").select(Orders.user_id)))) == [1, 2]
    everyone = query(Orders).all().select(Orders.user_id)
    assert ids(db, query(Users).where(Users.id.not_in_query(everyone))) == []  # a null among them
    assert ids(db, query(Users).where(~exists(query(Orders).where(Orders.user_id == outer(Users.id))))) == [3, 4]
    with pytest.raises(TypeError):
        Users.name.in_query(everyone)
    with pytest.raises(TypeError):
        Users.id.in_query(query(Orders).all())


def test_sort_limit_offset(db):
    names = lambda q: [r["name"] for r in db.all(q)]
    assert names(query(Users).order_by(Users.age).all()) == ["Bob", "Diana", "Alice", "Charlie"]
    assert names(query(Users).order_by(Users.age.desc()).all()) == ["Charlie", "Alice", "Diana", "Bob"]
    assert names(query(Users).order_by(Users.age.asc(nulls_first=True)).limit(1)) == ["Charlie"]
    assert names(query(Users).order_by(Users.id).limit(2).offset(1)) == names(query(Users).order_by(Users.id).offset(1).limit(2)) == ["Bob", "Charlie"]
    assert names(query(Users).seek_after(Users.id, 2).limit(5)) == ["Charlie", "Diana"]
    assert names(query(Users).seek_before(Users.id, 3).limit(5)) == ["Bob", "Alice"]


def test_distinct_keeps_its_sorts(db):
    ages = lambda q: [r["age"] for r in db.all(q.select(Users.age).distinct())]
    assert ages(query(Users).order_by(Users.age).all()) == [25, 28, 30, None] and ages(query(Users).order_by(Users.age.desc(nulls_first=False)).all()) == [30, 28, 25, None]
    assert ages(query(Users).seek_before(Users.age, 30).limit(5)) == [28, 25]
    named = query(Users).order_by(Users.age.asc(nulls_first=True)).all().select(years=Users.age).distinct()
    assert [r["years"] for r in db.all(named)] == [None, 25, 28, 30]
    with pytest.raises(InvalidStatement):
        db.all(query(Users).order_by(Users.name).all().select(Users.age).distinct())
    joined = query(Users).join(Orders, Users.id == Orders.user_id).order_by(Orders.id.desc()).all().distinct()
    assert [r["orders_ref_1__id"] for r in db.all(joined)] == [3, 2, 1]


def test_sets_scalars_and_totals(db):
    a, b = query(Users).where(Users.id < 3).select(Users.id), query(Users).where(Users.id > 1).select(Users.id)
    assert ids(db, a.union(b)) == [1, 2, 3, 4] and ids(db, a.union_all(b)) == [1, 2, 2, 3, 4] and ids(db, a.intersect(b)) == [2] and ids(db, a.except_(b)) == [1]
    both = a.union(b).as_table("u")
    assert ids(db, query(both).where(both.id > 2)) == [3, 4] and ids(db, query(Users).where(Users.id.in_query(a.intersect(b)))) == [2]
    with pytest.raises(InvalidStatement):
        db.all(a.union(query(Users).all()))
    with pytest.raises(InvalidStatement):
        db.all(a.union(query(Users).where(Users.id.in_([])).select(Users.id)))
    assert ids(db, query(Users).where(Users.age == scalar(query(Users).all().aggregate(v=max_of(Users.age))))) == [1]
    totals = db.all(query(Orders).all().group_by(Orders.status).rollup().agg(n=count_all))
    assert {tuple(r) for r in totals} == {("paid", 2), ("open", 2), (None, 4)}


def test_limits_hold_for_pages_and_streams(spark):
    """A stream takes up its permit until it ends or is closed; faults come out typed."""
    import threading

    own = Database(spark, Frames({"users": spark.createDataFrame([(i, f"u{i}", i, None) for i in range(9)], Users.spark_schema())}), most_at_once=1)
    rows = own.stream(query(Users).all())
    next(rows)
    got = []
    other = threading.Thread(target=lambda: got.extend(own.all(query(Users).all())))
    other.start()
    other.join(1.5)
    assert not got
    rows.close()
    other.join(30)
    assert len(got) == 9
    broken = query(Users).where(raw("cast(name as int) > 0"))
    for pull in (lambda: list(own.stream(broken)), lambda: list(own.pages(broken, Users.id, 2))):
        with pytest.raises(DataFailure):
            pull()


def test_builders_are_not_ready(db):
    for q in (query(Users), query(Users).order_by(Users.id), query(Users).offset(1), query(Users).join(Orders, Users.id == Orders.user_id)):
        with pytest.raises(TypeError):
            db.all(q)
    with pytest.raises(ValueError):
        Users.as_("a b")
    with pytest.raises(AttributeError):
        Users.nothing


def test_aggregates(db):
    q = query(Orders).where(Orders.status == "paid")
    assert tuple(db.one(q.aggregate(a=max_of(Orders.amount), b=min_of(Orders.amount), n=count_all))) == (Decimal("100.50"), Decimal("7.00"), 2)
    empty = query(Orders).where(Orders.status == "none")
    assert db.value(empty.aggregate(v=sum_of(Orders.amount))) is None
    assert db.value(empty.aggregate(v=max_of(Orders.id).or_else(0))) == 0
    assert float(db.value(query(Users).all().aggregate(v=avg_of(Users.age)))) == pytest.approx(83 / 3)
    with pytest.raises(InvalidStatement):
        db.all(q.limit(1).aggregate(n=count_all))
    groups = query(Orders).all().group_by(Orders.status).agg(n=count_all).having(lambda df: df["n"] > 1)
    assert sorted(map(tuple, db.all(groups))) == [("open", 2), ("paid", 2)]


@pytest.mark.parametrize(
    "predicate, want",
    [
        (Docs.data.json_contains({"verified": True}), [1]), (Docs.data.json_contains({"o": {"v": 1}, "tags": ["y"]}), [1]), (Docs.data.json_contains({"tags": ["y"]}), [1, 3]), (Docs.data.json_contains({"a.b": None}), [2]),
        (Docs.data.json_contains({"role": True}), []), (Docs.data.json_has("a.b"), [2]), (Docs.data.json_has("it's"), [3]), (Docs.data.json_has_any("tags", "role"), [1, 2, 3]), (Docs.data.json_has_all("verified", "role"), [1, 2]),
        (Docs.data.json("role") == "admin", [1]), (Docs.data.json("role").like("%e%"), [2]), (Docs.data.json("role").is_null(), [3, 4, 5]),
    ],
)
def test_json(db, predicate, want):
    assert ids(db, query(Docs).where(predicate)) == want


def test_results(db):
    assert db.one(query(Users).order_by(Users.id).all(), Users) == Users(id=1, name="Alice", age=30, mail="alice@example.com")
    assert db.one(query(Users).where(Users.id == 9)) is None and db.by_key(Users, 3, ).name == "Charlie"
    assert db.tuples(query(Users).where(Users.id == 1).select(Users.id, Users.name), 2) == [(1, "Alice")]
    with db.stream(query(Users).order_by(Users.id).all(), Users) as rows:
        assert [next(rows).name, next(rows).name] == ["Alice", "Bob"]
    assert list(rows) == []


def test_pages(spark):
    rows = [(i, f"u{i}", i, None) for i in range(1, 11)]
    own = Database(spark, Frames({"users": spark.createDataFrame(rows, Users.spark_schema())}))
    sizes = lambda **kw: [len(p.items) for p in own.pages(query(Users).all(), Users.id, **kw)]
    assert sizes(size=3) == [3, 3, 3, 1] and sizes(size=5) == [5, 5] and sizes(size=3, after=7) == [3]
    seen = []
    assert len(list(items(own.pages(query(Users).limit(1), Users.id, 4), seen.append))) == 10 and seen == [4, 8, 10]
    with pytest.raises(InvalidStatement):
        list(own.pages(query(Users).all().offset(1), Users.id, 3))


def test_types_round_trip(spark):
    import uuid

    class Kinds(Table, name="kinds"):
        u: uuid.UUID
        t: dt.time
        d: Json[list]

    row = Kinds(u=uuid.UUID(int=5), t=dt.time(1, 2, 3, 4), d=[1, {"a": "é"}])
    own = Database(spark, Frames({"kinds": spark.createDataFrame([tuple(row.stored().values())], Kinds.spark_schema())}))
    assert own.one(query(Kinds).where(Kinds.u == uuid.UUID(int=5)), Kinds) == row


def _plan(db, q):
    return db.df(q)._jdf.queryExecution().executedPlan().toString()


EARLIER = exists(query(Orders).where(Orders.user_id < outer(Users.id)))
KEPT = query(Orders).where(Orders.amount > 1).as_table("kept")


@pytest.mark.parametrize(
    "predicate, want",
    [
        (EARLIER, [2, 3, 4]), (~EARLIER, [1]), (EARLIER | (Users.id == 1), [1, 2, 3, 4]), (~exists(query(Orders).where(Orders.id < outer(Users.age))), [3]),
        (exists(query(Orders).where((Orders.user_id == outer(Users.id)) | (Orders.id > outer(Users.id)))), [1, 2, 3]),
        (exists(query(Orders).join(Docs, Orders.id == Docs.id).where(Orders.user_id < outer(Users.id))), [2, 3, 4]), (exists(query(KEPT).where(KEPT.userId < outer(Users.id))), [2, 3, 4]),
        (exists(query(Orders).where((Orders.user_id < outer(Users.id)) & exists(query(Docs).where(Docs.id > outer(Orders.id))))), [2, 3, 4]),
    ],
)
def test_exists_without_an_equality_gathers_nothing_in_the_driver(db, predicate, want):
    q = query(Users).where(predicate)
    assert ids(db, q) == want
    assert "NestedLoop" not in _plan(db, q) and "_tessera_shard" in _plan(db, q)


def test_rows_that_are_alike_stay_through_exists(spark):
    twice = Database(spark, Frames({"users": spark.createDataFrame(USERS * 2, Users.spark_schema()), "prd.orders": spark.createDataFrame(ORDERS * 3, Orders.spark_schema())}))
    assert ids(twice, query(Users).where(EARLIER)) == [2, 2, 3, 3, 4, 4]


def test_exists_with_an_equality_or_a_small_table_is_left_to_spark(db, spark, tmp_path):
    assert "_tessera_shard" not in _plan(db, query(Users).where(exists(query(Orders).where(Orders.user_id == outer(Users.id)).where(Orders.id > outer(Users.id)))))
    for name in ("users", "prd.orders"):
        db.source.read(spark, name).write.parquet(f"{tmp_path}/{name.rsplit('.', 1)[-1]}.parquet")
    small = Database(spark, Files(str(tmp_path)))
    assert "_tessera_shard" not in _plan(small, query(Users).where(EARLIER)) and ids(small, query(Users).where(EARLIER)) == [2, 3, 4]
