"""Insert, update, delete and upsert over the table store, with returned rows and constraints.

A change rewrites only the files that hold rows it touches. Rows it returns are read from the version it replaced, which stays as it was.
"""

from __future__ import annotations

import dataclasses
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, InvalidStatement, MissingKey
from ..plans.expr import Operand, Predicate, Ref
from ..plans.schema import MISSING, ForeignKey, Index, Table, Unique
from ..sources.store import Version


class _Env:
    """Fields of one table as columns of a frame, and as those of an incoming row."""

    def __init__(self, db: Any, old: str = "", new: str = ""):
        self.db, self.old, self.new = db, old, new

    def __call__(self, source: Any, label: str) -> Column:
        return F.col(f"`{self.old}{label}`")

    def incoming(self, label: str) -> Column:
        return F.col(f"`{self.new}{label}`")

    def subquery(self, query: Any) -> DataFrame:
        return query.lower(self.db, None)

    def literal(self, value: Any) -> str:
        return self.db.literal(value)


class Excluded(Operand):
    """A field of the row that an upsert brings."""

    def __init__(self, ref: Ref):
        self.ref, self.dtype = ref, ref.dtype

    def column(self, env: _Env) -> Column:
        return env.incoming(self.ref.label)


def excluded(ref: Ref) -> Excluded:
    return Excluded(ref)


def _issues(predicate: Predicate | None) -> None:
    if predicate is not None and predicate.issues:
        raise InvalidStatement(list(predicate.issues))


@dataclasses.dataclass(frozen=True, eq=False)
class Insert:
    """Rows of a table: ``Insert(Users).values(name="Ann")``, several calls for several rows, or ``from_rows`` / ``from_query``."""

    table: type[Table]
    rows: tuple[dict[str, Any], ...] = ()
    query: Any = None

    def values(self, **values: Any) -> Insert:
        if not values:
            raise ValueError("an insert needs a value")
        for name in values:
            self.table.field(name)
        return dataclasses.replace(self, rows=self.rows + (values,))

    def from_rows(self, *rows: Table) -> Insert:
        return dataclasses.replace(self, rows=self.rows + tuple({f.name: getattr(r, f.name) for f in self.table._fields.values() if not (f.generated and getattr(r, f.name) is None)} for r in rows))

    def from_query(self, query: Any) -> Insert:
        return dataclasses.replace(self, query=query)

    def run(self, db: Any) -> DataFrame:
        v = db.store.need(self.table._name)
        files = _incoming(db, self.table, v, self.rows, self.query)
        new = db.store.frame(v, files)
        check_rows(db, self.table, new, db.store.frame(v))
        db.store.publish(self.table._name, v.schema, v.files + files, v.rules)
        return new


def _incoming(db: Any, table: type[Table], v: Version, rows: tuple[dict[str, Any], ...], query: Any) -> list[str]:
    """New files of the rows with stored values, defaults and generated numbers.

    Numbers go on from the largest there is. A row's place among the new ones is its place in its file after the rows of the files before,
    so numbers have no gaps but for rows that bring their own.
    """
    fields, name = list(table._fields.values()), table._name
    if query is not None:
        df = query.lower(db, None)
        have = {c.lower() for c in df.columns}
        df = df.select(*[(F.col(f"`{f.label}`") if f.label.lower() in have else _default(f)).cast(f.codec.stored).alias(f.label) for f in fields])
    else:
        made = []
        for r in rows:
            out = []
            for f in fields:
                value = r[f.name] if f.name in r else None if f.default is MISSING else f.default
                out.append(f.codec.put(value))
            made.append(tuple(out))
        nullable = type(v.schema)([type(x)(x.name, x.dataType, True) for x in table.spark_schema()])
        df = db.spark.createDataFrame(made, nullable).coalesce(1)
    generated = [f for f in fields if f.generated]
    files = db.store.write(name, df, v.schema)
    if not generated or not files:
        return files
    last = db.store.frame(v).agg(*[F.max(f"`{f.label}`").alias(f.label) for f in generated]).first()
    staged = db.store.frame(v, files).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = sorted(tuple(r) for r in staged.groupBy("_file").count().collect())  # a row per file
    before = [(n, sum(c for _, c in counts[:i])) for i, (n, _) in enumerate(counts)]
    if len(before) == 1:  # rows from the driver keep their order
        placed = staged.withColumn("_before", F.lit(0))
    else:
        placed = staged.join(db.spark.createDataFrame(before, "_file string, _before long"), "_file")
    for f in generated:
        number = F.col("_before") + F.col("_row") + (last[f.label] or 0) + 1
        placed = placed.withColumn(f.label, F.coalesce(F.col(f"`{f.label}`"), number.cast(f.codec.stored)))
    return db.store.write(name, placed, v.schema)


def _default(f: Any) -> Column:
    return F.lit(None if f.default is MISSING else f.codec.put(f.default))


def _steady(rows: DataFrame) -> DataFrame:
    """The rows a change is about, which it must find again whenever it asks for them."""
    if not rows._jdf.queryExecution().analyzed().deterministic():
        raise InvalidStatement(["a change's condition gives a row the same answer each time; random values don't"])
    return rows


class _Filtered:
    """Statements that must say which rows they mean: by ``where`` (all conditions hold) or by ``all()``."""

    def where(self, predicate: Predicate) -> Any:
        return dataclasses.replace(self, condition=predicate if self.condition is None else self.condition & predicate)

    def all(self) -> Any:
        return dataclasses.replace(self, everything=True)

    def _predicate(self, db: Any) -> Column:
        if self.condition is None and not self.everything:
            raise InvalidStatement(["say where(...) or all()"])
        _issues(self.condition)
        return F.lit(True) if self.condition is None else F.coalesce(self.condition.build(_Env(db)), F.lit(False))


@dataclasses.dataclass(frozen=True, eq=False)
class Update(_Filtered):
    table: type[Table]
    sets: tuple[tuple[str, Any], ...] = ()
    condition: Predicate | None = None
    everything: bool = False

    def set(self, ref: Ref, value: Any) -> Update:
        return dataclasses.replace(self, sets=self.sets + ((ref.field.name, value),))

    @classmethod
    def row(cls, row: Table) -> Update:
        """All fields but the key, of the row with the key."""
        table = type(row)
        out = cls(table)
        for f in table._fields.values():
            if not f.key:
                out = out.set(Ref(table._self, f), getattr(row, f.name))
        return out.where(by_key(row))

    def run(self, db: Any) -> DataFrame:
        if not self.sets:
            raise InvalidStatement(["an update sets at least one field"])
        v = db.store.need(self.table._name)
        hit = self._predicate(db)
        old = _steady(db.store.frame(v).where(hit))
        touched = db.store.touched(v, old)
        env = _Env(db)
        new = {}
        for name, value in self.sets:
            f = self.table.field(name)
            new[f.label] = value.column(env) if isinstance(value, Operand) else value if isinstance(value, Column) else F.lit(f.codec.put(value))
        changed = [(F.when(hit, new[f.name]).otherwise(F.col(f"`{f.name}`")) if f.name in new else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in v.schema]
        after = old.select(*[(new[f.name] if f.name in new else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in v.schema])
        if not touched:
            return after
        check_rows(db, self.table, after, db.store.frame(v).where(~hit))
        files = db.store.write(self.table._name, db.store.frame(v, touched).select(*changed), v.schema)
        db.store.publish(self.table._name, v.schema, [f for f in v.files if f not in touched] + files, v.rules)
        moved = [f.label for f in self.table._fields.values() if f.label in new]
        pairs = old.select(*[F.col(f"`{f.name}`").alias(f"old_{f.name}") for f in v.schema], *[(new[f.name] if f.name in new else F.col(f"`{f.name}`")).cast(f.dataType).alias(f"new_{f.name}") for f in v.schema])
        follow(db, self.table, pairs, moved)
        return after


@dataclasses.dataclass(frozen=True, eq=False)
class Delete(_Filtered):
    table: type[Table]
    condition: Predicate | None = None
    everything: bool = False

    @classmethod
    def row(cls, row: Table) -> Delete:
        return cls(type(row)).where(by_key(row))

    def run(self, db: Any) -> DataFrame:
        v = db.store.need(self.table._name)
        hit = self._predicate(db)
        gone = _steady(db.store.frame(v).where(hit))
        touched = db.store.touched(v, gone)
        if touched:
            files = db.store.write(self.table._name, db.store.frame(v, touched).where(~hit), v.schema)
            db.store.publish(self.table._name, v.schema, [f for f in v.files if f not in touched] + files, v.rules)
            follow(db, self.table, gone.select(*[F.col(f"`{f.name}`").alias(f"old_{f.name}") for f in v.schema]), None)
        return gone


def by_key(row: Table) -> Predicate:
    table = type(row)
    if not table.keys():
        raise MissingKey(f"{table.__name__} has no key")
    return reduce(lambda a, b: a & b, [Ref(table._self, f) == getattr(row, f.name) for f in table.keys()])


@dataclasses.dataclass(frozen=True, eq=False)
class Upsert:
    """Rows that replace those with which they conflict: ``Upsert(Locks, rows).on_conflict(Locks.id).update_all().where(...)``."""

    table: type[Table]
    rows: tuple[Table, ...]
    keys: tuple[str, ...] = ()
    replace: bool | None = None
    condition: Predicate | None = None
    query: Any = None

    @classmethod
    def of(cls, *rows: Table) -> Upsert:
        return cls(type(rows[0]), rows)

    @classmethod
    def from_query(cls, table: type[Table], query: Any) -> Upsert:
        return cls(table, (), query=query)

    def on_conflict(self, *refs: Ref) -> Upsert:
        return dataclasses.replace(self, keys=self.keys + tuple(r.label for r in refs))

    def update_all(self) -> Upsert:
        """A conflict sets all fields but the key and generated ones."""
        return dataclasses.replace(self, replace=True)

    def do_nothing(self) -> Upsert:
        return dataclasses.replace(self, replace=False)

    def where(self, condition: Predicate) -> Upsert:
        """Only where this holds for the row that is there; ``excluded`` names the incoming one."""
        return dataclasses.replace(self, condition=condition if self.condition is None else self.condition & condition)

    def run(self, db: Any) -> DataFrame:
        if not self.keys or self.replace is None:
            raise InvalidStatement(["an upsert says on_conflict(...) and update_all() or do_nothing()"])
        _issues(self.condition)
        v, name = db.store.need(self.table._name), self.table._name
        raw = tuple({f.name: getattr(r, f.name) for f in self.table._fields.values()} for r in self.rows)
        arrived = db.store.frame(v, _incoming(db, self.table, v, raw, self.query))
        keys = [F.col(f"`{k}`") for k in self.keys]
        twice = arrived.where(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])).groupBy(*keys).count().where("count > 1")
        if not twice.isEmpty():
            raise ConstraintViolation("two incoming rows have one conflict key", state="21000")
        there, new = db.store.frame(v), arrived.select(*[F.col(f"`{f.name}`").alias(f"_new_{f.name}") for f in v.schema])
        same = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`_new_{k}`") for k in self.keys])
        fresh = arrived.join(there.select(*keys), list(self.keys), "left_anti").select(*[F.col(f"`{f.name}`") for f in v.schema])
        hit = F.lit(True) if self.condition is None else F.coalesce(self.condition.build(_Env(db, new="_new_")), F.lit(False))
        fixed = {f.label for f in self.table._fields.values() if f.key or f.generated} | set(self.keys)
        kept = {f.name: F.col(f"`{f.name}`") for f in v.schema}
        result = {c: kept[c] if c in fixed else F.col(f"`_new_{c}`") for c in kept}
        touched, changed = [], None
        if self.replace:
            met = there.join(new, same).where(hit)
            touched = db.store.touched(v, there.join(new, same, "left_semi"))
            changed = met.select(*[result[c].alias(c) for c in kept])
        out = fresh if changed is None else fresh.unionByName(changed)
        check_rows(db, self.table, out, there.join(arrived.select(*keys), list(self.keys), "left_anti"))
        files = db.store.write(name, fresh, v.schema)
        if touched:
            match = F.col(f"`_new_{self.keys[0]}`").isNotNull() & hit
            old = db.store.frame(v, touched).join(new, same, "left").select(*[F.when(match, result[c]).otherwise(kept[c]).alias(c) for c in kept])
            files += db.store.write(name, old, v.schema)
        db.store.publish(name, v.schema, [f for f in v.files if f not in touched] + files, v.rules)
        return out


# constraints


def uniques(table: type[Table]) -> list[tuple[tuple[str, ...], Predicate | None, str]]:
    """The labels of each set of fields that is unique, among which rows, and the constraint's name."""
    out = [(tuple(f.label for f in table.keys()), None, f"pk_{table._name}")] if table.keys() else []
    for c in table.constraints:
        labels = tuple(table.field(f).label for f in c.fields)
        if isinstance(c, Unique):
            out.append((labels, None, c.name or "uq_" + "_".join(labels)))
        elif isinstance(c, Index) and c.unique:
            out.append((labels, c.where(table) if c.where else None, c.name or f"idx_{table._name}_" + "_".join(labels)))
    return out


def check_rows(db: Any, table: type[Table], new: DataFrame, others: DataFrame) -> None:
    """New or changed rows against NOT NULL, the key, unique constraints and foreign keys; ``others`` are the table's remaining rows."""
    required = [f.label for f in table._fields.values() if not f.nullable]
    nulls = [F.max(F.col(f"`{c}`").isNull()).alias(c) for c in required]
    found = new.agg(*nulls).first() if nulls else None
    if found and (bad := [c for c in required if found[c]]):
        raise ConstraintViolation(f"{table._name}: null in {', '.join(bad)}", state="23502")
    sets = [(labels, None if among is None else among.build(_Env(db)), name) for labels, among, name in uniques(table)]
    known = {name for _, _, name in sets}
    made = [i for i in db.store.need(table._name).rules["indexes"] if i["unique"] and i["name"] not in known]  # by create_index
    sets += [(tuple(i["columns"]), F.expr(i["where"]) if i["where"] else None, i["name"]) for i in made]
    for labels, among, name in sets:
        cols = [F.col(f"`{c}`") for c in labels]
        held = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        if among is not None:
            held = held & F.coalesce(among, F.lit(False))
        mine, theirs = new.where(held).select(*cols), others.where(held).select(*cols)
        if not mine.groupBy(*cols).count().where("count > 1").isEmpty() or not mine.join(theirs, list(labels), "left_semi").isEmpty():
            raise ConstraintViolation(f"{table._name}: {name} is not unique", state="23505")
    for c in table.constraints:
        if isinstance(c, ForeignKey):
            own = [F.col(f"`{table.field(f).label}`").alias(f"k{i}") for i, f in enumerate(c.fields)]
            keys = new.select(*own).where(reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(len(own))]))
            theirs = db.table(c.target).select(*[F.col(f"`{c.target.field(f).label}`").alias(f"k{i}") for i, f in enumerate(c.target_fields)])
            if c.target is table:
                theirs = theirs.unionByName(new.select(*[F.col(f"`{table.field(f).label}`").alias(f"k{i}") for i, f in enumerate(c.target_fields)]))
            if not keys.join(theirs, [f"k{i}" for i in range(len(own))], "left_anti").isEmpty():
                raise ConstraintViolation(f"{table._name}: no row of {c.target._name} for {', '.join(c.fields)}", state="23503")


def follow(db: Any, table: type[Table], pairs: DataFrame, moved: list[str] | None) -> None:
    """What foreign keys to ``table`` do when its rows go (``moved`` None) or change in the fields ``moved``. ``pairs``: old_ and new_ columns."""
    for child in db.tables:
        for c in child.constraints:
            if not isinstance(c, ForeignKey) or c.target is not table or db.store.current(child._name) is None:
                continue
            targets, own = [table.field(f).label for f in c.target_fields], [child.field(f).label for f in c.fields]
            if moved is not None and not set(targets) & set(moved):
                continue
            action = c.on_delete if moved is None else c.on_update
            lost = pairs.select(*[F.col(f"`old_{t}`").alias(f"_k{i}") for i, t in enumerate(targets)], *([F.col(f"`new_{t}`").alias(f"_n{i}") for i, t in enumerate(targets)] if moved is not None else []))
            if moved is not None:
                lost = lost.where(reduce(lambda a, b: a | b, [~F.col(f"_k{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(targets))]))
            v = db.store.need(child._name)
            rows = db.store.frame(v)
            same = reduce(lambda a, b: a & b, [F.col(f"`{o}`") == F.col(f"_k{i}") for i, o in enumerate(own)])
            hit = rows.join(lost, same, "left_semi")
            touched = db.store.touched(v, hit)
            if not touched:
                continue
            if action in ("no action", "restrict"):
                raise ConstraintViolation(f"{child._name} still refers to {table._name}", state="23503")
            part = db.store.frame(v, touched)
            if action == "cascade" and moved is None:
                after = part.join(lost, same, "left_anti")
            else:
                met = part.join(lost, same, "left")
                value = {o: F.col(f"_n{i}") if action == "cascade" else _default(child.field(c.fields[i])) if action == "set default" else F.lit(None) for i, o in enumerate(own)}
                after = met.select(*[(F.when(F.col("_k0").isNotNull(), value[f.name]).otherwise(F.col(f"`{f.name}`")) if f.name in value else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in v.schema])
                check_rows(db, child, after.join(rows.limit(0), own, "left_anti"), rows.limit(0))
            files = db.store.write(child._name, after, v.schema)
            db.store.publish(child._name, v.schema, [f for f in v.files if f not in touched] + files, v.rules)
            if action == "cascade" and moved is None:
                follow(db, child, hit.select(*[F.col(f"`{f.name}`").alias(f"old_{f.name}") for f in v.schema]), None)
