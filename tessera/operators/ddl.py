"""Creating, changing and verifying tables of the store."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConstraintViolation, SchemaMismatch, SyntaxFailure
from ..plans.schema import MISSING, Field, ForeignKey, Index, Table, Unique
from ..sqltext import literal


def rules_of(table: type[Table]) -> dict[str, Any]:
    """What a declaration demands beyond its columns, in plain values."""
    label = lambda fields: [table.field(f).label for f in fields]
    indexes = [index_rule(table, c) for c in table.constraints if isinstance(c, Index)]
    keys = [f.label for f in table.keys()]
    if len(keys) > 1:
        indexes.append({"name": f"idx_{table._name}_compound_key", "columns": keys, "unique": False, "where": None})
    return {
        "not_null": [f.label for f in table._fields.values() if not f.nullable],
        "key": keys,
        "defaults": {f.label: repr(f.default) for f in table._fields.values() if f.default is not MISSING},
        "indexes": indexes,
        "uniques": [{"name": c.name or "uq_" + "_".join(label(c.fields)), "columns": label(c.fields)} for c in table.constraints if isinstance(c, Unique)],
        "foreign_keys": [
            {"name": c.name or f"fk_{table._name}_" + "_".join(label(c.fields)), "columns": label(c.fields), "target": c.target._name, "target_columns": [c.target.field(f).label for f in c.target_fields], "on_delete": c.on_delete, "on_update": c.on_update}
            for c in table.constraints
            if isinstance(c, ForeignKey)
        ],
    }


class _Bare:
    """Fields of a table as plain columns."""

    def __call__(self, source: Any, label: str) -> Column:
        return F.col(f"`{label}`")

    def literal(self, value: Any) -> str:
        return literal(value)


def index_rule(table: type[Table], index: Index) -> dict[str, Any]:
    """An index in plain values; the condition of a partial one as SQL text, so that it can be stored, compared and checked."""
    labels = [table.field(f).label for f in index.fields]
    where = None
    if index.where is not None:
        rows = SparkSession.active().createDataFrame([], _open(table.spark_schema())).where(index.where(table).build(_Bare()))
        where = rows._jdf.queryExecution().analyzed().expressions().apply(0).sql()
    return {"name": index.name or f"idx_{table._name}_" + "_".join(labels), "columns": labels, "unique": index.unique, "where": where}


def _open(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def create(db: Any, table: type[Table], if_not_exists: bool = False) -> None:
    if db.store.current(table._name) is not None:
        if if_not_exists:
            return
        raise SyntaxFailure(f"{table._name} exists", state="42P07")
    db.store.publish(table._name, _open(table.spark_schema()), [], rules_of(table))


def drop(db: Any, table: type[Table], if_exists: bool = False) -> None:
    if db.store.current(table._name) is None and if_exists:
        return
    v = db.store.need(table._name)
    db.store.publish(table._name, v.schema, None, v.rules)


def truncate(db: Any, table: type[Table]) -> None:
    v = db.store.need(table._name)
    db.store.publish(table._name, v.schema, [], v.rules)


def add_column(db: Any, table: type[Table], field: Field) -> None:
    """A column at the end; files stay as they are, old rows read as null, unless a default makes them be written anew."""
    v = db.store.need(table._name)
    if field.label.lower() in (c.lower() for c in v.schema.names):
        raise SyntaxFailure(f"{table._name} has a column {field.label}", state="42701")
    schema = T.StructType([*v.schema.fields, T.StructField(field.label, field.codec.stored, True)])
    files = v.files
    if field.default is not MISSING and files:
        files = db.store.write(table._name, db.store.frame(v).withColumn(field.label, F.lit(field.codec.put(field.default))), schema)
    db.store.publish(table._name, schema, files, v.rules)


def _rewrite(db: Any, table: type[Table], old: str, new: T.StructField | None) -> None:
    v = db.store.need(table._name)
    if old not in v.schema.names:
        raise SyntaxFailure(f"{table._name} has no column {old}", state="42703")
    fields = [f if f.name != old else new for f in v.schema if f.name != old or new is not None]
    schema = T.StructType(fields)
    rows = db.store.frame(v).select(*[F.col(f"`{old if f is new else f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    db.store.publish(table._name, schema, db.store.write(table._name, rows, schema) if v.files else [], v.rules)


def drop_column(db: Any, table: type[Table], label: str) -> None:
    _rewrite(db, table, label, None)


def rename_column(db: Any, table: type[Table], label: str, to: str) -> None:
    _rewrite(db, table, label, T.StructField(to, db.store.need(table._name).schema[label].dataType, True))


def retype_column(db: Any, table: type[Table], label: str, to: T.DataType) -> None:
    _rewrite(db, table, label, T.StructField(label, to, True))


def create_index(db: Any, table: type[Table], index: Index, if_not_exists: bool = False) -> None:
    """An index is a note in the table's rules, as files have none; a unique one holds for the rows there are and is checked on writes."""
    v = db.store.need(table._name)
    made = index_rule(table, index)
    name = made["name"]
    if any(i["name"] == name for i in v.rules["indexes"]):
        if if_not_exists:
            return
        raise SyntaxFailure(f"there is an index {name}", state="42P07")
    if index.unique:
        rows = db.store.frame(v).where(" and ".join([f"`{c}` is not null" for c in made["columns"]] + ([f"({made['where']})"] if made["where"] else [])))
        if not rows.groupBy(*[f"`{c}`" for c in made["columns"]]).count().where("count > 1").isEmpty():
            raise ConstraintViolation(f"{table._name}: {name} is not unique", state="23505")
    db.store.publish(table._name, v.schema, v.files, v.rules | {"indexes": [*v.rules["indexes"], made]})


def drop_index(db: Any, table: type[Table], name: str) -> None:
    v = db.store.need(table._name)
    db.store.publish(table._name, v.schema, v.files, v.rules | {"indexes": [i for i in v.rules["indexes"] if i["name"] != name]})


# verification

#: Types that count as one unless types are compared strictly.
FAMILIES = (("byte", "short", "integer", "long", "int", "smallint", "bigint", "tinyint"), ("string", "varchar", "char"), ("decimal", "double", "float"), ("boolean",), ("timestamp", "timestamp_ntz"))


@dataclasses.dataclass(frozen=True)
class Checks:
    """What ``verify`` looks at: all but exact types and names, unless said otherwise."""

    extra_columns: bool = True
    types: bool = True
    strict_types: bool = False
    nulls: bool = True
    indexes: bool = True
    uniques: bool = True
    foreign_keys: bool = True
    names: bool = False


DEFAULT, MINIMAL, STRICT = Checks(), Checks(extra_columns=False, indexes=False, uniques=False, foreign_keys=False), Checks(strict_types=True, names=True)


@dataclasses.dataclass(frozen=True)
class Issue:
    kind: str
    what: str

    def __str__(self) -> str:
        return f"{self.kind}: {self.what}"


def _folded(x: Any) -> Any:
    """Names without their case, which databases change as they like."""
    return x.lower() if isinstance(x, str) else [_folded(y) for y in x] if isinstance(x, list) else x


def _family(kind: str) -> str:
    bare = kind.split("(")[0].lower()
    return next((f[0] for f in FAMILIES if bare in f), bare)


def differences(db: Any, table: type[Table], checks: Checks = DEFAULT) -> list[Issue]:
    """What a declaration and the source's table differ in.

    A source that knows no rules (files, catalog tables, frames, streams) is held to columns and types alone; a database's rules come from its own catalog.
    """
    found = db.source.describe(db.spark, table._name)
    if found is None:
        return [Issue("table not found", table._name)]
    schema, rules = found
    have = {f.name.lower(): f for f in schema}
    want, out = rules_of(table), []
    not_null = {c.lower() for c in rules["not_null"]} if rules else set()
    for f in table._fields.values():
        there = have.pop(f.label.lower(), None)
        if there is None:
            out.append(Issue("missing column", f.label))
            continue
        own, theirs = f.codec.stored.simpleString(), there.dataType.simpleString()
        if checks.types and (own != theirs if checks.strict_types else _family(own) != _family(theirs)):
            out.append(Issue("type mismatch", f"{f.label} is {theirs}, not {own}"))
        if checks.nulls and rules and (f.label.lower() not in not_null) != f.nullable:
            out.append(Issue("nullability mismatch", f.label))
    if checks.extra_columns:
        out += [Issue("extra column", f.name) for f in have.values()]
    if not rules:
        return out
    if sorted(c.lower() for c in rules["key"]) != sorted(c.lower() for c in want["key"]):
        out.append(Issue("primary key mismatch", f"{rules['key']}, not {want['key']}"))
    parts = (
        (checks.indexes, "indexes", "index", ("columns", "unique", *(("where",) if rules.get("partial_indexes", True) else ()))),
        (checks.uniques, "uniques", "unique constraint", ("columns",)),
        (checks.foreign_keys, "foreign_keys", "foreign key", ("columns", "target", "target_columns")),
    )
    for on, part, kind, same in parts:
        for w in want[part] if on else ():
            match = [x for x in rules[part] if all(_folded(x[k]) == _folded(w[k]) for k in same)]
            if not match:
                out.append(Issue(f"missing {kind}", ", ".join(w["columns"])))
            elif checks.names and all(_folded(x["name"]) != _folded(w["name"]) for x in match):
                out.append(Issue(f"{kind} name mismatch", f"{match[0]['name']}, not {w['name']}"))
    return out


def verify(db: Any, table: type[Table], checks: Checks = DEFAULT) -> None:
    if found := differences(db, table, checks):
        raise SchemaMismatch(table._name, found)
