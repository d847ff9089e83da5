"""Raw SQL statements that change the store's tables: insert, update, delete, truncate, create and drop.

The statement's frame is read here; its conditions, values and queries are Spark's own SQL. They become the same changes as the builders',
with the same constraints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SyntaxFailure
from ..plans.expr import Predicate
from ..functions.codecs import Codec
from ..plans.schema import Occurrence, Table, column
from ..sqltext import Fragment, literal
from . import ddl
from .mutations import Delete, Insert, Update

_NAME = r"(?P<name>[A-Za-z_][\w.]*)"
_FORMS = {
    "insert": rf"insert\s+into\s+{_NAME}\s*(?:\((?P<columns>[^()]*)\))?\s*(?P<query>(?:select|values|with|table)\b.*)",
    "update": rf"update\s+{_NAME}\s+set\s+(?P<sets>.*)",
    "delete": rf"delete\s+from\s+{_NAME}\s*(?:where\s+(?P<where>.*))?",
    "truncate": rf"truncate\s+table\s+{_NAME}",
    "create": rf"create\s+table\s+(?P<unless>if\s+not\s+exists\s+)?{_NAME}\s*\((?P<fields>.*)\)",
    "drop": rf"drop\s+table\s+(?P<there>if\s+exists\s+)?{_NAME}",
}
_QUOTED = r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\""


def is_change(fragment: Fragment) -> bool:
    return bool(re.match(r"\s*(?:insert|update|delete|truncate|create\s+table|drop\s+table)\b", fragment.text(), re.I))


def _pieces(text: str) -> Iterator[tuple[str, int]]:
    """The text's quoted parts, words and other characters, each with the depth of parentheses it is in."""
    depth = 0
    for m in re.finditer(rf"{_QUOTED}|\w+|\s+|.", text, re.S):
        depth -= m[0] == ")"
        yield m[0], depth
        depth += m[0] == "("


def _split(text: str, at: str) -> list[str]:
    """Cut at a word or character that stands outside quotes and parentheses."""
    out = [""]
    for piece, depth in _pieces(text):
        if depth == 0 and piece.lower() == at:
            out.append("")
        else:
            out[-1] += piece
    return out


def _unqualified(text: str, names: list[str]) -> str:
    """Fields without the table's name before them."""
    prefix = re.compile(rf"({_QUOTED})|\b(?:{'|'.join(map(re.escape, names))})\.(?=[A-Za-z_`])", re.S)
    return prefix.sub(lambda m: m[1] or "", text)


class RawChange:
    """A raw statement as a change: ``run`` gives the rows it affected."""

    def __init__(self, fragment: Fragment):
        self.fragment = fragment

    def __repr__(self) -> str:
        return self.fragment.show()

    def _text(self, db: Any) -> tuple[str, dict[str, type[Table]]]:
        known, text = {t._name: t for t in db.tables}, []
        for p in self.fragment.parts:
            if isinstance(p, Occurrence):
                known[p._table._name] = p._table
                text.append(p._table._name)
            else:
                text.append(literal(p[0]) if isinstance(p, tuple) else p)
        return "".join(text).strip().rstrip(";"), known

    def run(self, db: Any) -> DataFrame:
        self.fragment.validate()
        text, known = self._text(db)
        form = text.split(None, 1)[0].lower()
        m = re.fullmatch(_FORMS[form], text, re.I | re.S)
        if not m:
            raise SyntaxFailure("not a statement that the store takes", text, "42601")
        name = m["name"]
        if form == "create":
            return self._create(db, name, m["fields"], bool(m["unless"]))
        if name not in known and not (form == "drop" and m["there"]):
            known[name] = self._undeclared(db, name)
        table = known.get(name)
        none = db.spark.range(0)
        if form == "drop":
            if table is not None:
                ddl.drop(db, table, bool(m["there"]))
            return none
        if form == "truncate":
            ddl.truncate(db, table)
            return none
        names = [name, name.rsplit(".", 1)[-1]]
        if form == "insert":
            return Insert(table).from_query(_Rows(m["query"], m["columns"], table, known)).run(db)
        if form == "delete":
            change: Any = Delete(table)
            where = m["where"]
        else:
            sets, *conditions = _split(m["sets"], "where")
            where, change = " where ".join(conditions) or None, Update(table)
            for one in _split(sets, ","):
                left, _, right = one.partition("=")
                label = _unqualified(left.strip(), names).strip("`").lower()
                field = next((f for f in table._fields.values() if f.label.lower() == label), None)
                if field is None or not right:
                    raise SyntaxFailure(f"{name} has no field {label}", text, "42703")
                change = change.set(getattr(table, field.name), F.expr(_unqualified(right, names)))
        bare = where and _unqualified(where, names)
        return (change.where(Predicate(lambda env: F.expr(bare))) if bare else change.all()).run(db)

    def _undeclared(self, db: Any, name: str) -> type[Table]:
        """A declaration made from the table's own columns and rules, for one that the statement only names."""
        v = db.store.need(name)
        return declared(name, v.schema, v.rules)

    def _create(self, db: Any, name: str, fields: str, unless: bool) -> DataFrame:
        columns, key = [], []
        for c in _split(fields, ","):
            if m := re.match(r"\s*primary\s+key\s*\((.*)\)\s*$", c, re.I):
                key += [k.strip(" `") for k in m[1].split(",")]
            else:
                bare = re.sub(r"\bprimary\s+key\b", "not null", c, flags=re.I)
                columns.append(bare)
                key += [bare.split()[0].strip("`")] if bare != c else []
        schema = T.StructType.fromDDL(", ".join(columns))
        rules = {"not_null": [f.name for f in schema if not f.nullable or f.name in key], "key": key}
        ddl.create(db, declared(name, schema, rules), unless)
        return db.spark.range(0)


def declared(name: str, schema: T.StructType, rules: dict[str, Any]) -> type[Table]:
    """A Table class of a table's columns, key and nullability."""
    hints, body = {}, {"__module__": __name__}
    for f in schema:
        hints[f.name] = object if f.name in rules["not_null"] else object | None
        body[f.name] = column(key=f.name in rules["key"], codec=Codec(f.dataType.simpleString(), f.dataType))
    return type(Table)(name.rsplit(".", 1)[-1], (Table,), body | {"__annotations__": hints}, name=name)


class _Rows:
    """The query of an insert, with its columns under the table's labels."""

    def __init__(self, query: str, columns: str | None, table: type[Table], known: dict[str, type[Table]]):
        self.query, self.table, self.known = query, table, known
        self.columns = [c.strip(" `") for c in columns.split(",")] if columns else [f.label for f in table._fields.values()]

    def lower(self, db: Any, around: Any = None) -> DataFrame:
        named = [t for n, t in self.known.items() if re.search(rf"\b{re.escape(n)}\b", self.query)]
        text, parts = re.sub(r"(?i)^values\b", "select * from values", self.query), []
        if not named:
            parts = [text]
        else:
            pattern = re.compile(rf"({_QUOTED})|\b((?:from|join)\s+)({'|'.join(re.escape(t._name) for t in named)})\b", re.I | re.S)
            by_name, at = {t._name.lower(): t for t in named}, 0
            for m in pattern.finditer(text):
                if m[3]:
                    parts += [text[at : m.start(3)], Occurrence(by_name[m[3].lower()])]
                    at = m.end(3)
            parts.append(text[at:])
        df = Fragment(tuple(parts)).lower(db)
        if len(df.columns) != len(self.columns):
            raise SyntaxFailure(f"{len(df.columns)} values for {len(self.columns)} columns", self.query, "42601")
        return df.toDF(*self.columns)
