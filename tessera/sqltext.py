"""Raw SQL that stays safe: values are bound, identifiers quoted, tables and fields named; only ``unsafe`` puts text in as it is."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import string
import textwrap
import traceback
import uuid
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

from .errors import InvalidStatement
from .plans.expr import Ref
from .plans.schema import Occurrence, Table


@dataclasses.dataclass(frozen=True)
class Fragment:
    """SQL text in parts: plain strings, bound values (one-element tuples) and tables; and the issues found on the way."""

    parts: tuple[Any, ...] = ()
    issues: tuple[str, ...] = ()

    def __add__(self, other: Fragment | str) -> Fragment:
        other = other if isinstance(other, Fragment) else sql(other)
        return Fragment(self.parts + other.parts, self.issues + other.issues)

    def validate(self) -> None:
        if self.issues:
            raise InvalidStatement(list(self.issues), self.show())

    def values(self) -> list[Any]:
        return [p[0] for p in self.parts if isinstance(p, tuple)]

    def text(self) -> str:
        """With ? for values and the tables' own names."""
        return "".join("?" if isinstance(p, tuple) else f"{p._table._name} as {_alias(p)}" if isinstance(p, Occurrence) else p for p in self.parts)

    def show(self) -> str:
        """With values written out, for reading and logs only."""
        return "".join(literal(p[0]) if isinstance(p, tuple) else f"{p._table._name} as {_alias(p)}" if isinstance(p, Occurrence) else p for p in self.parts)

    def stripped(self, margin: str = "|") -> Fragment:
        """Without the margin that each line of plain text begins with."""
        import re

        return Fragment(tuple(re.sub(rf"(?m)^[ \t]*{re.escape(margin)}", "", p) if isinstance(p, str) else p for p in self.parts), self.issues)

    def lower(self, db: Any, around: Any = None) -> DataFrame:
        """Runs through Spark's own parser, values as its parameters, tables as views for the time of the call."""
        self.validate()
        text, args, views = [], [], []
        for p in self.parts:
            if isinstance(p, tuple):
                text.append("?")
                args.append(str(p[0]) if isinstance(p[0], uuid.UUID) else p[0])
            elif isinstance(p, Occurrence):
                view = f"tessera_{uuid.uuid4().hex}"
                db.table(p._table).createOrReplaceTempView(view)
                views.append(view)
                text.append(f"{view} as {_alias(p)}")
            else:
                text.append(p)
        try:
            return db.spark.sql("".join(text), args=args or None)
        finally:
            for v in views:
                db.spark.catalog.dropTempView(v)

    def all_issues(self) -> tuple[str, ...]:
        return self.issues

    def single_type(self) -> None:
        return None


def _alias(o: Occurrence) -> str:
    return o._alias or o._table._name.rsplit(".", 1)[-1]


def unsafe(text: str) -> Fragment:
    """Text put in as it is. Never from outside."""
    return Fragment((text,))


def ident(name: str) -> Fragment:
    """A quoted identifier, each dotted part by itself."""
    return Fragment((".".join("`" + p.replace("`", "``") + "`" for p in name.split(".")),))


def join(parts: Iterable[Fragment], between: str = ", ") -> Fragment:
    out = Fragment()
    for i, p in enumerate(parts):
        out = out + (unsafe(between) if i else Fragment()) + p
    return out


def value_list(values: Iterable[Any]) -> Fragment:
    """``(?, ?)`` with each value once, in the order of their first coming; none at all is an issue, with the place it came from."""
    values = list(dict.fromkeys(values))
    if not values:
        at = traceback.extract_stack(limit=2)[0]
        return Fragment(("(null)",), (f"an empty list at {at.filename}:{at.lineno}",))
    return unsafe("(") + join(Fragment(((v,),)) for v in values) + unsafe(")")


def _part(value: Any) -> Fragment:
    if isinstance(value, Fragment):
        return value
    if isinstance(value, Ref):
        return unsafe(f"{_alias(value.occurrence)}.{value.label}")
    if isinstance(value, Occurrence):
        return Fragment((value,))
    if isinstance(value, type) and issubclass(value, Table):
        return Fragment((Occurrence(value),))
    return Fragment(((value,),))


def sql(template: str, **values: Any) -> Fragment:
    """``sql("select * from {u} where {u.id} = {n}", u=Users, n=5)``: tables give their name and alias, fields their label, the rest is bound."""
    out = Fragment()
    for text, name, spec, _ in string.Formatter().parse(template):
        out = out + unsafe(text) if text else out
        if name is not None:
            first, *path = name.split(".")
            if first not in values:
                raise KeyError(f"no value for {first}")
            value = values[first]
            for p in path:
                value = getattr(value, p)
            out = out + _part(value)
    return out


def literal(value: Any) -> str:
    """A value as SQL text of its type. Strings are written as bytes if they hold anything that could end or escape a literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, decimal.Decimal):
        digits = value.as_tuple()
        scale = max(0, -digits.exponent)
        return f"cast('{value:f}' as decimal({max(len(digits.digits), scale + 1)},{scale}))"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"timestamp{'_ntz' if value.tzinfo is None else ''} '{value.isoformat(' ')}'"
    if isinstance(value, dt.date):
        return f"date '{value.isoformat()}'"
    text = str(value)
    if "\\" in text or not text.isprintable():
        return f"decode(unhex('{text.encode().hex()}'), 'UTF-8')"
    return "'" + text.replace("'", "''") + "'"


def dedented(template: str, **values: Any) -> Fragment:
    return sql(textwrap.dedent(template).strip(), **values)
