"""Tables as classes: fields, keys, defaults, indexes, unique constraints and foreign keys.

    class Users(Table, name="users"):
        id: int = column(key=True, generated=True)
        name: str
        email: str | None = column(label="e_mail")
        constraints = (unique("name"), index("email", where=lambda t: t.email.is_not_null()))
"""

from __future__ import annotations

import dataclasses
import re
import typing
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from ..functions.codecs import Codec, codec_of
from .expr import Ref

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
MISSING = object()


def identifier(name: str) -> str:
    """``name`` if it is a plain identifier; anything else is refused."""
    if not isinstance(name, str) or not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


@dataclasses.dataclass(frozen=True)
class column:
    """A field's options: its stored name, whether it is (part of) the key, whether the store gives it a number, its default, a codec."""

    label: str | None = None
    key: bool = False
    generated: bool = False
    default: Any = MISSING
    codec: Codec | None = None


@dataclasses.dataclass(frozen=True)
class Field:
    name: str
    label: str
    codec: Codec
    nullable: bool
    key: bool = False
    generated: bool = False
    default: Any = MISSING


@dataclasses.dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    name: str | None = None
    unique: bool = False
    where: Callable | None = None


@dataclasses.dataclass(frozen=True)
class Unique:
    fields: tuple[str, ...]
    name: str | None = None


ACTIONS = ("no action", "restrict", "cascade", "set null", "set default")


@dataclasses.dataclass(frozen=True)
class ForeignKey:
    fields: tuple[str, ...]
    target: Any
    target_fields: tuple[str, ...]
    on_delete: str = "no action"
    on_update: str = "no action"
    name: str | None = None

    def __post_init__(self) -> None:
        if self.on_delete not in ACTIONS or self.on_update not in ACTIONS or len(self.fields) != len(self.target_fields):
            raise ValueError("a foreign key needs known actions and as many target fields as fields")


def index(*fields: str, name: str | None = None, unique: bool = False, where: Callable | None = None) -> Index:
    return Index(fields, name, unique, where)


def unique(*fields: str, name: str | None = None) -> Unique:
    return Unique(fields, name)


def foreign_key(*fields: str, to: Any, at: tuple[str, ...] | str, on_delete: str = "no action", on_update: str = "no action", name: str | None = None) -> ForeignKey:
    return ForeignKey(fields, to, (at,) if isinstance(at, str) else tuple(at), on_delete, on_update, name)


class Occurrence:
    """A table in a query, under an alias that is given or left to the query; its fields are attributes."""

    def __init__(self, table: type[Table], alias: str | None = None):
        self._table, self._alias = table, alias and identifier(alias)

    def __getattr__(self, name: str) -> Ref:
        if name.startswith("__"):
            raise AttributeError(name)
        return Ref(self, self._table.field(name))


class _TableMeta(type):
    def __getattr__(cls, name: str) -> Ref:
        fields = cls.__dict__.get("_fields", {})
        if name in fields:
            return Ref(cls._self, fields[name])
        raise AttributeError(f"{cls.__name__} has no field {name!r}")


class Table(metaclass=_TableMeta):
    """The base of declared tables. An instance is one row: ``Users(name="Ann")``; missing fields take their defaults or null."""

    _fields: dict[str, Field] = {}
    constraints: tuple = ()

    def __init_subclass__(cls, name: str | None = None, **kw: Any):
        super().__init_subclass__(**kw)
        cls._name = name or cls.__name__.lower()
        fields = {}
        for key, hint in typing.get_type_hints(cls, include_extras=True).items():
            if key.startswith("_") or key == "constraints":
                continue
            opt = cls.__dict__.get(key, MISSING)
            opt = opt if isinstance(opt, column) else column(default=opt)
            codec, nullable = codec_of(hint)
            fields[key] = Field(key, opt.label or key, opt.codec or codec, nullable, opt.key or opt.generated, opt.generated, opt.default)
            if key in cls.__dict__:
                delattr(cls, key)
        labels = [f.label.lower() for f in fields.values()]
        if len(set(labels)) < len(labels):
            raise TypeError(f"{cls.__name__}: two fields have one label")
        cls._fields, cls._self = fields, Occurrence(cls)

    def __init__(self, **values: Any):
        for f in self._fields.values():
            if f.name in values:
                setattr(self, f.name, values.pop(f.name))
            elif f.default is not MISSING:
                setattr(self, f.name, f.default)
            elif f.nullable or f.generated:
                setattr(self, f.name, None)
            else:
                raise TypeError(f"{type(self).__name__} needs {f.name}")
        if values:
            raise TypeError(f"{type(self).__name__} has no field {next(iter(values))!r}")

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and self.__dict__ == other.__dict__

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items())})"

    @classmethod
    def field(cls, name: str) -> Field:
        if name not in cls._fields:
            raise AttributeError(f"{cls.__name__} has no field {name!r}")
        return cls._fields[name]

    @classmethod
    def as_(cls, alias: str) -> Occurrence:
        """An occurrence under an alias of one's own; needed where a table comes twice."""
        return Occurrence(cls, alias)

    @classmethod
    def spark_schema(cls) -> T.StructType:
        return T.StructType([T.StructField(f.label, f.codec.stored, f.nullable, {"key": f.key, "generated": f.generated}) for f in cls._fields.values()])

    @classmethod
    def keys(cls) -> list[Field]:
        return [f for f in cls._fields.values() if f.key]

    @classmethod
    def decode(cls, row: Any) -> Table:
        out = object.__new__(cls)
        for f in cls._fields.values():
            setattr(out, f.name, f.codec.get(row[f.label]))
        return out

    def stored(self) -> dict[str, Any]:
        return {f.label: f.codec.put(getattr(self, f.name)) for f in self._fields.values()}
