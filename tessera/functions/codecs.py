"""Logical types: the Spark type a value is stored as, and how values are bound and decoded."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import json
import types
import typing
import uuid
from collections.abc import Callable
from typing import Any, NewType

from pyspark.sql import types as T

from ..errors import DataFailure, EncodingFailure

Short, Int, Float, Text, Url = NewType("Short", int), NewType("Int", int), NewType("Float", float), NewType("Text", str), NewType("Url", str)


@dataclasses.dataclass(frozen=True)
class Codec:
    """``bind`` makes the stored value of a Python value, ``decode`` turns it back; ``then`` derives a codec for a type of one's own."""

    name: str
    stored: T.DataType
    bind: Callable[[Any], Any] = lambda v: v
    decode: Callable[[Any], Any] = lambda v: v

    def then(self, decode: Callable[[Any], Any], bind: Callable[[Any], Any], name: str | None = None) -> Codec:
        return Codec(name or self.name, self.stored, lambda v: self.bind(bind(v)), lambda v: decode(self.decode(v)))

    def put(self, value: Any) -> Any:
        if value is None:
            return None
        try:
            return self.bind(value)
        except DataFailure:
            raise
        except Exception as e:
            raise EncodingFailure(f"{value!r} is no {self.name}: {e}", cause=e) from e

    def get(self, value: Any) -> Any:
        return None if value is None else self.decode(value)


@dataclasses.dataclass(frozen=True)
class Dec:
    """A decimal's precision and scale, as in ``Annotated[Decimal, Dec(12, 2)]``."""

    precision: int = 38
    scale: int = 18


class Json:
    """``Json[X]``: stored as JSON text; X is a dataclass, dict, list or plain value."""

    def __class_getitem__(cls, inner: Any) -> Any:
        return typing.Annotated[inner, cls]


def _plain(value: Any) -> Any:
    return dataclasses.asdict(value) if dataclasses.is_dataclass(value) and not isinstance(value, type) else value


def json_codec(inner: Any) -> Codec:
    make = (lambda d: inner(**d)) if dataclasses.is_dataclass(inner) else (lambda d: d)
    return Codec("json", T.StringType(), lambda v: json.dumps(_plain(v), separators=(",", ":"), ensure_ascii=False), lambda s: make(json.loads(s)))


def _checked(kind: type) -> Callable[[Any], Any]:
    def bind(v: Any) -> Any:
        if isinstance(v, bool) is not (kind is bool) or not isinstance(v, (int, float, decimal.Decimal) if kind is float else kind):
            raise TypeError(f"{type(v).__name__} given")
        return v if isinstance(v, (dt.date, dt.datetime)) else kind(v)

    return bind


def _time_in(t: dt.time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def _time_out(n: int) -> dt.time:
    s, us = divmod(n, 1_000_000)
    return dt.time(s // 3600, s // 60 % 60, s % 60, us)


INSTANT = Codec("instant", T.TimestampType(), lambda v: v)
PLAIN: dict[Any, Codec] = {
    str: Codec("string", T.StringType(), _checked(str)),
    Text: Codec("text", T.StringType(), _checked(str)),
    Url: Codec("url", T.StringType(), _checked(str)),
    Short: Codec("short", T.ShortType(), _checked(int)),
    Int: Codec("int", T.IntegerType(), _checked(int)),
    int: Codec("long", T.LongType(), _checked(int)),
    bool: Codec("boolean", T.BooleanType(), _checked(bool)),
    Float: Codec("float", T.FloatType(), _checked(float)),
    float: Codec("double", T.DoubleType(), _checked(float)),
    decimal.Decimal: Codec("decimal", T.DecimalType(38, 18), lambda v: decimal.Decimal(v) if not isinstance(v, float) else decimal.Decimal(str(v))),
    dt.date: Codec("date", T.DateType(), _checked(dt.date)),
    dt.time: Codec("time", T.LongType(), _time_in, _time_out),
    dt.datetime: Codec("timestamp", T.TimestampNTZType(), _checked(dt.datetime)),
    uuid.UUID: Codec("uuid", T.StringType(), lambda v: str(v if isinstance(v, uuid.UUID) else uuid.UUID(v)), uuid.UUID),
    bytes: Codec("binary", T.BinaryType(), bytes),
}


def codec_of(hint: Any) -> tuple[Codec, bool]:
    """The codec of a type annotation and whether it allows null. Types without one fall back to JSON."""
    args = typing.get_args(hint)
    if typing.get_origin(hint) in (typing.Union, types.UnionType) and type(None) in args:
        rest = [a for a in args if a is not type(None)]
        return codec_of(rest[0])[0], True
    if typing.get_origin(hint) is typing.Annotated:
        for extra in args[1:]:
            if isinstance(extra, Codec):
                return extra, False
            if isinstance(extra, Dec):
                return dataclasses.replace(PLAIN[decimal.Decimal], stored=T.DecimalType(extra.precision, extra.scale)), False
            if extra is Json:
                return json_codec(args[0]), False
        return codec_of(args[0])
    if isinstance(hint, Codec):
        return hint, False
    if typing.get_origin(hint) is list:
        inner, null = codec_of(args[0])
        return Codec("array", T.ArrayType(inner.stored, True), lambda v: [inner.put(x) for x in v], lambda v: [inner.get(x) for x in v]), False
    return PLAIN.get(hint) or json_codec(hint), False
