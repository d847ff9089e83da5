"""Predicates and other expressions over the fields of tables, kept unresolved until a query gives its tables their aliases."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions.text import similar_to_regex

#: How an expression finds the column of a field: from the occurrence and the label.
Env = Callable[[Any, str], Column]


@dataclasses.dataclass(frozen=True, eq=False)
class Predicate:
    """A condition; ``issues`` are faults found while it was made, which keep the statement from running."""

    build: Callable[[Env], Column]
    issues: tuple[str, ...] = ()
    needs: tuple = ()  # the occurrences it names
    keyed: bool = False  # it holds only where something of the query equals something of the enclosing one

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda env: self.build(env) & other.build(env), self.issues + other.issues, self.needs + other.needs, self.keyed or other.keyed)

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda env: self.build(env) | other.build(env), self.issues + other.issues, self.needs + other.needs)

    def __invert__(self) -> Predicate:
        return Predicate(lambda env: ~self.build(env), self.issues, self.needs)

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with & and |, and compare fields one at a time")

    # groups read left to right: a.or_(b).and_(c) is (a or b) and c
    and_, or_ = __and__, __or__


@dataclasses.dataclass(frozen=True)
class Sort:
    ref: Any
    descending: bool = False
    nulls_first: bool | None = None

    def column(self, env: Env) -> Column:
        """Without a word on nulls they come last in ascending and first in descending order."""
        c = self.ref.column(env)
        first = self.descending if self.nulls_first is None else self.nulls_first
        if self.descending:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()


@dataclasses.dataclass(frozen=True)
class Seek:
    """A place to go on from: rows beyond ``value`` of a field, sorted by it."""

    ref: Any
    value: Any
    forward: bool = True
    sort: Sort | None = None

    def predicate(self) -> Predicate:
        return self.ref > self.value if self.forward else self.ref < self.value

    def order(self) -> Sort:
        return self.sort or Sort(self.ref, descending=not self.forward)


class Operand:
    """What comparisons can start from."""

    dtype: Any = None
    needs: tuple = ()
    outside = False  # it is made of the enclosing query's fields

    def column(self, env: Env) -> Column:
        raise NotImplementedError

    def _value(self, value: Any) -> Callable[[Env], Column]:
        if isinstance(value, Operand):
            return value.column
        if isinstance(value, Column):
            return lambda env: value
        return self._literal(value)

    def _literal(self, value: Any) -> Callable[[Env], Column]:
        return lambda env: F.lit(value)

    def _compare(self, other: Any, how: Callable[[Column, Column], Column]) -> Predicate:
        right = self._value(other)
        return Predicate(lambda env: how(self.column(env), right(env)), (), self.needs + getattr(other, "needs", ()))

    def _test(self, how: Callable[[Column], Column]) -> Predicate:
        return Predicate(lambda env: how(self.column(env)), (), self.needs)

    # a null on the right is bound as null, so that the comparison is never true
    def __eq__(self, other: Any) -> Predicate:  # type: ignore[override]
        return dataclasses.replace(self._compare(other, lambda a, b: a == b), keyed=isinstance(other, Operand) and self.outside != other.outside)

    def __ne__(self, other: Any) -> Predicate:  # type: ignore[override]
        return self._compare(other, lambda a, b: a != b)

    def __lt__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a < b)

    def __le__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a <= b)

    def __gt__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a > b)

    def __ge__(self, other: Any) -> Predicate:
        return self._compare(other, lambda a, b: a >= b)

    def __hash__(self) -> int:
        return id(self)

    def is_null(self) -> Predicate:
        return self._test(lambda c: c.isNull())

    def is_not_null(self) -> Predicate:
        return self._test(lambda c: c.isNotNull())

    def between(self, low: Any, high: Any) -> Predicate:
        return (self >= low) & (self <= high)

    def _pattern(self, pattern: Any, with_column: Callable[[Column, Column], Column], prepare: Callable[[str], str] = lambda p: p) -> Predicate:
        right = pattern.column if isinstance(pattern, Operand) else lambda env: F.lit(prepare(pattern))
        return Predicate(lambda env: with_column(self.column(env), right(env)), (), self.needs + getattr(pattern, "needs", ()))

    def like(self, pattern: Any) -> Predicate:
        return self._pattern(pattern, F.like)

    def not_like(self, pattern: Any) -> Predicate:
        return ~self.like(pattern)

    def ilike(self, pattern: Any) -> Predicate:
        return self._pattern(pattern, F.ilike)

    def similar_to(self, pattern: str) -> Predicate:
        return self._pattern(pattern, F.rlike, similar_to_regex)

    def matches(self, pattern: Any) -> Predicate:
        return self._pattern(pattern, F.rlike)

    def imatches(self, pattern: Any) -> Predicate:
        return self._pattern(pattern, lambda c, p: F.rlike(c, F.concat(F.lit("(?i)"), p)))

    def satisfies(self, test: Callable[..., Column], *values: Any) -> Predicate:
        """A test of one's own: a function of columns that gives a boolean column."""
        rights = [self._value(v) for v in values]
        return Predicate(lambda env: test(self.column(env), *(r(env) for r in rights)), (), self.needs)

    def in_(self, values: Iterable[Any]) -> Predicate:
        """One of the values, each counted once; none at all is an issue, not an empty result."""
        values = list(dict.fromkeys(values))
        if not values:
            return Predicate(lambda env: F.lit(False), (f"the list for {self} is empty",), self.needs)
        made = [self._value(v) for v in values]
        return Predicate(lambda env: self.column(env).isin(*(m(env) for m in made)), (), self.needs)

    def not_in(self, values: Iterable[Any]) -> Predicate:
        return ~self.in_(values)

    def in_query(self, query: Any) -> Predicate:
        """A member of the query's one column; types must agree. NOT of it keeps SQL's three-valued logic."""
        kind = query.single_type()
        if self.dtype is not None and kind is not None and kind != self.dtype:
            raise TypeError(f"{self} is {self.dtype.simpleString()}, the query gives {kind.simpleString()}")
        return Predicate(lambda env: self.column(env).isin(env.subquery(query)), query.all_issues(), self.needs)

    def not_in_query(self, query: Any) -> Predicate:
        return ~self.in_query(query)

    def json(self, path: str) -> Path:
        return Path(self, path)

    def json_contains(self, want: Any) -> Predicate:
        return self._test(lambda c: jsons.contains(c, want))

    def json_has(self, key: str) -> Predicate:
        return self._test(lambda c: jsons.has_key(c, key))

    def json_has_any(self, *keys: str) -> Predicate:
        return self._test(lambda c: jsons.has_any_key(c, list(keys)))

    def json_has_all(self, *keys: str) -> Predicate:
        return self._test(lambda c: jsons.has_all_keys(c, list(keys)))

    def has_element(self, value: Any) -> Predicate:
        right = value.column if isinstance(value, Operand) else lambda env: F.lit(value)
        return Predicate(lambda env: F.array_contains(self.column(env), right(env)), (), self.needs)

    def asc(self, nulls_first: bool | None = None) -> Sort:
        return Sort(self, False, nulls_first)

    def desc(self, nulls_first: bool | None = None) -> Sort:
        return Sort(self, True, nulls_first)

    def after(self, value: Any) -> Seek:
        return Seek(self, value)

    def before(self, value: Any) -> Seek:
        return Seek(self, value, forward=False)


class Ref(Operand):
    """A field of an occurrence of a table; values compared with it are bound by its codec and cast to its type."""

    def __init__(self, occurrence: Any, field: Any):
        self.occurrence, self.field = occurrence, field
        self.label, self.dtype, self.needs = field.label, field.codec.stored, (occurrence,)

    def __repr__(self) -> str:
        return f"{self.occurrence._table._name}.{self.label}"

    def column(self, env: Env) -> Column:
        return env(self.occurrence, self.label)

    def _literal(self, value: Any) -> Callable[[Env], Column]:
        from pyspark.sql.types import NumericType

        if isinstance(value, (int, float)) and not isinstance(value, bool) and isinstance(self.dtype, NumericType):
            return lambda env: F.lit(value)  # Spark widens; a cast could lose a fraction
        stored = self.field.codec.put(value)
        return lambda env: F.lit(stored).cast(self.dtype)


class Path(Operand):
    """The text at a path of a JSON field."""

    def __init__(self, of: Operand, path: str):
        self.of, self.path, self.needs, self.outside = of, path, of.needs, of.outside

    def column(self, env: Env) -> Column:
        return jsons.path_text(self.of.column(env), self.path)


class Outer(Operand):
    """A field of an enclosing query, inside a subquery."""

    outside = True

    def __init__(self, ref: Ref):
        self.ref, self.dtype = ref, ref.dtype

    def column(self, env: Env) -> Column:
        return env.outer(self.ref.occurrence, self.ref.label)


def outer(ref: Ref) -> Outer:
    return Outer(ref)


def raw(sql: str, **values: Any) -> Predicate:
    """SQL text as a condition; ``:name`` stands for a bound value, never for text."""
    import re

    def build(env: Env) -> Column:
        parts = re.split(r"('(?:[^']|'')*'|(?<!:):[A-Za-z_]\w*)", sql)
        # each value becomes a typed literal of Spark's own making
        text = "".join(env.literal(values[p[1:]]) if p.startswith(":") else p for p in parts)
        return F.expr(text)

    missing = [n for n in re.findall(r"(?<!:):([A-Za-z_]\w*)", re.sub(r"'(?:[^']|'')*'", "", sql)) if n not in values]
    return Predicate(build, tuple(f"no value for :{n}" for n in missing))


def exists(query: Any) -> Predicate:
    """Some row of the query exists; it may name fields of the enclosing query by ``outer``.

    Where no condition equates one of these with a field of the query by ``==``, rows may have to be held against all rows: tasks share these
    pairs, and a table that isn't small travels to each of them.
    """
    from .query import Query

    tested = dataclasses.replace(query, tested=True) if isinstance(query, Query) else query
    return Predicate(lambda env: env.subquery(tested).exists(), query.all_issues())


@dataclasses.dataclass(frozen=True, eq=False)
class Aggregate:
    """An aggregate of a field, or of whole rows; ``or_else`` gives its value where there is nothing to aggregate."""

    make: Callable[[Env], Column]
    needs: tuple = ()

    def or_else(self, value: Any) -> Aggregate:
        return Aggregate(lambda env: F.coalesce(self.make(env), F.lit(value)), self.needs)


def _aggregate(function: Callable[[Column], Column]) -> Callable[[Operand], Aggregate]:
    return lambda of: Aggregate(lambda env: function(of.column(env)), of.needs)


max_of, min_of, sum_of, avg_of = (_aggregate(f) for f in (F.max, F.min, F.sum, F.avg))
count_of, count_distinct_of, approx_distinct_of = (_aggregate(f) for f in (F.count, F.countDistinct, F.approx_count_distinct))
count_all = Aggregate(lambda env: F.count("*"))
