"""The query builder. Queries are immutable; they lower to DataFrames in the order of SQL's clauses.

A query starts as a Builder and becomes Ready by a condition, a limit, a seek or an explicit ``all()``: only Ready ones run.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..errors import InvalidStatement
from .expr import Aggregate, Operand, Predicate, Ref, Seek, Sort
from .schema import Occurrence, Table, identifier

JOINS = ("inner", "left", "right", "full", "cross", "left_semi", "left_anti")

#: Rows of one key that a merge join holds before they may spill, unless the session says otherwise; Spark's own default is no bound.
HELD = ("spark.sql.sortMergeJoinExec.buffer.in.memory.threshold", "4096")


@dataclasses.dataclass(frozen=True, eq=False)
class Derived:
    """A query that stands for a table, under an alias; its columns are reached as attributes."""

    query: Query
    alias: str

    @property
    def _alias(self) -> str:
        return self.alias

    def __getattr__(self, label: str) -> Operand:
        if label.startswith("__"):
            raise AttributeError(label)
        return _DerivedRef(self, label)


class _DerivedRef(Operand):
    def __init__(self, of: Derived, label: str):
        self.occurrence, self.label, self.needs = of, label, (of,)

    def __repr__(self) -> str:
        return f"{self.occurrence.alias}.{self.label}"

    def column(self, env: Any) -> Column:
        return env(self.occurrence, self.label)


@dataclasses.dataclass(frozen=True)
class Join:
    source: Any
    how: str
    on: Predicate | None


class Scope:
    """Gives the columns of a query's sources, and of the queries around it."""

    def __init__(self, db: Any, names: dict[int, str], by_table: dict[type, list[str]], around: Scope | None):
        self.db, self.names, self.by_table, self.around = db, names, by_table, around
        self.outers: dict[tuple[int, str], Column] = {}  # what it has named of the enclosing query

    def alias(self, source: Any) -> str:
        if (found := self.names.get(id(source))) is not None:
            return found
        table = getattr(source, "_table", None)
        if table is not None and source._alias is None and len(own := self.by_table.get(table, [])) == 1:
            return own[0]
        if table is not None and len(self.by_table.get(table, [])) > 1:
            raise ValueError(f"{table._name} comes more than once; name its occurrences by as_()")
        raise ValueError(f"{source!r} is not part of the query")

    def __call__(self, source: Any, label: str) -> Column:
        return F.col(f"`{self.alias(source)}`.`{label}`")

    def outer(self, source: Any, label: str) -> Column:
        if self.around is None:
            raise ValueError("outer() needs an enclosing query")
        return self.outers.setdefault((id(source), label), self.around(source, label).outer())

    def subquery(self, query: Query) -> DataFrame:
        return query.lower(self.db, self)

    def literal(self, value: Any) -> str:
        return self.db.literal(value)


class _Outputs:
    """Gives the columns of a distinct query's result, which its sorts are made of."""

    def __init__(self, scope: Scope, names: dict[tuple[str, str], str]):
        self.scope, self.names = scope, names

    def __call__(self, source: Any, label: str) -> Column:
        if (name := self.names.get((self.scope.alias(source), label))) is None:
            raise InvalidStatement([f"a distinct query is sorted by what it selects, not by {label}"])
        return F.col(f"`{name}`")


def _unambiguous(columns: list[tuple[str, str]]) -> list[str]:
    seen: dict[str, int] = {}
    for _, label in columns:
        seen[label.lower()] = seen.get(label.lower(), 0) + 1
    return [c if seen[c.lower()] == 1 else f"{a}__{c}" for a, c in columns]


class _SetOperations:
    """Queries of equally many columns put together; what comes out is named as the first."""

    def union(self, other: Any) -> Combined:
        return Combined(self, other, "union")

    def union_all(self, other: Any) -> Combined:
        return Combined(self, other, "unionAll")

    def intersect(self, other: Any) -> Combined:
        return Combined(self, other, "intersect")

    def except_(self, other: Any) -> Combined:
        return Combined(self, other, "exceptDistinct")


@dataclasses.dataclass(frozen=True, eq=False)
class Query(_SetOperations):
    source: Any
    joins: tuple[Join, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    sorts: tuple[Sort, ...] = ()
    seeks: tuple[Seek, ...] = ()
    most: int | None = None
    skip: int | None = None
    columns: tuple[Any, ...] | None = None
    result: type[Table] | None = None
    unique: bool = False
    tested: bool = False  # only whether it has rows counts

    # what makes a query ready

    def where(self, predicate: Predicate | Callable[..., Predicate]) -> Ready:
        """One more condition, which all must hold."""
        return self._with(Ready, predicates=self.predicates + (predicate,))

    def limit(self, n: int) -> Ready:
        if n < 0:
            raise ValueError("a limit is not negative")
        return self._with(Ready, most=n)

    def seek(self, seek: Seek) -> Ready:
        """Rows beyond a place; the sort that goes with it comes after explicit ones."""
        return self._with(Ready, seeks=self.seeks + (seek,))

    def seek_after(self, ref: Operand, value: Any) -> Ready:
        return self.seek(ref.after(value))

    def seek_before(self, ref: Operand, value: Any) -> Ready:
        return self.seek(ref.before(value))

    def all(self) -> Ready:
        """All rows, on purpose."""
        return self._with(Ready)

    # what doesn't

    def join(self, source: Any, on: Predicate | None = None, how: str = "inner") -> Query:
        """Another table, occurrence or derived query; ``on`` may compare with any source so far by any condition."""
        if how not in JOINS or (on is None) != (how == "cross"):
            raise ValueError("a join is one of " + ", ".join(JOINS) + ", and only a cross join has no condition")
        return self._with(type(self), joins=self.joins + (Join(_source(source), how, on),))

    def left_join(self, source: Any, on: Predicate) -> Query:
        return self.join(source, on, "left")

    def right_join(self, source: Any, on: Predicate) -> Query:
        return self.join(source, on, "right")

    def full_join(self, source: Any, on: Predicate) -> Query:
        return self.join(source, on, "full")

    def cross_join(self, source: Any) -> Query:
        return self.join(source, None, "cross")

    def order_by(self, *sorts: Sort | Operand) -> Query:
        return self._with(type(self), sorts=self.sorts + tuple(s if isinstance(s, Sort) else Sort(s) for s in sorts))

    def offset(self, n: int) -> Query:
        """Rows to skip before the limit, whichever is called first; kept on a Builder, which it doesn't make ready."""
        if n < 0:
            raise ValueError("an offset is not negative")
        return self._with(type(self), skip=n)

    def select(self, *columns: Any, **named: Any) -> Query:
        """Fields under their labels; by name, any field, Column or function of the scope."""
        return self._with(type(self), columns=columns + tuple(_Named(k, v) for k, v in named.items()), result=None)

    def select_all(self, result: type[Table]) -> Query:
        """All columns of a declared result, which the query must have."""
        return self._with(type(self), columns=None, result=result)

    def distinct(self) -> Query:
        return self._with(type(self), unique=True)

    def as_table(self, alias: str) -> Derived:
        return Derived(self, identifier(alias))

    def _with(self, kind: type[Query], **changes: Any) -> Any:
        return kind(**{f.name: getattr(self, f.name) for f in dataclasses.fields(self)} | changes)

    # what it is made of

    def all_issues(self) -> tuple[str, ...]:
        """Issues of the query and of all queries within it."""
        out = [i for p in self.predicates for i in p.issues] + [i for j in self.joins if j.on is not None for i in j.on.issues]
        for s in (self.source, *(j.source for j in self.joins)):
            out += s.query.all_issues() if isinstance(s, Derived) else ()
        return tuple(out)

    def validate(self) -> None:
        if issues := self.all_issues():
            raise InvalidStatement(list(issues), repr(self))

    def single_type(self) -> DataType | None:
        """The type of the one selected column, as far as it is declared."""
        if self.columns is None or len(self.columns) != 1:
            raise TypeError("the query within IN selects exactly one column")
        c = self.columns[0]
        return c.dtype if isinstance(c, Ref) else None

    def _scope(self, db: Any, around: Scope | None) -> tuple[Scope, list[tuple[Any, str]]]:
        counts: dict[str, int] = {}
        placed, names, by_table = [], {}, {}
        for s in (self.source, *(j.source for j in self.joins)):
            if s._alias:
                alias = s._alias
            else:
                bare = re.sub(r"\W", "_", s._table._name.rsplit(".", 1)[-1])
                counts[bare] = counts.get(bare, 0) + 1
                alias = f"{bare}_ref_{counts[bare]}"
            if alias in names.values():
                raise ValueError(f"the alias {alias} is taken")
            placed.append((s, alias))
            names[id(s)] = alias
            if isinstance(s, Occurrence):
                by_table.setdefault(s._table, []).append(alias)
        return Scope(db, names, by_table, around), placed

    def _rows(self, db: Any, around: Scope | None) -> tuple[DataFrame, Scope, list[tuple[str, str]]]:
        """FROM, JOIN and WHERE; and each column's alias and label."""
        scope, placed = self._scope(db, around)
        frames = [(s.query.lower(db, around) if isinstance(s, Derived) else db.table(s._table)).alias(a) for s, a in placed]
        df, predicates = frames[0], [p for p in (*self.predicates, *(s.predicate() for s in self.seeks)) if p is not None]
        columns = [(placed[0][1], c) for c in frames[0].columns]
        for j, frame, (_, alias) in zip(self.joins, frames[1:], placed[1:]):
            df = df.crossJoin(frame) if j.how == "cross" else df.join(frame, j.on.build(scope), j.how)
            if j.how not in ("left_semi", "left_anti"):
                columns += [(alias, c) for c in frame.columns]
        conditions = [p.build(scope) for p in predicates]
        if self.tested and scope.outers and self.most is None and not self.skip and not any(p.keyed for p in predicates):
            n = db.spark.sparkContext.defaultParallelism
            if self.joins or isinstance(self.source, Derived) or not _little(db.spark, frames[0], n):
                df, own = _spread(db.spark, df, list(scope.outers.values()), n)
                conditions.append(own)
        for c in conditions:
            df = df.where(c)
        return df, scope, columns

    def lower(self, db: Any, around: Scope | None = None) -> DataFrame:
        """The DataFrame of the query."""
        self.validate()
        df, scope, columns = self._rows(db, around)
        outputs = self._outputs(scope, columns)
        sorts = [] if self.unique else [s.column(scope) for s in (*self.sorts, *(s.order() for s in self.seeks))]
        if self.unique:
            out = _Outputs(scope, self._output_names(scope, columns))
            df, sorts = df.select(*outputs).distinct(), [s.column(out) for s in (*self.sorts, *(s.order() for s in self.seeks))]
        if sorts:
            df = df.orderBy(*sorts)
        if self.skip:
            df = df.offset(self.skip)
        if self.most is not None:
            df = df.limit(self.most)
        return df if self.unique else df.select(*outputs)

    def _output_names(self, scope: Scope, columns: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
        """What each source's columns are called in the result, as far as they are in it."""
        if self.result is not None:
            labels = {f.label.lower(): f.label for f in self.result._fields.values()}
            return {(a, c): labels[c.lower()] for a, c in reversed(columns) if c.lower() in labels}
        if self.columns is None:
            return {(a, c): out for (a, c), out in zip(columns, _unambiguous(columns))}
        out = {}
        for c in map(_named, self.columns):
            of = c.what if isinstance(c, _Named) else c
            if hasattr(of, "occurrence"):
                out[scope.alias(of.occurrence), of.label] = c.label
        return out

    def _outputs(self, scope: Scope, columns: list[tuple[str, str]]) -> list[Column]:
        if self.result is not None:
            have = {label.lower(): (alias, label) for alias, label in reversed(columns)}
            missing = [f.label for f in self.result._fields.values() if f.label.lower() not in have]
            if missing:
                raise TypeError(f"the query has no {', '.join(missing)}")
            return [F.col("`{}`.`{}`".format(*have[f.label.lower()])).alias(f.label) for f in self.result._fields.values()]
        if self.columns is None:
            return [F.col(f"`{a}`.`{c}`").alias(out) for (a, c), out in zip(columns, _unambiguous(columns))]
        return [c.column(scope).alias(c.label) for c in map(_named, self.columns)]

    # aggregates: conditions and joins count, sorts don't, limits and seeks are refused

    def aggregate(self, **named: Aggregate) -> Grouped:
        return Grouped(self, (), named)

    def group_by(self, *by: Operand) -> Grouping:
        return Grouping(self, by)


class Ready(Query):
    """A query that may run."""


def _little(spark: SparkSession, rows: DataFrame, copies: int) -> bool:
    """Whether Spark would broadcast so many copies of a table together, by its own estimate. Streams can't be copied."""
    if rows.isStreaming:
        return True
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size * copies <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def _spread(spark: SparkSession, rows: DataFrame, outers: list[Column], n: int) -> tuple[DataFrame, Column]:
    """The rows of an EXISTS without an equality, once in each of ``n`` shards, and the condition that an enclosing row looks into one.

    Without a key Spark gathers all rows in the driver and broadcasts them, whatever their size. By the shard they meet in a merge join: each
    task holds its share of the enclosing rows, dealt by the fields ``outers``, against all of these, which may spill. A shuffle moves ``n`` copies.
    """
    if spark.conf.get(HELD[0], None) is None:
        spark.conf.set(*HELD)
    shards = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_tessera_shard")
    return rows.select("*", shards).hint("merge"), F.col("_tessera_shard") == F.pmod(F.xxhash64(*outers), F.lit(n))


class _Named(Operand):
    def __init__(self, label: str, what: Any):
        self.label, self.what = label, what

    def column(self, env: Any) -> Column:
        w = self.what
        return w.column(env) if isinstance(w, Operand) else w.build(env) if isinstance(w, Predicate) else w(env) if callable(w) and not isinstance(w, Column) else w


def _named(c: Any) -> Any:
    return c if isinstance(c, Operand) else _Named("value", c)


@dataclasses.dataclass(frozen=True, eq=False)
class Combined(_SetOperations):
    left: Any
    right: Any
    how: str

    def all_issues(self) -> tuple[str, ...]:
        return self.left.all_issues() + self.right.all_issues()

    def validate(self) -> None:
        if issues := self.all_issues():
            raise InvalidStatement(list(issues), repr(self))

    def lower(self, db: Any, around: Scope | None = None) -> DataFrame:
        self.validate()
        a, b = self.left.lower(db, around), self.right.lower(db, around)
        if len(a.columns) != len(b.columns):
            raise InvalidStatement([f"{len(a.columns)} columns against {len(b.columns)}"])
        if self.how == "exceptDistinct":
            return a.subtract(b)
        return a.intersect(b) if self.how == "intersect" else a.unionAll(b) if self.how == "unionAll" else a.unionAll(b).distinct()

    def single_type(self) -> DataType | None:
        return self.left.single_type()

    def as_table(self, alias: str) -> Derived:
        return Derived(self, identifier(alias))


@dataclasses.dataclass(frozen=True, eq=False)
class Grouping:
    """Groups by fields; ``rollup`` and ``cube`` add the totals of fewer of them, in which the others are null."""

    query: Query
    by: tuple[Operand, ...]
    how: str = "groupBy"

    def rollup(self) -> Grouping:
        return dataclasses.replace(self, how="rollup")

    def cube(self) -> Grouping:
        return dataclasses.replace(self, how="cube")

    def agg(self, **named: Aggregate) -> Grouped:
        return Grouped(self.query, self.by, named, how=self.how)


@dataclasses.dataclass(frozen=True, eq=False)
class Grouped:
    """Aggregates of a query's rows, by groups or all together."""

    query: Query
    by: tuple[Operand, ...]
    named: dict[str, Aggregate]
    having_: Callable[[DataFrame], Column] | None = None
    how: str = "groupBy"

    def having(self, condition: Callable[[DataFrame], Column]) -> Grouped:
        """A condition on the result's columns."""
        return dataclasses.replace(self, having_=condition)

    def all_issues(self) -> tuple[str, ...]:
        return self.query.all_issues()

    def validate(self) -> None:
        q = self.query
        q.validate()
        if q.most is not None or q.skip or q.seeks:
            raise InvalidStatement(["an aggregate takes no limit, offset or seek; aggregate over the query as a table"])

    def lower(self, db: Any, around: Scope | None = None) -> DataFrame:
        self.validate()
        df, scope, _ = self.query._rows(db, around)
        made = [a.make(scope).alias(k) for k, a in self.named.items()]
        out = getattr(df, self.how)(*[b.column(scope).alias(b.label) for b in self.by]).agg(*made) if self.by else df.agg(*made)
        return out.where(self.having_(out)) if self.having_ else out

    def single_type(self) -> None:
        if len(self.by) + len(self.named) != 1:
            raise TypeError("the query within IN selects exactly one column")

    def as_table(self, alias: str) -> Derived:
        return Derived(self, identifier(alias))


def over(function: Column | Callable[[Scope], Column], partition_by: list[Operand], order_by: list[Sort]) -> Callable[[Scope], Column]:
    """A value for ``select``: a window function (``F.rank()``, or of fields: ``lambda env: F.lag(T.x.column(env))``) over partitions in an order."""

    def make(env: Scope) -> Column:
        window = Window.partitionBy(*[p.column(env) for p in partition_by]).orderBy(*[s.column(env) for s in order_by])
        return (function if isinstance(function, Column) else function(env)).over(window)

    return make


def row_number(partition_by: list[Operand], order_by: list[Sort]) -> Callable[[Scope], Column]:
    """A value for ``select``: the rows of each partition numbered in order, from 1."""
    return over(lambda env: F.row_number(), partition_by, order_by)


class _Scalar(Operand):
    def __init__(self, query: Any):
        self.query, self.dtype = query, query.single_type()

    def column(self, env: Scope) -> Column:
        return env.subquery(self.query).scalar()


def scalar(query: Any) -> Operand:
    """The one value of a query with one column, to be compared or selected; null if it has no row, an error if it has several."""
    return _Scalar(query)


def _source(source: Any) -> Any:
    return Occurrence(source) if isinstance(source, type) and issubclass(source, Table) else source


def query(source: type[Table] | Occurrence | Derived) -> Query:
    """A query over a table, an occurrence of one, or a derived query."""
    return Query(_source(source))
