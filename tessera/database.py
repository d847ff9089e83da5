"""The handle that statements run on: a session, a source of tables, and the rules of running."""

from __future__ import annotations

import contextlib
import contextvars
import itertools
import logging
import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import DecodingFailure, InvalidStatement, ReturnedNothing, StatementTimeout, Unsupported, classify, is_retryable
from .operators.mutations import Delete, Insert, Update
from .operators.rawdml import RawChange, is_change
from .plans.query import Query, query
from .plans.schema import Table
from .sources.store import Store
from .sources.tables import Source
from .sqltext import Fragment, literal
from .streaming.results import Page, Rows, pages

log = logging.getLogger("tessera")
_limit: contextvars.ContextVar[float | None] = contextvars.ContextVar("statement_timeout", default=None)


class Database:
    """``source`` gives tables by name; a Store also takes changes. ``tables`` are the declared ones among which foreign keys act.

    ``timeout``: seconds a statement may take unless a scope says otherwise; whole seconds, rounded up. ``most_at_once``: statements that run
    at a time. ``echo``: log each statement's plan.
    """

    def __init__(self, spark: SparkSession, source: Source | Store, tables: list[type[Table]] | None = None, timeout: float | None = None, most_at_once: int | None = None, retryable: Callable[[BaseException], bool] = is_retryable, conf: dict[str, str] | None = None, echo: bool = False):
        self.spark, self.source, self.tables = spark, source, list(tables or [])
        self.timeout, self.retryable, self.conf, self.echo = timeout, retryable, conf or {}, echo
        self._permits = threading.BoundedSemaphore(most_at_once) if most_at_once else contextlib.nullcontext()

    @property
    def store(self) -> Store:
        if not isinstance(self.source, Store):
            raise Unsupported("changes need a Store as source")
        return self.source

    def table(self, table: type[Table]) -> DataFrame:
        """A table's declared columns."""
        df = self.source.read(self.spark, table._name)
        return df.select(*[df[f"`{f.label}`"].alias(f.label) for f in table._fields.values()])

    def literal(self, value: Any) -> str:
        return literal(value)

    def df(self, statement: Any) -> DataFrame:
        """The DataFrame of a query, an aggregate or raw SQL; nothing runs yet."""
        try:
            if type(statement) is Query:
                raise TypeError("say where(...), limit(...), seek(...) or all() first")
            out = statement.lower(self)
        except Exception as e:
            raise (classify(e, repr(statement), self.retryable) if not isinstance(e, (TypeError, ValueError)) else e) from e
        if self.echo:
            log.info("%s", out._jdf.queryExecution().toString())
        return out

    # results

    def rows(self, statement: Any) -> list[Any]:
        """All rows as Spark gives them."""
        df = self.df(statement)
        return self._run(df.collect, statement)

    def all(self, statement: Any, into: type[Table] | None = None) -> list[Any]:
        return [self._decoded(r, into) for r in self.rows(statement)]

    def one(self, statement: Any, into: type[Table] | None = None) -> Any | None:
        """The first row or None; further rows are no fault."""
        df = self.df(statement)
        rows = self._run(lambda: df.limit(1).collect(), statement)
        return self._decoded(rows[0], into) if rows else None

    def value(self, statement: Any) -> Any | None:
        """The first column of the first row; None if there is no row."""
        row = self.one(statement)
        return None if row is None else row[0]

    def tuples(self, statement: Any, size: int) -> list[tuple]:
        df = self.df(statement)
        if len(df.columns) != size:
            raise DecodingFailure(f"{len(df.columns)} columns, not {size}", repr(statement))
        return [tuple(r) for r in self._run(df.collect, statement)]

    def stream(self, statement: Any, into: type[Table] | None = None) -> Rows:
        """Rows as they are asked for; Spark keeps one partition at a time on the driver.

        From the first row to the last, or until it is closed, a stream is one statement: its time counts, and it takes up a permit.
        """
        return Rows(self._pulled(self.df(statement), statement), lambda r: self._decoded(r, into))

    def pages(self, q: Query, key: Any, size: int, after: Any = None, into: type[Table] | None = None) -> Iterator[Page]:
        return pages(self, q, key, size, after, into)

    def seeking(self, q: Query, key: Any, size: int, after: Any = None, into: type[Table] | None = None) -> Iterator[Any]:
        return itertools.chain.from_iterable(p.items for p in self.pages(q, key, size, after, into))

    def by_key(self, table: type[Table], *key: Any) -> Any | None:
        keys = table.keys()
        if len(key) != len(keys) or not keys:
            raise TypeError(f"{table.__name__} has a key of {len(keys)}")
        q = query(table)
        for f, v in zip(keys, key):
            q = q.where(getattr(table, f.name) == v)
        return self.one(q, table)

    def _decoded(self, row: Any, into: type[Table] | None) -> Any:
        if into is None:
            return row
        try:
            return into.decode(row)
        except Exception as e:
            raise DecodingFailure(f"{row} is no {into.__name__}: {e}", cause=e) from e

    # changes

    def execute(self, change: Any) -> int:
        """Makes a change; the number of rows it affected."""
        return self._run(lambda: self._changed(change).count(), change)

    def returning(self, change: Any, into: type[Table] | None = None) -> list[Any]:
        """Makes a change; the rows it inserted, changed or removed, as they are now or were last."""
        return [self._decoded(r, into) for r in self._run(lambda: self._changed(change).collect(), change)]

    def returning_one(self, change: Any, into: type[Table] | None = None) -> Any:
        rows = self.returning(change, into)
        if not rows:
            raise ReturnedNothing("the change affected no row", repr(change))
        return rows[0]

    def _changed(self, change: Any) -> DataFrame:
        """A statement of several tables' changes (foreign keys) takes effect whole or not at all. Raw statements are changes too."""
        if isinstance(change, Fragment):
            if not is_change(change):
                raise InvalidStatement(["raw SQL that changes a table begins with insert, update, delete, truncate, create table or drop table"])
            change = RawChange(change)
        if self.store.staged is not None:
            return change.run(self)
        with self.transaction():
            return change.run(self)

    def insert(self, *rows: Table) -> list[Table]:
        return self.returning(Insert(type(rows[0])).from_rows(*rows), type(rows[0]))

    def update(self, row: Table) -> int:
        return self.execute(Update.row(row))

    def delete(self, row: Table) -> int:
        return self.execute(Delete.row(row))

    @contextlib.contextmanager
    def transaction(self) -> Iterator[Database]:
        """All changes within, or none; reads within see them."""
        self.store.begin()
        try:
            yield self
        except BaseException:
            self.store.rollback()
            raise
        self.store.commit()

    # rules of running

    @contextlib.contextmanager
    def within(self, seconds: float | None) -> Iterator[None]:
        """A time limit for the statements in the block; None takes it away."""
        token = _limit.set(math.inf if seconds is None else seconds)
        try:
            yield
        finally:
            _limit.reset(token)

    def _run(self, action: Callable[[], Any], statement: Any) -> Any:
        with self._limited(statement) as own, own():
            return action()

    def _pulled(self, df: DataFrame, statement: Any) -> Iterator[Any]:
        with self._limited(statement) as own:
            with own():  # the thread that serves the rows takes over the tag
                rows = df.toLocalIterator(prefetchPartitions=False)
            yield from rows

    @contextlib.contextmanager
    def _limited(self, statement: Any) -> Iterator[Callable[[], Any]]:
        """A permit and the time limit for a block, and its failures as typed ones. Jobs that may be stopped start in the context that it gives."""
        limit = _limit.get() if _limit.get() is not None else self.timeout
        limit = None if limit is None or math.isinf(limit) else max(1, math.ceil(limit))
        tag, sc, late, done = f"tessera-{uuid.uuid4().hex}", self.spark.sparkContext, threading.Event(), threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)
            while not done.wait(0.2):  # a job may start between two calls
                sc.cancelJobsWithTag(tag)

        @contextlib.contextmanager
        def own() -> Iterator[None]:
            old = {k: self.spark.conf.get(k, None) for k in self.conf}
            if limit:
                sc.addJobTag(tag)
            try:
                for k, v in self.conf.items():
                    self.spark.conf.set(k, v)
                yield
            finally:
                if limit:
                    sc.removeJobTag(tag)
                for k, v in old.items():
                    self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

        timer = threading.Timer(limit, stop) if limit else None
        with self._permits:
            try:
                if timer:
                    timer.daemon = True
                    timer.start()
                yield own
            except Exception as e:
                if late.is_set():
                    raise StatementTimeout(f"took more than {limit} s", repr(statement), "57014", e) from e
                raise classify(e, repr(statement), self.retryable) from e
            finally:
                done.set()
                if timer:
                    timer.cancel()

    def retrying(self, action: Callable[[], Any], times: int = 3, wait: float = 0.2) -> Any:
        """Tries an action again, after growing waits, as long as its failure is a retryable one."""
        for n in range(times):
            try:
                return action()
            except Exception as e:
                if n + 1 == times or not self.retryable(getattr(e, "cause", None) or e) and not self.retryable(e):
                    raise
                time.sleep(wait * 2**n)
