"""Lazy results: rows pulled one by one, and keyset pages that can be taken up again at a cursor."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from typing import Any

from ..errors import InvalidStatement
from ..plans.expr import Operand
from ..plans.query import Query


@dataclasses.dataclass(frozen=True)
class Page:
    """``cursor`` is the last row's key; the next page starts after it."""

    items: list[Any]
    cursor: Any
    number: int


class Rows:
    """An iterator over rows that fetches a partition at a time; closing it, or leaving its ``with`` block, lets go of the rest."""

    def __init__(self, rows: Iterator[Any], decode: Callable[[Any], Any] = lambda r: r):
        self._rows, self._decode = rows, decode

    def __iter__(self) -> Iterator[Any]:
        return self

    def __next__(self) -> Any:
        if self._rows is None:
            raise StopIteration
        return self._decode(next(self._rows))

    def close(self) -> None:
        close, self._rows = getattr(self._rows, "close", None), None
        if close:
            close()

    def __enter__(self) -> Rows:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


def pages(db: Any, query: Query, key: Operand, size: int, after: Any = None, into: type | None = None) -> Iterator[Page]:
    """Pages of ``size`` rows by ascending ``key``, which should be unique and not null: a null key can only come on a first page.

    The query's own limit gives way to the page's; an offset is refused. The end is a page shorter than ``size``; an exact multiple costs one
    more fetch, which makes no page. Each page is a job of its own, so that nothing is held between pages.
    """
    if query.skip:
        raise InvalidStatement(["pages take no offset"])
    if size < 1:
        raise ValueError("a page has at least one row")
    label, number = getattr(key, "label"), 0
    while True:
        part = query.seek_after(key, after) if after is not None else query.order_by(key.asc())
        rows = db.rows(part.limit(size))
        if not rows:
            return
        after = rows[-1][label]
        number += 1
        yield Page([into.decode(r) for r in rows] if into else rows, after, number)
        if len(rows) < size:
            return


def items(found: Iterator[Page], checkpoint: Callable[[Any], None] | None = None) -> Iterator[Any]:
    """The pages' rows; ``checkpoint`` is told each page's cursor once its rows have been taken."""
    for page in found:
        yield from page.items
        if checkpoint:
            checkpoint(page.cursor)
