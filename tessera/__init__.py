"""Typed relational queries that lower to Spark DataFrames.

    class Users(Table, name="users"):
        id: int = column(key=True)
        name: str

    db = Database(spark, Files("/data"))
    db.all(query(Users).where(Users.name.like("A%")).order_by(Users.id).limit(10))
"""

from .database import Database
from .functions.codecs import Codec, Dec, Float, Int, Json, Short, Text, Url
from .operators import ddl
from .operators.mutations import Delete, Insert, Update, Upsert, excluded
from .plans.expr import approx_distinct_of, avg_of, count_all, count_distinct_of, count_of, exists, max_of, min_of, outer, raw, sum_of
from .plans.query import over, query, row_number, scalar
from .plans.schema import Table, column, foreign_key, index, unique
from .sources.store import Store
from .sources.tables import Catalog, Files, Frames, Jdbc, Stream
from .sqltext import Fragment, ident, sql, unsafe, value_list
from .streaming.results import items

__all__ = [n for n in dir() if not n.startswith("_")]
