"""Sources of tables by name, and the database handle that runs statements over one."""

from __future__ import annotations

import dataclasses
from typing import Any, Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Source(Protocol):
    """``describe`` gives a table's columns and its rules (None: the source knows of none), or None if there is no such table."""

    def read(self, spark: SparkSession, name: str) -> DataFrame: ...

    def describe(self, spark: SparkSession, name: str) -> tuple[StructType, dict[str, Any] | None] | None: ...


class _Plain:
    """Sources that know columns and types only."""

    def describe(self, spark: SparkSession, name: str) -> tuple[StructType, None] | None:
        try:
            return self.read(spark, name).schema, None
        except (AnalysisException, KeyError):
            return None


@dataclasses.dataclass(frozen=True)
class Files(_Plain):
    """A folder with a file or folder per table, in any format that Spark reads: parquet, orc, csv, json, avro."""

    root: str
    format: str = "parquet"
    options: dict[str, str] = dataclasses.field(default_factory=dict)
    schemas: dict[str, Any] = dataclasses.field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.load(f"{self.root}/{name.rsplit('.', 1)[-1]}.{self.format}")


class Catalog(_Plain):
    """Tables and views of the session, by their names, each dotted part quoted."""

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.table(".".join("`" + p.replace("`", "``") + "`" for p in name.split(".")))


@dataclasses.dataclass(frozen=True)
class Jdbc:
    """Tables of a database, read in ``partitions`` ranges of a numeric column where one is named; conditions and column choices are pushed to it."""

    url: str
    properties: dict[str, str] = dataclasses.field(default_factory=dict)
    ranges: dict[str, tuple[str, int, int, int]] = dataclasses.field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if name in self.ranges:
            column, low, high, n = self.ranges[name]
            return spark.read.jdbc(self.url, name, column=column, lowerBound=low, upperBound=high, numPartitions=n, properties=self.properties)
        return spark.read.jdbc(self.url, name, properties=self.properties)

    def describe(self, spark: SparkSession, name: str) -> tuple[StructType, dict[str, Any]] | None:
        """Columns by Spark's types; keys, nullability, indexes and foreign keys from the database's catalog. Conditions of partial indexes aren't in it."""
        properties = spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        if driver := self.properties.get("driver"):
            spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
        held = spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            meta = held.getMetaData()
            case = str.upper if meta.storesUpperCaseIdentifiers() else str.lower if meta.storesLowerCaseIdentifiers() else str
            *schema, table = map(case, name.split("."))
            at = (held.getCatalog(), schema[-1] if schema else held.getSchema(), table)
            columns = _listed(meta.getColumns(*at, None), "COLUMN_NAME", "IS_NULLABLE")
            if not columns:
                return None
            keys = sorted(_listed(meta.getPrimaryKeys(*at), "KEY_SEQ", "COLUMN_NAME"), key=lambda r: int(r[0]))
            indexes: dict[str, dict[str, Any]] = {}
            for own, twice, column, _ in sorted(_listed(meta.getIndexInfo(*at, False, True), "INDEX_NAME", "NON_UNIQUE", "COLUMN_NAME", "ORDINAL_POSITION"), key=lambda r: int(r[3] or 0)):
                if own and column:
                    indexes.setdefault(own, {"name": own, "columns": [], "unique": twice.lower() in ("false", "0"), "where": None})["columns"].append(column)
            references: dict[str, dict[str, Any]] = {}
            for own, column, to, there, _ in sorted(_listed(meta.getImportedKeys(*at), "FK_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME", "KEY_SEQ"), key=lambda r: int(r[4])):
                one = references.setdefault(own, {"name": own, "columns": [], "target": to, "target_columns": []})
                one["columns"].append(column)
                one["target_columns"].append(there)
        finally:
            held.close()
        rules = {
            "not_null": [c for c, null in columns if null == "NO"],
            "key": [c for _, c in keys],
            "indexes": list(indexes.values()),
            "uniques": [i for i in indexes.values() if i["unique"]],
            "foreign_keys": list(references.values()),
            "partial_indexes": False,
        }
        return self.read(spark, name).schema, rules


def _listed(found: Any, *columns: str) -> list[tuple[str, ...]]:
    """The rows of a result of the database's catalog, as text."""
    out = []
    while found.next():
        out.append(tuple(found.getString(c) for c in columns))
    found.close()
    return out


@dataclasses.dataclass(frozen=True)
class Frames(_Plain):
    """DataFrames by name: batch or streaming ones."""

    frames: dict[str, DataFrame]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.frames[name]


@dataclasses.dataclass(frozen=True)
class Stream(_Plain):
    """A folder of files per table, read as a stream; needs the tables' declared schemas."""

    root: str
    schemas: dict[str, Any]
    format: str = "parquet"
    options: dict[str, str] = dataclasses.field(default_factory=dict)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.readStream.format(self.format).schema(self.schemas[name]).options(**self.options).load(f"{self.root}/{name}")
