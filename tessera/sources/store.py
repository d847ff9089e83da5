"""A table store on plain files: a table is a folder of parquet files and numbered manifests that say which of them are current.

Files are never changed. A change writes new files for what it touches, and a new manifest that lists them beside the files it
left alone; the manifest's number can be taken once only, so of two writers one fails and may try again. The manifests of a transaction over
several tables count once the transaction's verdict is there, a file that can be written once only as well. Old versions stay readable
until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import Retryable, SyntaxFailure


#: The verdicts on transactions, and the folder that holds them.
COMMITTED, ABORTED, TRANSACTIONS = "committed", "aborted", "_transactions"


def _manifest(name: str, number: int) -> str:
    return f"{name}/manifest-{number:012d}.json"


class _Folder:
    """Files by Hadoop paths: local, HDFS or an object store alike."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def age(self, name: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet, whole or not at all; False if it is."""
        draft = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(draft)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), none)
            return True
        except Py4JJavaError as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Version:
    """What a manifest says: the table's columns, its current files, and what its declaration demands."""

    def __init__(self, number: int, schema: StructType, files: list[str], rules: dict[str, Any]):
        self.number, self.schema, self.files, self.rules = number, schema, files, rules

    def text(self, transaction: str | None = None) -> str:
        return json.dumps({"schema": json.loads(self.schema.json()), "files": self.files, "rules": self.rules, "transaction": transaction})


class Store:
    """Tables under ``root``. Reads see the current versions, or those that an open transaction has staged."""

    def __init__(self, spark: SparkSession, root: str, patience: float = 60.0):
        self.spark, self.folder, self.patience = spark, _Folder(spark, root.rstrip("/")), patience
        self.staged: dict[str, Version | None] | None = None
        self.base: dict[str, int] = {}
        self.written: list[str] = []

    def current(self, name: str) -> Version | None:
        if self.staged is not None and name in self.staged:
            return self.staged[name]
        for number in self._numbers(name):
            held = json.loads(self.folder.read(_manifest(name, number)))
            if held["transaction"] is None or self._verdict(held["transaction"]) == COMMITTED:
                return Version(number, StructType.fromJson(held["schema"]), held["files"], held["rules"]) if held["files"] is not None else None
        return None

    def _numbers(self, name: str) -> list[int]:
        """The numbers of a table's manifests, the latest first."""
        return sorted((int(n[9:-5]) for n in self.folder.names(name) if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def _verdict(self, transaction: str) -> str | None:
        name = f"{TRANSACTIONS}/{transaction}.json"
        return self.folder.read(name) if self.folder.exists(name) else None

    def _settle(self, name: str) -> int:
        """The number after a table's last manifest. A transaction without a verdict that is ``patience`` seconds old is aborted; a younger one is in the way."""
        numbers = self._numbers(name)
        for number in numbers:
            transaction = json.loads(self.folder.read(_manifest(name, number)))["transaction"]
            verdict = transaction and self._verdict(transaction)
            if transaction and verdict is None:
                if self.folder.age(_manifest(name, number)) < self.patience:
                    raise Retryable(f"another writer is changing {name}", state="40001")
                self.folder.put_new(f"{TRANSACTIONS}/{transaction}.json", ABORTED)
            elif not transaction or verdict == COMMITTED:
                break
        return max(numbers, default=0) + 1

    def describe(self, spark: SparkSession, name: str) -> tuple[StructType, dict[str, Any]] | None:
        v = self.current(name)
        return None if v is None else (v.schema, v.rules)

    def need(self, name: str) -> Version:
        if (v := self.current(name)) is None:
            raise SyntaxFailure(f"there is no table {name}", state="42P01")
        return v

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.frame(self.need(name))

    def frame(self, version: Version, files: list[str] | None = None) -> DataFrame:
        files = version.files if files is None else files
        paths = [f"{self.folder.root}/{f}" for f in files]
        return self.spark.read.schema(version.schema).parquet(*paths) if paths else self.spark.createDataFrame([], version.schema)

    def touched(self, version: Version, rows: DataFrame) -> list[str]:
        """The files that rows of ``frame(version)`` come from."""
        if not version.files:
            return []
        found = {r[0] for r in rows.select(F.col("_metadata.file_name")).distinct().collect()}  # file names, not rows
        return [f for f in version.files if f.rsplit("/", 1)[-1] in found]

    def write(self, name: str, rows: DataFrame, schema: StructType) -> list[str]:
        """New files with the rows; they belong to no version yet."""
        at = f"{name}/data-{uuid.uuid4().hex}"
        self.written.append(at)
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.folder.root}/{at}")
        return [f"{at}/{n}" for n in self.folder.names(at) if n.endswith(".parquet")]

    def publish(self, name: str, schema: StructType, files: list[str] | None, rules: dict[str, Any]) -> None:
        """Makes a version current, at once or when the transaction ends; ``files`` None: the table is gone."""
        if self.staged is None:
            number = self._settle(name)
        elif (number := self.base.get(name)) is None:
            number = self.base[name] = self._settle(name)
        version = Version(number, schema, files, rules)
        if self.staged is not None:
            self.staged[name] = version if files is not None else None
            self._texts[name] = version
        elif not self.folder.put_new(_manifest(name, version.number), version.text()):
            raise Retryable(f"another writer changed {name}", state="40001")
        else:
            self.written.clear()

    # transactions

    def begin(self) -> None:
        if self.staged is not None:
            raise SyntaxFailure("transactions don't nest", state="25001")
        self.staged, self.base, self._texts = {}, {}, {}
        self.written.clear()

    def commit(self) -> None:
        """Publishes all staged tables at once: their manifests first, which nobody heeds before the verdict that follows."""
        texts, self.staged = self._texts, None
        transaction = uuid.uuid4().hex if len(texts) > 1 else None
        for name, version in texts.items():
            if not self.folder.put_new(_manifest(name, version.number), version.text(transaction)):
                if transaction:
                    self.folder.put_new(f"{TRANSACTIONS}/{transaction}.json", ABORTED)
                self.rollback()
                raise Retryable(f"another writer changed {name}", state="40001")
        if transaction and not self.folder.put_new(f"{TRANSACTIONS}/{transaction}.json", COMMITTED):
            self.rollback()
            raise Retryable("the transaction took too long and was taken back", state="40001")
        self.written.clear()

    def rollback(self) -> None:
        self.staged = None
        for at in self.written:
            self.folder.delete(at)
        self.written.clear()

    def vacuum(self, name: str, older: float = 3600.0) -> None:
        """Deletes the files and manifests of all versions but the current one that are ``older`` seconds old: younger ones may be some writer's or reader's."""
        v = self.need(name)
        keep = {f.split("/")[-2] for f in v.files} | {_manifest("", v.number)[1:]} | {w.split("/")[-1] for w in self.written}
        for n in self.folder.names(name):
            if n not in keep and self.folder.age(f"{name}/{n}") >= older:
                self.folder.delete(f"{name}/{n}")
