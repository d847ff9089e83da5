"""What the operators share: table access, word rules, Arrow batch limits and shared scratch tables."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that one Arrow batch may hold; long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES where they are higher.

    Results are lazy, so the limits stay lowered for the session: they must hold when a result is run, long after its operator returned.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name).rstrip("bB")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one stands in on a local master; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and can be dropped early.

    What a lazy result still reads can't be dropped with the operator's return; it goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        self.n = 0

    def _path(self, path: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        if self.n == 1:
            folder, at = self._path(self.root)
            folder.deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            folder, at = self._path(df.scratch_path)
            folder.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffle files of finished jobs now instead of at its next periodic turn, and gives memory of the driver back.

    Plans of many stages leave garbage for which the driver's heap grows, and compiled code leaves freed native memory with the allocator; both
    would otherwise stay with the process. Only disk and memory are saved by it: no result depends on it, and a collector or a JVM that doesn't heed it goes on as before.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> str | None:
    """Has the driver's JVM return freed native memory to the system; its answer, or none where it has no such command."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind: Any, *values: Any) -> Any:
        out = array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    lang = jvm.java.lang
    with contextlib.suppress(Py4JError):
        kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        # by the public interface: the server's own class is closed to reflection
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", filled(lang.Class, *map(lang.Class.forName, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), filled(lang.Object, commands, "systemTrimNativeHeap", None, None))
    return None


def few_files(df: DataFrame, rows: int, per_file: int) -> DataFrame:
    """For tables that are written round by round: about ``per_file`` rows a file, and no more files than shuffle partitions, of which most may be empty."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(min(most, max(8, -(-rows // per_file))))


def n_words(text: str | Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column | str, salt: str = "") -> Column:
    """A number in (0, 1) that depends on the values alone: 52 bits of an MD5."""
    key = F.concat_ws("\x1f", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in cols], F.lit(salt))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def column_batches(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """Each batch as Python lists of the named columns."""
    for b in batches:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that come sorted by ``keys``; a table has about ``rows`` rows or one group."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            last = np.ones(table.num_rows, bool)
            for k in keys:
                col = table[k].to_numpy()
                last &= col == col[-1]
            cut = int(np.argmax(last))
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held)
