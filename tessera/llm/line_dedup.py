"""Line dedup over levelled sorted runs.

A run is a table of (line hash, number of documents that hold it, the largest of them), sorted by hash. Documents come in batches of
descending keys. A batch's hashes are merge-anti-joined with the runs: those that enough larger documents are known to hold are
settled, and leave. The rest becomes a run on level 0. When a level has ``fanout`` runs, they are merged into one run of the next
level. A hash that ends up with ``min_docs`` documents is one that so many hold; the largest was in the first batch that had it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, few_files, release

#: The characters stripped from a line, and the letters lower-cased in it.
BLANK, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """The levelled runs. ``add`` takes a batch of (h1, h2, doc) rows, with repeats; each batch's documents are smaller than those before.

    Where ``batch_rows``, the most rows of a batch, is given, a run has files by its rows rather than one for each shuffle partition: each file
    of each run is a task of every later batch.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, batch_rows: int | None = None):
        self.min_docs, self.fanout, self.batch_rows, self.scratch = min_docs, fanout, batch_rows, Scratch(spark)
        self.levels: list[list[DataFrame]] = []

    def _put(self, level: int, rows: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        if self.batch_rows is not None:
            rows = few_files(rows, self.batch_rows * self.fanout**level, 50_000)
        self.levels[level].append(self.scratch.save(rows.sortWithinPartitions(*HASH), f"level{level}"))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(merged))
            self.scratch.drop(*merged)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))

    def fresh(self, batch: DataFrame) -> DataFrame:
        """What a batch adds to the runs: each hash that isn't settled, with its documents in the batch counted.

        Documents are counted under (hash, document) before hashes meet, so a line that a third of all documents hold is no one task's.
        """
        rows = batch.groupBy(*HASH).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("keep"))
        if runs := [r for level in self.levels for r in level]:
            settled = reduce(DataFrame.unionByName, runs).where(F.col("n") >= self.min_docs).select(*HASH)
            rows = rows.join(settled.hint("merge"), list(HASH), "left_anti")
        return rows

    def add(self, batch: DataFrame) -> None:
        self._put(0, self.fresh(batch))
        release(self.scratch.spark)

    def repeated(self) -> DataFrame:
        """The hashes that at least ``min_docs`` documents hold: h1, h2 and ``keep``, the largest document."""
        return self._merged([r for level in self.levels for r in level]).where(F.col("n") >= self.min_docs).drop("n")


def _descending(doc: Column, cuts: list[int]) -> Column:
    """The batch of a document: 0 above the largest cut, one more for each cut that lies above it."""
    return reduce(lambda a, b: a + b, [(doc < c).cast("int") for c in cuts], F.lit(0))


def line_dedup(df: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row of ``df`` with ``n_lines`` (before dropping), ``n_dropped`` and ``kept``, the text that stays.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except in
    the largest document holding them. A null or empty text is one empty line and stays empty. Rows that repeat a
    ``key`` are one document; a null key is a document too, the smallest. An empty table gives an empty result.
    Columns of ``df`` that carry the result's names are replaced. Hashes have 128 bits. Batches are ranges of keys, cut at
    approximate quantiles, largest first. Only built-in functions run; nothing but the cuts and the rows of the largest batch, a number, is gathered on the driver.
    """
    spark = df.sparkSession
    doc = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    whole = F.coalesce(F.col(text), F.lit(""))
    scratch = Scratch(spark)
    cuts = df.select(doc.alias("doc")).agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [0.5], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    split = df.select(doc.alias("doc"), F.xxhash64(whole).alias("t"), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
    keyed = split.where(F.char_length("line") >= min_chars).withColumn("k", line_key(F.col("line"))).where(F.char_length("k") >= min_chars)
    hashes = F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2")
    lines = scratch.save(keyed.select("doc", "t", "pos", *hashes, _descending(F.col("doc"), cuts).alias("batch")), "lines", partition_by="batch")
    largest = lines.groupBy("batch").count().agg(F.max("count")).first()[0]
    release(spark)
    runs = LineRuns(spark, min_docs, batch_rows=largest or 0)
    for b in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == b))
    repeated = scratch.save(runs.repeated(), "repeated")
    release(spark)
    drops = lines.join(repeated, list(HASH)).where(F.col("doc") != F.col("keep")).groupBy("doc", "t").agg(F.collect_set("pos").alias("_ld_gone"))
    drops = drops.select(F.col("doc").alias("_ld_d"), F.col("t").alias("_ld_h"), "_ld_gone")
    rows = df.drop(*[c for c in df.columns if c in ("n_lines", "n_dropped", "kept")])
    names = rows.columns
    rows = rows.withColumn("_ld_doc", doc).withColumn("_ld_t", F.xxhash64(whole))
    rows = rows.join(drops, (F.col("_ld_doc") == F.col("_ld_d")) & (F.col("_ld_t") == F.col("_ld_h")), "left")
    rows = rows.withColumn("_ld_cut", F.split(whole, "\n", -1))  # a column of its own: split once, however many lines stay
    cut = F.col("_ld_cut")
    stay = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_ld_gone"))
    kept = F.when(F.col("_ld_gone").isNull(), whole).otherwise(F.concat_ws("\n", F.transform(stay, lambda i: F.get(cut, i))))
    counts = F.size(cut).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_dropped")
    return rows.select(*[F.col(f"`{c}`") for c in names], *counts, kept.alias("kept"))
