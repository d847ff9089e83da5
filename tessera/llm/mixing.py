"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its weighted share of all words, levelled so that none exceeds ``cap`` times
what the source has. A source that must supply r times its words takes every document floor(r) times for
certain; the rest is a Pareto sample of unequal probabilities. A document's inclusion probability is the rest's share of the source's words,
p = r - floor(r), times the root of (mean size / own size), 0.999 at most: one more copy of a long document repeats more words and
moves the total by more, so long documents get it less often. With u a document's own random number, documents
are ranked by (u / (1 - u)) / (p / (1 - p)) and taken from the lowest up until their words fill the rest: what is fixed
is the sample's size in words.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, release, unit_hash

#: Bins of the ranking variable, by which each source's words are summed before any are put in order.
BINS = 4096


def _targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row per source (``src``, ``source_size``) -> its ``target``: water-filling in closed form.

    Sources are ordered by their cap over their weight; up to the first whose cap lies above the level
    all are held at their caps. One row per source is gathered, never one per document.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight.cast("long")).withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most").cast("double") / F.col("w"))
    by_ratio = everything.orderBy("ratio", F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("source_size").over(everything)
    level = (whole - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("level", level).withColumn("open", F.when(F.col("level") < F.col("ratio"), F.row_number().over(by_ratio)))
    first = F.min(F.when(F.col("open").isNotNull(), F.struct("open", "level"))).over(everything)["level"]
    return rows.select("src", "source_size", "docs", F.coalesce(F.least(F.col("most").cast("double"), first * F.col("w")), F.col("most").cast("double")).alias("target"))


def _rank(u: Column, p: Column, size: Column, mean: Column) -> Column:
    """The odds of a random number over those of the inclusion probability; null where nothing is sampled. No words count as one."""
    own = F.least(F.lit(0.999), p * F.sqrt(mean / F.greatest(size, F.lit(1)).cast("double")))
    return F.when((p > 0) & (mean > 0), (u / (1 - u)) / (own / (1 - own)))


def mix_plan(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """One row per source: ``src``, ``source_size``, ``target``, ``whole`` (certain copies), ``p``, ``mean`` (words of a document) and
    ``cut``, the last document (rank, key, size) that the sample takes; null where it takes none.

    Words are first summed by source and bin of the ranking variable; only the documents of each source's bin in which the target falls are put in
    order, one in ``BINS`` of its documents, so a source with a third of all rows is never sorted in one task. The sources themselves are put in order
    in one: their number is taken to be small beside that of documents.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(df.select(F.col(source).alias("src"), F.col(key).alias("k"), n_words(text).alias("size"), unit_hash(key, salt=seed).alias("u")), "sizes")
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = _targets(sizes, weights, cap).withColumn("whole", F.least(F.floor(rate), F.lit(cap)).cast("int")).withColumn("p", rate - F.col("whole"))
    plan = plan.withColumn("mean", F.col("source_size") / F.col("docs"))
    plan = scratch.save(plan.withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")), "plan")
    release(spark)

    def with_plan(part: DataFrame) -> DataFrame:
        own = spark.read.schema(plan.schema).parquet(plan.scratch_path).withColumnRenamed("src", "s")
        ranked = part.join(own, F.col("src").eqNullSafe(F.col("s"))).withColumn("rank", _rank(F.col("u"), F.col("p"), F.col("size"), F.col("mean")))
        return ranked.where("rank is not null").withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))

    bins = with_plan(rows).groupBy("src", "bin", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("src").orderBy("bin"))
    crossed = bins.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where("before <= rest and rest < upto")
    crossed = crossed.select(F.col("src").alias("c_src"), F.col("bin").alias("c_bin"), "before")
    # a source whose sample needs no cut inside a bin takes all its documents once more
    near = with_plan(rows).join(crossed, F.col("src").eqNullSafe(F.col("c_src")) & (F.col("bin") == F.col("c_bin")))
    order = Window.partitionBy("src").orderBy("rank", "k", "size")
    filled = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    cut = near.withColumn("in", filled <= F.col("rest")).groupBy("src", "c_bin").agg(F.max(F.when(F.col("in"), F.struct("rank", "k", "size"))).alias("cut"))
    cut = cut.select(F.col("src").alias("c_src"), F.col("c_bin").alias("cut_bin"), "cut")
    cuts = scratch.save(plan.join(cut, F.col("src").eqNullSafe(F.col("c_src")), "left").drop("c_src"), "cuts")
    release(spark)
    return cuts


def _plan_columns(df: DataFrame, *options: Any) -> DataFrame:
    held = ("src", "source_size", "target", "whole", "p", "mean", "rest", "cut_bin", "cut")
    return mix_plan(df, *options).select(*[F.col(c).alias(f"_mix_{c}") for c in held])


def mix_sources(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """Every row of ``df`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words times copies).

    ``weights`` repeat over the sources in code point order, null last; a null source is a source. ``cap`` is the most
    copies of a document. A null or empty text has no words, may be taken and counts nothing. Rows that repeat a key share
    one draw, so they are taken together. An empty table gives an empty result. Columns of ``df`` that carry the
    result's names are replaced. Draws depend on the key and ``seed`` alone: reruns agree.
    """
    plan = _plan_columns(df, weights, cap, source, text, key, seed)
    rows = df.drop(*[c for c in df.columns if c in RESULT])
    rows = _mixed(rows, plan, source, text, key, seed)
    names = [c for c in rows.columns if not c.startswith("_mix_")]
    result = [F.col(f"_mix_{c}").alias(c) for c in RESULT]
    return rows.select(*[F.col(f"`{c}`") for c in names], *result)


#: What mix_sources adds to the rows.
RESULT = ("size", "source_size", "target", "copies", "taken")


def _mixed(rows: DataFrame, plan: DataFrame, source: str, text: str, key: str, seed: str) -> DataFrame:
    """The rows beside their results, under names that begin with _mix_."""
    # sizes and draws below the join, so that they aren't worked out again wherever the rank is named
    rows = rows.withColumns({"_mix_size": n_words(text), "_mix_u": unit_hash(key, salt=seed)}).join(plan, F.col(source).eqNullSafe(F.col("_mix_src")))
    rows = rows.withColumn("_mix_rank", _rank(F.col("_mix_u"), F.col("_mix_p"), F.col("_mix_size"), F.col("_mix_mean")))
    rows = rows.withColumn("_mix_bin", F.floor(F.col("_mix_rank") / (1 + F.col("_mix_rank")) * BINS))
    here = F.struct(F.col("_mix_rank").alias("rank"), F.col(key).alias("k"), F.col("_mix_size").alias("size"))
    sampled = F.when(F.col("_mix_rank").isNull() | (F.col("_mix_rest") <= 0), False).when(F.col("_mix_cut_bin").isNull() | (F.col("_mix_bin") < F.col("_mix_cut_bin")), True)
    sampled = sampled.when(F.col("_mix_bin") > F.col("_mix_cut_bin"), False).otherwise(F.coalesce(here <= F.col("_mix_cut"), F.lit(False)))
    rows = rows.withColumn("_mix_copies", F.col("_mix_whole") + sampled.cast("int"))
    return rows.withColumn("_mix_taken", (F.col("_mix_size") * F.col("_mix_copies")).cast("long"))


def mixed_rows(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, source: str = "source", text: str = "text", key: str = "doc_id", seed: str = "mix") -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is taken, with the columns of ``df``, whatever they are called."""
    plan = _plan_columns(df, weights, cap, source, text, key, seed)
    rows = _mixed(df, plan, source, text, key, seed)
    # a filter on the number of copies would move into the join, and its expression would make the generated code too large to be compiled
    copies = F.explode_outer(F.array_repeat(F.lit(1), F.col("_mix_copies")))
    return rows.withColumn("_mix_copy", copies).where("_mix_copy is not null").select(*[F.col(f"`{c}`") for c in df.columns])
