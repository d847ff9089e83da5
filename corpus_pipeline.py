"""A corpus pipeline: documents -> quality -> line dedup -> near dedup -> source mix -> SentencePiece ids.

Each stage works on all that the one before kept, whole texts, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, documents
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mixed_rows
from tessera.llm.near_duplicates import drop_near_duplicates
from tessera.llm.pieces import encode_rows
from tessera.llm.quality import fit, quality_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The model learns from the labelled ones; rows with a null text are judged like empty ones."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=F.lit(True))
    return quality_scores(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; ``n_chars`` follows the text. Null texts stay null."""
    kept = F.when(F.col("text").isNotNull(), F.col("kept"))
    out = line_dedup(docs).withColumn("text", kept).withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8."""
    return drop_near_duplicates(docs, size=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the piece ids, their number, and whether they decode to the text again."""
    return encode_rows(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "source", "lang", "ids", "n_pieces", "same")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("sentencepiece", pieces)]

#: SQL can't express the classifier, the search for near duplicates or the pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
