"""The queries of the operators, with the parameters they run with, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .fingerprints import edited_fingerprints
from .line_dedup import line_dedup
from .mixing import mix_sources
from .neighbours import nearest_vectors
from .pieces import round_trip
from .pii import pii_report
from .quality import fit, quality_scores
from .simhash import simhash_groups
from .substrings import substring_dedup
from .token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir), size=3, distance=2)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_report(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in ("email", "ip", "card", "phone")], F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = fit(docs, labels, train=fold != 0)
    return quality_scores(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: F.pmod(i, F.lit(100)) == 0, k=10)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), window=13).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_fingerprints": op3_fingerprints,
    "op4_source_mix": op4_source_mix,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_nearest": op8_nearest,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
}

_OP4_SQL = r"""
with sizes as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    (cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(0)) || chr(31) || 'mix'), 1, 13)) as bigint) + 0.5::double) / 4503599627370496.0::double as u
  from documents),
by_source as (select source, cast(sum(size) as bigint) as source_size, count(*) as docs from sizes group by source),
weighed as (
  select *, 3 * source_size as most, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from by_source),
leveled as (
  select *, most::double / w as ratio, row_number() over by_ratio as i,
    (sum(source_size) over () - coalesce(sum(most) over (by_ratio rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(w) over () - coalesce(sum(w) over (by_ratio rows between unbounded preceding and 1 preceding), 0))::double as level
  from weighed window by_ratio as (order by most::double / w, source nulls last)),
open as (select arg_min(level, i) as level from leveled where level < ratio),
targets as (
  select source, source_size, source_size::double / docs as mean, coalesce(least(most::double, open.level * w), most::double) as target
  from leveled left join open on true),
rates as (
  select *, case when source_size > 0 then target / source_size else 0.0 end as rate, cast(least(floor(case when source_size > 0 then target / source_size else 0.0 end), 3) as bigint) as whole from targets),
chances as (
  select s.doc_id, s.size, s.u, s.source, r.source_size, r.target, r.whole, r.target - (r.whole * r.source_size)::double as rest, r.rate - r.whole as p, r.mean,
    least(0.999::double, (r.rate - r.whole) * sqrt(r.mean / greatest(s.size, 1)::double)) as own
  from sizes s join rates r on s.source is not distinct from r.source),
ranked as (
  select *, case when p > 0 and mean > 0 then (u / (1 - u)) / (own / (1 - own)) end as q from chances),
filled as (
  select *, sum(size) over (partition by source, q is null order by q, doc_id, size rows between unbounded preceding and current row) - size / 2.0 as upto from ranked)
select doc_id, size, source_size, target, cast(whole + case when q is not null and rest > 0 and upto <= rest then 1 else 0 end as int) as copies,
  cast(size * (whole + case when q is not null and rest > 0 and upto <= rest then 1 else 0 end) as bigint) as taken
from filled
"""

_OP10_SQL = r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, unnest(range(1, len(parts) + 1)) as pos, unnest(parts) as line from docs),
stripped as (
  select doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as bare from lines),
keyed as (
  select doc_id, pos, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from stripped),
repeated as (
  select key, max(doc_id) as keep from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (keep is not null and keep <> doc_id) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (keep is null or keep = doc_id), '')) as kept_sha256
from keyed left join repeated using (key) group by doc_id
"""

_OP9_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, i, array_to_string(words[i : i + 12], ' ') as w
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) as i from docs)),
firsts as (select w, min(doc_id) as first from windows group by w having count(distinct doc_id) > 1),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from windows join firsts using (w) where doc_id > first),
words as (select doc_id, unnest(range(1, len(words) + 1)) as p, unnest(words) as word from docs),
kept as (
  select doc_id, count(*) as n, coalesce(string_agg(word, ' ' order by p), '') as text
  from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op9_substring_dedup": _OP9_SQL, "op4_source_mix": _OP4_SQL, "op10_line_dedup": _OP10_SQL}
