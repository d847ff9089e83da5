"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed by a rolling polynomial; of every ``w`` hashes in a row the smallest
is chosen, the rightmost of equal ones. Two texts that share a stretch of at least ``k + w - 1`` code points
share a chosen hash, and the positions kept with the hashes say where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column_batches

K, W = 8, 16  # shared stretches of 23 code points share a hash, in short texts too
_BLOCK = 1 << 15  # windows handled at once; a hash's place in its block fits the low 16 bits of its key
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    """48 well-mixed bits of each value."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(16)


def gram_hashes(codes: np.ndarray, k: int, most: int) -> np.ndarray:
    """A 48-bit hash of every k-gram; a shorter text is one gram, hashed with its length. ``most``: the longest input."""
    up, down = _powers(most)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * down[:n], out=sums[1:])
    if n < k:
        return _mixed(sums[n:] * up[n - 1] + np.uint64(n * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    return _mixed((sums[k:] - sums[:-k]) * up[k - 1 : n])


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """The chosen hashes of a text (unsigned, 48 bits) and their positions in code points, by position. Empty text: none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    windows, most = max(1, n - k - w + 2), _BLOCK + k + w
    hashes, places = [], []
    for at in range(0, windows, _BLOCK):
        here = min(_BLOCK, windows - at)
        key = gram_hashes(codes[at : at + here + w + k - 2], k, most)
        key = (key << np.uint64(16)) | (np.uint64(0xFFFF) - np.arange(len(key), dtype=np.uint64))
        span, width = 1, min(w, len(key))
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if rest := width - span:
            key = np.minimum(key[:-rest], key[rest:])
        first = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        key = key[first]
        hashes.append(key >> np.uint64(16))
        places.append(at + (np.uint64(0xFFFF) - (key & np.uint64(0xFFFF))).astype(np.int64))
    h, p = np.concatenate(hashes), np.concatenate(places)
    first = np.ones(len(p), bool)
    np.not_equal(p[1:], p[:-1], out=first[1:])  # the last of a block may be the next one's first
    return h[first], p[first]


def as_hex(hashes: np.ndarray, places: np.ndarray) -> str:
    """Twelve hex digits of each hash and eight of its position, in order."""
    out = np.empty((len(hashes), 10), np.uint8)
    out[:, :6] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    out[:, 6:] = places.astype(">u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """One row per input row: the key, ``hashes`` (array of long) and ``positions`` (array of int).

    A null or empty text has an empty fingerprint; one shorter than ``k`` has one hash. Null keys and repeated rows pass through;
    an empty table gives an empty result; other columns are not read. Long texts are hashed in blocks. No shuffle.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [winnow(t or "", k, w) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h.astype(np.int64) for h, _ in both], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in both], pa.list_(pa.int32()))], names=["key", "hashes", "positions"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, hashes array<bigint>, positions array<int>").withColumnRenamed("key", key)


def _in_turn(df: DataFrame, text: str, key: str) -> DataFrame:
    """``k``, ``text`` and ``ghost``, sorted within ``deal``: the rows of a range of keys, and behind them (ghost) the first
    rows of the next range, so that each row has its successor in its own task. The last range ends with the first.

    Ranges are cut at approximate quantiles of the key, four for each shuffle partition. A key that fills several ranges is dealt to them by the hashes of its
    texts. Only the cuts and each range's first key and hash reach the driver. Each text is shuffled once.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * tasks
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("k"), order.alias("o"), F.xxhash64(whole).alias("h"), whole.alias("text"))
    cuts = rows.agg(F.percentile_approx("o", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"]
    cuts = np.sort(np.array(cuts or [], np.int64))

    def range_of(o: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(cuts, o, side="left"), np.searchsorted(cuts, o, side="right")
        share = (h.astype(np.float64) + float(1 << 63)) / float(1 << 64)
        return np.where(high - low > 1, np.minimum(low + 1 + (share * (high - low)).astype(np.int64), high), high)

    @F.pandas_udf("int")
    def place(o: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(o.to_numpy(), h.to_numpy()).astype(np.int32))

    ranges = sorted(tuple(r) for r in rows.select(place("o", "h").alias("b"), "o", "h").groupBy("b").agg(F.min(F.struct("o", "h")).alias("m")).select("b", "m.o", "m.h").collect())
    first = {(o, h): ranges[i - 1][0] for i, (_, o, h) in enumerate(ranges)}  # the range before, around the end

    @F.pandas_udf("array<int>")
    def places(o: pd.Series, h: pd.Series) -> pd.Series:
        at = range_of(o.to_numpy(), h.to_numpy()).tolist()
        return pd.Series([[b] if (before := first.get(x)) is None else [b, -1 - before] for b, x in zip(at, zip(o.tolist(), h.tolist()))])

    dealt = rows.withColumn("d", F.explode(places("o", "h"))).withColumn("ghost", F.col("d") < 0).withColumn("deal", F.when(F.col("ghost"), -1 - F.col("d")).otherwise(F.col("d")))
    return dealt.repartitionById(tasks, F.col("deal") % tasks).sortWithinPartitions("deal", "ghost", "o", "h", "text").select("deal", "ghost", "k", "text")


def edited_fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id", part: int = 4, k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint beside that of an edited text and that of the next document.

    The next document is the one with the next key, after the last the first; rows with one key follow each other by their texts' hashes.
    A null key comes before all others, a null text is empty. In the edited text the last floor(n_chars / ``part``) code
    points give way to as many from the next text's start. Columns: key, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint`` (hex), ``near_edited``, ``near_next``. An empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (deal, key, text, hashes, positions) of the row whose successor is awaited
        for deals, ghosts, keys, texts in column_batches(batches, "deal", "ghost", "k", "text"):
            out: list[tuple] = []
            for deal, ghost, name, t in zip(deals, ghosts, keys, texts):
                if ghost and (held is None or held[0] != deal):
                    continue  # a further ghost of a range that is done
                h, p = winnow(t, k, w)
                if held is not None:
                    _, name0, t0, h0, p0 = held
                    cut = len(t0) // part
                    edited = t0[: len(t0) - cut] + t[:cut]
                    he, pe = winnow(edited, k, w)
                    out.append((name0, len(t0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(h0, p0), as_hex(he, pe), likeness(h0, he), likeness(h0, h)))
                held = None if ghost else (deal, name, t, h, p)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out = _in_turn(df, text, key).mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
