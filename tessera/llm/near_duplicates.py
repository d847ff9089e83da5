"""Near duplicates by word shingles: SimHash pairs and bands of smallest hashes propose, exact Jaccard similarities decide.

The SimHash search of ``simhash`` brings near texts together by the generalised pigeonhole principle. A fingerprint of 64 bits can't reach all
pairs of a similarity of 0.8, whose fingerprints differ in ten bits on average, so texts that share a band of smallest shingle hashes meet as well.
What meets is screened by sizes and by a sketch of one bit for each smallest hash; of what passes, a spanning forest is put out, likely
links first. Its pairs are verified one by one on whole shingle sets. Where pairs that pass hold texts together that verified links don't, the
rest of their pairs is verified as well, in cells of bounded size. Groups are connected over verified links alone, so that chance
candidates never merge anything.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, release, whole_groups
from .graph import components
from .simhash import _elected, _root, _tied, _votes, gram_hashes, hamming_forest, words_of

_ROWS, _MISSED = 5, 1e-5  # smallest hashes a band joins; the chance that a pair of exactly the wanted similarity shares no band
_LEAST = -(1 << 63)


def shingle_set(words: list[str], size: int) -> np.ndarray:
    """The distinct hashes of the shingles, ascending."""
    return np.unique(gram_hashes(words, size))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets have a Jaccard similarity of at least ``similarity``."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def bands_for(similarity: float) -> int:
    """The number of bands at which a pair of this Jaccard similarity shares none with a chance of at most ``_MISSED``."""
    one = similarity**_ROWS
    return 1 if one >= 1 else math.ceil(math.log(_MISSED) / math.log1p(-one))


def smallest_hashes(grams: np.ndarray, n: int) -> np.ndarray:
    """The smallest of a set's hashes under each of ``n`` orders, 32 bits each.

    Two sets agree in an order with the chance of their Jaccard similarity.
    """
    draw = np.random.default_rng(5)
    by, plus = draw.integers(0, 1 << 32, (2, n), np.uint32)
    by |= np.uint32(1)
    h, least = (grams >> np.uint64(32)).astype(np.uint32), np.full(n, (1 << 32) - 1, np.uint32)
    for at in range(0, len(h), 256):
        np.minimum(least, (h[at : at + 256, None] * by + plus).min(axis=0), out=least)
    return least


def _stirred(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band: its number and ``_ROWS`` of the smallest hashes."""
    key = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, _ROWS).T.astype(np.uint64):
        key = _stirred(key ^ row)
    return key


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each smallest hash, in 64-bit words: sets of similarity s differ in each with a chance of (1 - s) / 2."""
    bits = np.zeros(-(-len(least) // 64) * 64, np.uint8)
    bits[: len(least)] = (_stirred(least.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)) & np.uint64(1)
    return np.packbits(bits).view(np.uint64)


def sketch_limits(similarity: float, n: int) -> tuple[int, int]:
    """Differing bits of a sketch of ``n``: up to the first a pair may have ``similarity`` (six deviations), up to the second it likely has."""
    p = (1 - similarity) / 2
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p))), math.floor(n * p / 2)


def propose(table: pa.Table, similarity: float, most: int, sure: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidate pairs of each cell (band, i, j), rows sorted by them, as a and b.

    Pairs of sizes too far apart, or of more than ``most`` differing sketch bits, are no candidates; those of at most ``sure`` come first. A cell with
    i <> j compares its shards' rows with each other only.
    """
    band, i, j, own, node, n = (table[c].to_numpy() for c in ("band", "i", "j", "own", "node", "n"))
    words = [table[c].to_numpy().view(np.uint64) for c in table.column_names if re.fullmatch(r"s\d+", c)]
    fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
    start = np.flatnonzero(fresh)
    ends = np.append(start[1:], len(band))
    apart = i != j

    def far(p: np.ndarray | int, q: np.ndarray | slice) -> np.ndarray:
        """Differing bits; more than ``most`` for what is no candidate."""
        d = differing(words, p, q, n, similarity, most)
        d[(node[p] == node[q]) | (apart[p] & (own[p] == own[q]))] = most + 1
        return d

    def put(p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], names=["a", "b"])

    size = ends - start
    small = np.flatnonzero((size > 1) & (size <= 64))
    pairs = np.cumsum(size[small] * (size[small] - 1) // 2)
    blocks = np.split(small, np.searchsorted(pairs, np.arange(1_000_000, pairs[-1], 1_000_000))) if len(small) else ()
    for cells in blocks:  # all pairs of small cells at once: each row with those before it in its cell
        before = np.concatenate([np.arange(k) for k in size[cells]])
        p = np.repeat(np.repeat(start[cells], size[cells]) + before, before)
        q = p - 1 - (np.arange(len(p)) - np.repeat(np.cumsum(before) - before, before))
        d = far(p, q)
        near = np.flatnonzero(d <= most)
        near = near[np.argsort(d[near] > sure, kind="stable")]
        p, q = p[near], q[near]
        up: dict[int, int] = {}
        kept = []
        for at, (x, y) in enumerate(zip(p.tolist(), q.tolist())):
            rx, ry = _root(up, x), _root(up, y)
            if rx != ry:
                up[max(rx, ry)] = min(rx, ry)
                kept.append(at)
        if kept:
            yield put(p[kept], q[kept])
    for lo, hi in ((start[c], ends[c]) for c in np.flatnonzero(size > 64)):
        sets = np.arange(hi - lo)
        for limit in (sure, most):
            for p in range(lo + 1, hi):
                at = np.flatnonzero(far(p, slice(lo, p)) <= limit)[::-1]  # the latest first, so that no row becomes a hub
                at = at[sets[at] != sets[p - lo]]
                if len(at):
                    tied = lo + np.array(_tied(sets, p - lo, at), np.int64)
                    yield put(np.full(len(tied), p), tied)


def differing(words: list[np.ndarray], p: np.ndarray | int, q: np.ndarray | slice, n: np.ndarray, similarity: float, most: int) -> np.ndarray:
    """Differing sketch bits of rows p and q; more than ``most`` where the sizes ``n`` rule the similarity out."""
    d = np.bitwise_count(words[0][p] ^ words[0][q]).astype(np.int16)
    for w in words[1:]:
        d += np.bitwise_count(w[p] ^ w[q])
    d[np.minimum(n[p], n[q]) < similarity * np.maximum(n[p], n[q])] = most + 1
    return d


def solve(table: pa.Table, similarity: float, most: int) -> pa.RecordBatch:
    """Labels, as a and b, that links tie together in each cell (c, i, j); a label's rows are tied already.

    Every pair of rows of two labels that ``differing`` lets through is compared, unless links found before have tied them. A cell with i <> j compares its shards' rows
    with each other only.
    """
    c, i, j, own, n, named = (table[x].to_numpy() for x in ("c", "i", "j", "own", "n", "label"))
    words = [table[x].to_numpy().view(np.uint64) for x in table.column_names if re.fullmatch(r"s\d+", x)]
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    start = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    a, b, label = [], [], named.copy()
    for lo, hi in zip(start, np.append(start[1:], len(c))):
        for x in range(lo, hi - 1):
            rest = np.arange(x + 1, hi)
            rest = rest[(label[rest] != label[x]) & ((i[lo] == j[lo]) | (own[rest] != own[x]))]
            for y in rest[differing(words, x, rest, n, similarity, most) <= most]:
                if label[x] != label[y] and alike(sets[x], sets[y], similarity):
                    label[lo:hi][label[lo:hi] == label[y]] = label[x]
                    a.append(named[x])
                    b.append(named[y])
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], names=["a", "b"])


def near_duplicate_groups(df: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 3, most: int = 20_000, most_sets: int = 1_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``k`` (the key as long), ``t`` (a hash of the text) and ``g``, its group; near duplicates share one.

    A link is a pair of texts whose sets of ``size``-word shingles have a Jaccard similarity of at least ``similarity``; groups are connected over
    links. Pairs to verify come from SimHashes of the sets within ``distance`` bits, and from bands of smallest shingle hashes, of which there
    are so many that a pair of the wanted similarity shares none with a chance of at most 1e-5, of a higher one less, whatever the edit and
    the text's length; a sketch rejects a link with a chance of 1e-8. Bands with more than ``most`` texts, and sets of texts yet to be told
    apart with more than ``most_sets`` (a thousand shingles of a long text count as one), are cut into shards, any two of which meet in a task of their own; this bounds a task and
    changes no result. Texts of equal words, letter case aside, are one point whatever their number; texts without words are equal to one
    another. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch, bands = Scratch(spark), bands_for(similarity)
    orders = bands * _ROWS
    limit, sure = sketch_limits(similarity, orders)
    sketches = [f"s{w}" for w in range(-(-orders // 64))]
    made = ["k long", "t long", "e long", "fp long", "n int", *(f"{s} long" for s in sketches), "bands binary"]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in map(words_of, b.column(2).to_pylist()):
                grams = shingle_set(w, size)
                least = smallest_hashes(grams, orders)
                fp = _elected(sum((_votes(grams[at : at + (1 << 15)]) for at in range(0, len(grams), 1 << 15)), np.zeros(64, np.int64)), len(grams))
                keys = band_keys(least, bands).tobytes() if len(grams) else b""
                whole = np.array([xxhash.xxh64_intdigest(" ".join(w)), fp, *sketch(least)], np.uint64).view(np.int64).tolist()
                out.append((*whole[:2], len(grams), *whole[2:], keys))
            columns = list(zip(*out)) or [()] * (len(made) - 2)
            arrays = [pa.array(c, kinds[m.split()[1]]) for c, m in zip(columns, made[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=[m.split()[0] for m in made])

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column(0).to_pylist()
            times = np.array([len(x) // 8 for x in held], np.int64)
            others = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), times)) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(held), np.int64)), *others], names=["band", "node", "n", *sketches])

    whole = F.coalesce(F.col(text), F.lit(""))
    texts = df.select(F.col(key).cast("long").alias("k"), F.xxhash64(whole).alias("t"), whole.alias("text"))
    signed = scratch.save(texts.mapInArrow(sign, ", ".join(made)), "signed")
    names = [m.split()[0] for m in made]
    one = F.min(F.struct(*[c for c in names if c != "e"])).alias("one")
    points = scratch.save(signed.groupBy("e").agg(one).select("e", "one.*"), "points")
    spread_type = "band long, node long, n int, " + ", ".join(f"{s} long" for s in sketches)
    met = points.select("bands", F.col("e").alias("node"), "n", *sketches).mapInArrow(spread, spread_type)
    frequent = scratch.save(met.groupBy("band").agg(F.count("*").alias("c")).where(F.col("c") > most), "frequent")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "i", "j"], 50_000):
            yield from propose(table, similarity, limit, sure)

    shards = F.coalesce(F.ceil(F.col("c") / most), F.lit(1)).cast("int")
    cells = met.join(frequent, "band", "left").withColumn("own", F.pmod(F.xxhash64("node"), shards).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), shards - 1)))
    cells = cells.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    cells = cells.select("band", "i", "j", "own", "node", "n", *sketches).repartition(tasks, "band", "i", "j")
    forest = scratch.save(cells.sortWithinPartitions("band", "i", "j", "node").mapInArrow(meet, "a long, b long").distinct(), "forest")
    release(spark)
    near = hamming_forest(points.where("n > 0").select("fp", F.col("e").alias("node")), distance)
    pairs = scratch.save(forest.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")
    release(spark)

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(words_of(x), size).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["e", "set"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array([alike(p, q, similarity) for p, q in zip(x, y)], pa.bool_()))

    ends = pairs.select(F.col("a").alias("e")).unionByName(pairs.select(F.col("b").alias("e"))).distinct()
    wanted = points.join(ends, "e", "left_semi").select("e", F.coalesce("k", F.lit(_LEAST)).alias("wk"), F.col("k").isNull().alias("none"), F.col("t").alias("wt"))
    same = (F.coalesce("k", F.lit(_LEAST)) == F.col("wk")) & (F.col("k").isNull() == F.col("none")) & (F.col("t") == F.col("wt"))
    sets = scratch.save(texts.join(wanted, same).select("e", "text").mapInArrow(shingles, "e long, set binary").dropDuplicates(["e"]), "sets")
    release(spark)
    both = pairs.join(sets.select(F.col("e").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("e").alias("b"), F.col("set").alias("y")), "b")
    links = scratch.save(both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), "links")
    release(spark)
    labels = scratch.save(components(links).select("node", F.col("component").alias("label")), "labels")

    # what the forest connects and links don't: its other pairs as edges between labels
    other = forest.join(links, ["a", "b"], "left_anti")
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        other = other.join(own, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    edges = other.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b")
    apart = scratch.save(components(edges).select(F.col("node").alias("label"), F.col("component").alias("c")), "apart")
    release(spark)
    alone = apart.join(labels, "label", "left_anti").select("label", "c", F.col("label").alias("node"))
    held = labels.join(apart, "label").select("label", "c", "node").unionByName(alone)
    held = scratch.save(held.join(points.select(F.col("e").alias("node"), "n"), "node"), "held")
    # a long text counts for several
    counted = held.groupBy("c", "label").agg(F.count("*").alias("texts"), F.sum(F.ceil(F.col("n") / 1000)).alias("size"))
    large = F.col("size") > most_sets // 2
    few = counted.groupBy("c").agg(F.sum("texts").alias("all"), F.sum(F.when(large, 0).otherwise(F.col("size"))).alias("few")).where(F.col("all") > 2)  # the one pair of two is decided
    # a large label has shards to itself, small ones share some
    open_ = held.join(counted.join(few, "c"), ["c", "label"])
    own = F.concat_ws("-", F.col("label").cast("string"), F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / most_sets)).cast("string"))
    shared = F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.ceil(F.col("few") / most_sets)).cast("string"))
    open_ = open_.select("c", "node", "label", "n", F.when(large, own).otherwise(shared).alias("shard"), F.when(large, F.col("label")).alias("whole"))
    open_ = scratch.save(open_, "open")
    out = signed.join(labels, F.col("e") == F.col("node"), "left").select("k", "t", F.coalesce("label", "e").alias("g"))
    if not open_.isEmpty():
        parts = open_.select("c", "shard", "whole").distinct()
        x, y = (parts.select("c", F.col("shard").alias(s), F.col("whole").alias(f"w{s}")) for s in "ij")
        meeting = x.join(y, "c").where("i <= j and not coalesce(wi = wj, false)").select("c", "i", "j")
        cells = meeting.withColumn("shard", F.explode(F.array_distinct(F.array("i", "j")))).join(open_, ["c", "shard"]).withColumnRenamed("shard", "own")
        cells = cells.join(points.select(F.col("e").alias("node"), *sketches), "node").join(sets.withColumnRenamed("e", "node"), "node")
        cells = cells.select("c", "i", "j", "own", "label", "n", *sketches, "set").repartition(tasks, "c", "i", "j").sortWithinPartitions("c", "i", "j", "label")

        def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in whole_groups(batches, ["c", "i", "j"], 200):
                yield solve(table, similarity, limit)

        found = components(scratch.save(cells.mapInArrow(tell, "a long, b long"), "found"))
        out = out.join(found, F.col("g") == F.col("node"), "left").select("k", "t", F.coalesce("component", "g").alias("g"))
    scratch.drop(sets)
    return out


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` that stay: of each group of near duplicates one with the smallest key (null first), of equal rows one."""
    scratch, spark = Scratch(df.sparkSession), df.sparkSession
    groups = near_duplicate_groups(df, text=text, key=key, **options)
    first = groups.groupBy("g").agg(F.min(F.struct("k", "t")).alias("one"))
    first = first.select(F.coalesce("one.k", F.lit(_LEAST)).alias("_nd_k"), F.col("one.t").alias("_nd_t"), F.col("one.k").isNull().alias("_nd_null"))
    kept = scratch.save(first, "kept")
    release(spark)
    own = F.col(key).cast("long")
    rows = df.withColumns({"_nd_k": F.coalesce(own, F.lit(_LEAST)), "_nd_t": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_nd_null": own.isNull()})
    on = ["_nd_k", "_nd_t", "_nd_null"]  # plain columns, so that one shuffle of the texts serves the join and the copies' removal
    return rows.join(kept, on, "left_semi").dropDuplicates(on).select(*[F.col(f"`{c}`") for c in df.columns])
