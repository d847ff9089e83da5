"""SimHash fingerprints, and their links within a Hamming distance by the generalised pigeonhole principle.

Bits that go together over the corpus share a partition. If two fingerprints differ in at most t bits and the
thresholds t_1..t_m of m partitions sum to t - m + 1, then in some partition i they differ in at most t_i bits (-1: never probed).
Each fingerprint chooses its own thresholds by dynamic programming on how many candidates each would bring it,
as histograms of sub-blocks estimate; it probes the index of partition values with what lies within each threshold, and the join verifies
the whole distance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, bounded_batches, whole_groups
from .graph import components

_words = re.compile(WORD).findall
_LOWER = {u: u + 32 for u in range(ord("A"), ord("Z") + 1)}
_BLOCK = 1 << 15  # shingles hashed at once
_MOST_PROBES = 1 << 17  # no fingerprint probes one partition with more; thresholds spread evenly stay far below


def words_of(text: str) -> list[str]:
    return _words(text.lower() if text.isascii() else text.translate(_LOWER))


def gram_hashes(words: list[str], size: int, at: int = 0, end: int | None = None, seed: int = 42) -> np.ndarray:
    """The hashes of the shingles that start at words ``at`` to ``end``; fewer words than ``size``: of the whole sequence; none: none."""
    n = max(1, len(words) - size + 1) if words else 0
    end = n if end is None else min(n, end)
    grams = zip(*[words[at + j : end + j] for j in range(size)]) if len(words) >= size else [words] * n
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(" ".join(g), seed) for g in grams), np.uint64, end - at)


def _votes(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _elected(votes: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def simhash(text: str | None, size: int) -> int:
    """A bit is 1 if set in over half the hashes of the text's ``size``-word shingles, repeats included; no words: 0."""
    words = words_of(text or "")
    n = max(1, len(words) - size + 1) if words else 0
    return _elected(sum((_votes(gram_hashes(words, size, at, at + _BLOCK)) for at in range(0, n, _BLOCK)), np.zeros(64, np.int64)), n)


def simhashes(df: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key (as it is) and ``fp``, the fingerprint as a signed long; one row per input row. Null texts have no words."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", key)


def _bits(fp: np.ndarray, which: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, as small numbers."""
    out = np.zeros(len(fp), np.int64)
    for j, b in enumerate(which):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def _corpus_counts(points: DataFrame, what: str, blocks: list[list[int]]) -> np.ndarray:
    """Counts over all points, summed by task and then by Spark: of pairs of bits ("pairs"), or of each block's values ("values")."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            if what == "pairs":
                bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total = total + (bits.T @ bits).astype(np.int64).ravel()
            else:
                total = total + np.concatenate([np.bincount(_bits(fp, block), minlength=1 << len(block)) for block in blocks])
        if not np.isscalar(total):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(4096 if what == "pairs" else sum(1 << len(b) for b in blocks), np.int64)
    for at, n in points.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n")).collect():  # as many rows as cells, whatever the corpus
        out[at] = n
    return out


def bit_partitions(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m partitions: each starts with the strongest correlation left and takes in what goes with it best."""
    p = pairs.reshape(64, 64) / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    tie = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = list(range(64)), []
    for i in range(m):
        width = len(left) // (m - i)
        sums = tie[np.ix_(left, left)]
        mine = [left[int(np.argmax(sums.max(axis=1)))]]
        while len(mine) < width:
            rest = [b for b in left if b not in mine]
            mine.append(rest[int(np.argmax(tie[np.ix_(rest, mine)].sum(axis=1)))])
        out.append(sorted(mine))
        left = [b for b in left if b not in mine]
    return out


def _probes(bits: int, threshold: int) -> int:
    """How many values lie within the threshold of one."""
    return sum(math.comb(bits, d) for d in range(threshold + 1))


class Thresholds:
    """Per-fingerprint thresholds for the partitions, from histograms of sub-blocks of at most ``most`` bits."""

    def __init__(self, parts: list[list[int]], distance: int, pair_cost: float, most: int = 11):
        self.parts, self.distance, self.m, self.pair_cost = parts, distance, len(parts), pair_cost
        self.blocks = [[list(map(int, b)) for b in np.array_split(p, math.ceil(len(p) / most))] for p in parts]
        self.flat = [b for blocks in self.blocks for b in blocks]
        self.near: list[np.ndarray] = []

    def learn(self, counts: np.ndarray) -> None:
        """For each block and value: the share of the corpus at each distance in that block, up to the threshold."""
        at = 0
        for block in self.flat:
            size = 1 << len(block)
            held = counts[at : at + size].astype(np.float64)
            at += size
            held /= max(held.sum(), 1.0)
            near = np.zeros((size, self.distance + 1))
            near[:, 0], layer = held, held.reshape([2] * len(block))
            # layers[d]: sums over the values at distance d, built up one bit at a time
            layers = [layer] + [np.zeros_like(layer) for _ in range(self.distance)]
            for axis in range(len(block)):
                flipped = [np.flip(x, axis) for x in layers]
                layers = [layers[0]] + [layers[d] + flipped[d - 1] for d in range(1, self.distance + 1)]
            for d, x in enumerate(layers):
                near[:, d] = x.ravel()
            self.near.append(near)

    def choose(self, fp: np.ndarray, n: int) -> np.ndarray:
        """Thresholds of each fingerprint (rows) in each partition, of the least estimated candidates and probes."""
        t, costs, block = self.distance, [], 0
        for part, blocks in zip(self.parts, self.blocks):
            share = np.zeros((len(fp), t + 1))
            share[:, 0] = 1.0
            for b in blocks:
                near = self.near[block][_bits(fp, b)]
                block += 1
                share = np.stack([sum(share[:, i] * near[:, d - i] for i in range(d + 1)) for d in range(t + 1)], axis=1)
            probes = np.array([p if (p := _probes(len(part), e)) <= _MOST_PROBES else np.inf for e in range(t + 1)])
            costs.append(np.concatenate([np.zeros((len(fp), 1)), np.cumsum(share, axis=1) * n * self.pair_cost + probes], axis=1))  # column e + 1: threshold e
        # thresholds plus one sum to t + 1: best[:, s] is the least cost of spending s on the partitions so far
        best, took = costs[0], [np.tile(np.arange(t + 2), (len(fp), 1))]
        for cost in costs[1:]:
            ways = np.stack([np.stack([best[:, s - e] + cost[:, e] if e <= s else np.full(len(fp), np.inf) for e in range(t + 2)], axis=1) for s in range(t + 2)], axis=1)
            took.append(ways.argmin(axis=2))
            best = ways.min(axis=2)
        out, left = np.empty((len(fp), self.m), np.int64), np.full(len(fp), t + 1)
        for i in range(self.m - 1, -1, -1):
            e = took[i][np.arange(len(fp)), left]
            out[:, i], left = e - 1, left - e
        return out


_ROW = "part tinyint, value long, probe boolean, fp long, node long"


def partitions_for(n: int, distance: int, pair_cost: float) -> int:
    """The number of partitions that makes fewest probes and candidates for ``n`` evenly spread fingerprints."""

    def cost(m: int) -> float:
        each, more = divmod(distance - m + 1, m)
        probes = sum(_probes(64 // m, each + (i < more)) for i in range(m))
        return probes * (1 + pair_cost * n / 2 ** (64 // m))

    return min(range(2, max(2, distance + 1) + 1), key=lambda m: (cost(m), m))


class Search:
    """How ``points`` (fp, node, and columns that are carried along) are partitioned and probed for pairs within ``distance``.

    ``pair_cost`` is the cost of comparing a pair of candidates, beside that of a probe.
    """

    def __init__(self, points: DataFrame, distance: int, pair_cost: float = 1.0):
        self.points, self.distance, self.n = points, distance, points.count()
        self.parts = bit_partitions(_corpus_counts(points, "pairs", []), self.n, partitions_for(self.n, distance, pair_cost))
        self.thresholds = Thresholds(self.parts, distance, pair_cost)
        self.thresholds.learn(_corpus_counts(points, "values", self.thresholds.flat))
        self.held = [np.uint64(sum(1 << b for b in p)) for p in self.parts]

    def signatures(self) -> DataFrame:
        """Index rows (each partition's value of each point) and probe rows (what lies within the point's own thresholds)."""
        return _signatures(self.points, self.n, self.parts, self.held, self.thresholds, self.distance)


def _signatures(points: DataFrame, n: int, parts: list[list[int]], held: list[np.uint64], thresholds: Thresholds, distance: int) -> DataFrame:
    m = len(parts)
    steps = {(i, e): np.array([sum(1 << b for b in c) for d in range(e + 1) for c in combinations(p, d)], np.uint64) for i, p in enumerate(parts) for e in range(distance + 1) if _probes(len(p), e) <= _MOST_PROBES}

    def rows(i: int, value: np.ndarray, probe: bool, *others: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int8)), pa.array(value.view(np.int64)), pa.array(np.full(len(value), probe)), *map(pa.array, others)], names=["part", "value", "probe", *carried])

    carried = ["fp", "node", *(c for c in points.columns if c not in ("fp", "node"))]
    more = "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in carried[2:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [b.column(i).to_numpy(zero_copy_only=False) for i in range(len(carried))]
            for at in range(0, b.num_rows, 4096):
                own = [c[at : at + 4096] for c in whole]
                fp = own[0].view(np.uint64)
                wanted = thresholds.choose(fp, n)
                for i in range(m):
                    yield rows(i, fp & held[i], False, *own)
                    for e in range(distance + 1):
                        if (q := np.flatnonzero(wanted[:, i] == e)).size:
                            step = steps[i, e]
                            for part in np.array_split(q, min(q.size, math.ceil(q.size * len(step) / 500_000))):
                                yield rows(i, ((fp[part] & held[i])[:, None] ^ step).ravel(), True, *(np.repeat(c[part], len(step)) for c in own))

    return points.select(*carried).mapInArrow(run, _ROW + more)


def hamming_links(points: DataFrame, distance: int) -> DataFrame:
    """``points`` (fp long, node: distinct long) -> links (a, b: the nodes) of all pairs that differ in at most ``distance`` bits, each once.

    The distance is part of the join's condition, so that only links leave it.
    """
    scratch = Scratch(points.sparkSession)
    made = scratch.save(Search(points, distance).signatures(), "signatures", partition_by="probe")
    index, probes = made.where("not probe").alias("x"), made.where("probe").alias("q")
    same = (F.col("x.part") == F.col("q.part")) & (F.col("x.value") == F.col("q.value"))
    one_way = (F.col("q.fp") < F.col("x.fp")) | ((F.col("q.fp") == F.col("x.fp")) & (F.col("q.node") < F.col("x.node")))
    near = one_way & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("x.fp"))) <= distance)
    links = scratch.save(probes.join(index, same & near).select(F.col("q.node").alias("a"), F.col("x.node").alias("b")).distinct(), "pairs")
    scratch.drop(made)
    return links


def _root(up: dict[int, int], k: int) -> int:
    """The root of k among sets kept as a parent for each member that isn't a root."""
    while (above := up.get(k)) is not None:
        if (further := up.get(above)) is not None:
            up[k] = further
        k = above
    return k


def _tied(label: np.ndarray, i: int, others: np.ndarray) -> list[int]:
    """Puts the sets of ``others`` into that of ``i``; returns one member of each set that was not in it."""
    sets, first = np.unique(label[others], return_index=True)
    new = sets != label[i]
    if new.any():
        label[np.isin(label, sets[new])] = label[i]
    return others[first[new]].tolist()


def hamming_forest(points: DataFrame, distance: int, most: int = 20_000) -> DataFrame:
    """As hamming_links, but of the links under each partition value only a spanning forest: the same components from fewer rows.

    Rows meet by partition value; the fingerprints of a value are compared in blocks, and what ties no further sets together isn't put out.
    A value that more than ``most`` points have or probe is cut into shards, and each shard of its points meets each shard of its probes in a
    cell of its own, so that no task holds an unbounded group.
    """
    spark = points.sparkSession
    tasks, scratch, search = int(spark.conf.get("spark.sql.shuffle.partitions")), Scratch(spark), Search(points, distance, 0.05)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part", "value", "cell"], 50_000):
            part, value, cell, probe, fp, node = (table[c].to_numpy() for c in ("part", "value", "cell", "probe", "fp", "node"))
            fp = fp.view(np.uint64)
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])])
            order = np.lexsort((probe, np.cumsum(fresh)))  # of each cell first the index, then the probes
            fp, node, probe = fp[order], node[order], probe[order]
            start = np.flatnonzero(fresh)
            ends = np.append(start[1:], len(node))
            mid = start + np.add.reduceat(~probe, start)
            two = (np.minimum.reduceat(node, start) < np.maximum.reduceat(node, start)) & (start < mid) & (mid < ends)
            start, mid, ends = start[two], mid[two], ends[two]
            pairs = (mid - start) * (ends - mid)
            up: dict[int, int] = {}
            a, b = [], []

            small = np.flatnonzero(pairs <= 10_000)
            total = np.cumsum(pairs[small])
            for at in np.split(small, np.searchsorted(total, np.arange(1_000_000, total[-1], 1_000_000))) if len(small) else ():  # cells whose pairs fit one block
                n_index, n_probe = (mid - start)[at], (ends - mid)[at]
                probes = np.repeat(mid[at], n_probe) + np.arange(n_probe.sum()) - np.repeat(np.cumsum(n_probe) - n_probe, n_probe)
                reps = np.repeat(n_index, n_probe)
                q, x = np.repeat(probes, reps), np.repeat(np.repeat(start[at], n_probe), reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                near = (np.bitwise_count(fp[q] ^ fp[x]) <= distance) & (node[q] != node[x])
                for u, v in zip(node[q[near]].tolist(), node[x[near]].tolist()):
                    ru, rv = _root(up, u), _root(up, v)
                    if ru != rv:
                        up[max(ru, rv)] = min(ru, rv)
                        a.append(u)
                        b.append(v)
            for lo, cut, hi in ((start[i], mid[i], ends[i]) for i in np.flatnonzero(pairs > 10_000)):
                names, own = np.unique(node[lo:hi], return_inverse=True)
                label, index = np.arange(len(names)), own[: cut - lo]
                for q in range(cut, hi):
                    near = np.flatnonzero((np.bitwise_count(fp[q] ^ fp[lo:cut]) <= distance) & (label[index] != label[own[q - lo]]))
                    if near.size:
                        for j in _tied(label, own[q - lo], index[near]):
                            a.append(node[q])
                            b.append(names[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    made = scratch.save(search.signatures(), "signatures")
    frequent = scratch.save(made.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > most), "frequent")
    shards = F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int")
    met = made.join(frequent, ["part", "value"], "left").withColumn("shards", shards).withColumn("own", F.pmod(F.xxhash64("node"), F.col("shards")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    cell = F.when(F.col("probe"), F.col("other") * F.col("shards") + F.col("own")).otherwise(F.col("own") * F.col("shards") + F.col("other"))
    met = met.select("part", "value", cell.cast("long").alias("cell"), "probe", "fp", "node")
    return met.repartition(tasks, "part", "value", "cell").sortWithinPartitions("part", "value", "cell").mapInArrow(run, "a long, b long")


def simhash_groups(df: DataFrame, size: int = 3, distance: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key (long), ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable over links.

    Texts without words, null ones included, have fingerprint zero and are linked like any other. Equal fingerprints are one
    point of the search, whatever their number; the links of each partition value come as a spanning forest, so that a dense
    ball of fingerprints isn't written out pair by pair. Rows that repeat a key with other texts are the same document, which
    ties their fingerprints. Rows with a null key are kept, each by its own fingerprint; their component is null if it holds
    no key at all. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    docs = scratch.save(simhashes(df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")), size, "text", "k"), "fingerprints")
    points = scratch.save(docs.groupBy("fp").agg(F.min("k").alias("k")), "points")
    links = hamming_forest(points.select("fp", F.col("fp").alias("node")), distance)
    several = docs.where("k is not null").groupBy("k").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    again = docs.join(several, "k").select(F.col("fp").alias("a"), "b").distinct()
    found = components(links.unionByName(again))
    sets = scratch.save(points.join(found, points["fp"] == found["node"], "left").select("fp", "k", F.coalesce("component", "fp").alias("c")), "sets")
    smallest = sets.groupBy("c").agg(F.min("k").alias("component_id"))
    out = docs.join(sets.select("fp", "c").join(smallest, "c"), "fp")
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
