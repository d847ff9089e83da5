"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Points first meet others in the leaves of a few random-projection trees. Then, round by round, each point's neighbours and the
points that have it as a neighbour are brought together by Spark joins and compared with each other, pairs of which one is new;
what comes nearer than a point's worst neighbour takes its place. A query starts at its own node and the nearest of some entry points and expands the best
points it knows, several a round, until none of its best is unexpanded. All of this measures the vectors as they are given, in double precision,
so that near copies and large components are told apart as in the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, few_files, release, whole_groups

_LIST = "node long, ids array<bigint>, ds array<double>, fresh array<boolean>"


def usable_vectors(df: DataFrame, vector: str, key: str) -> DataFrame:
    """id and v (array of float if given so, else of double) of the vectors that take part: not null, not zero, all components finite, of the most common length."""
    v = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("v") == F.col("n")).select("id", "v")


def _packed(v: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Rows of numbers as a matrix of doubles and as bytes of their own type."""
    m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    return m.astype(np.float64), pa.array([r.tobytes() for r in m], pa.binary())


def _kind(points: DataFrame) -> type:
    """The type of the components, in which vectors travel."""
    return np.float32 if points.schema["v"].dataType.simpleString() == "array<float>" else np.float64


def _matrix(rows: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    held = rows.to_pylist()
    return np.frombuffer(b"".join(held), kind).reshape(len(held), -1).astype(np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of doubles: expanded around the mean of ``b``, and from the differences where the expansion cancels."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    scale = int(np.frexp(most)[1])  # a power of two, so that nothing is rounded
    a, b = np.ldexp(a, -scale), np.ldexp(b, -scale)
    middle = b.mean(axis=0)
    x, y = a - middle, b - middle
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d = size - 2 * (x @ y.T)
    i, j = np.nonzero(d < 1e-7 * size)
    for at in range(0, len(i), 1 << 15):
        few = slice(at, at + (1 << 15))
        d[i[few], j[few]] = ((a[i[few]] - b[j[few]]) ** 2).sum(1)
    return np.ldexp(np.sqrt(np.maximum(d, 0)), scale)


def _blocks(m: np.ndarray, most: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Row numbers in blocks of at most ``most``, halved at the median of a random projection around their mean, however near they lie."""
    todo, out = [np.arange(len(m))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        own = m[at] - m[at[0]]
        own = (own - own.mean(axis=0)) @ draw.standard_normal(m.shape[1])
        order = at[np.argsort(own, kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return out


def _lists(node: list, ids: list, ds: list, fresh: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((node, ids, ds, fresh), kinds)], names=["node", "ids", "ds", "fresh"])


def _leaves(points: DataFrame, n: int, k: int, trees: int, leaf: int, parts: int, most: int) -> DataFrame:
    """Lists of each point's nearest within its leaf of each tree; leaves of over twice ``leaf`` points are halved further, each tree's its own way.

    A leaf of more than ``most`` points, as a tight group makes, is first dealt out by hash to leaves that one task can hold; the rounds bring
    its points together again.
    """
    kind, planes = _kind(points), max(0, math.ceil(math.log2(max(n / leaf, 1))))
    sample = np.array([r.v for r in points.select("v").orderBy(F.xxhash64("node")).limit(2000).collect()])
    turn = np.random.default_rng(11).standard_normal((trees, sample.shape[1], planes))
    middle = [np.median(sample @ turn[t], axis=0) for t in range(trees)]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, h = _packed(b.column(1))
            for t in range(trees):
                code = ((m @ turn[t] > middle[t]) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(m), np.int64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code + (t << 40)), b.column(0), h], names=["leaf", "node", "h"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["leaf", "share"], 2000):
            code, share, node, m = table["leaf"].to_numpy(), table["share"].to_numpy(), table["node"].to_numpy(), _matrix(table["h"], kind)
            start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (share[1:] != share[:-1])]))
            for lo, hi in zip(start, np.append(start[1:], len(code))):
                for at in _blocks(m[lo:hi], 2 * leaf, np.random.default_rng(int(code[lo]))):
                    at = lo + at
                    if len(at) < 2:
                        continue
                    d = _distances(m[at], m[at])
                    np.fill_diagonal(d, np.inf)
                    near = np.argsort(d, axis=1)[:, : min(k, len(at) - 1)]
                    yield _lists(node[at].tolist(), list(node[at][near]), list(np.take_along_axis(d, near, 1)), list(np.ones(near.shape, bool)))

    dealt = points.select("node", "v").mapInArrow(deal, "leaf long, node long, h binary")
    large = dealt.groupBy("leaf").agg(F.count("*").alias("c")).where(F.col("c") > most).select("leaf", F.ceil(F.col("c") / most).alias("shares"))
    share = F.pmod(F.xxhash64("node", "leaf"), F.coalesce("shares", F.lit(1))).alias("share")
    dealt = dealt.join(large, "leaf", "left").select("leaf", share, "node", "h").repartition(parts, "leaf", "share")
    return dealt.sortWithinPartitions("leaf", "share", F.xxhash64("node")).mapInArrow(meet, _LIST)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list per node: the k nearest of all its lists, each neighbour once; one that was known is not fresh."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [])
            for node, own in zip(b.column(0).to_pylist(), b.column(1)):
                v = own.values
                ids, ds, fresh = (v.field(f).flatten().to_numpy(zero_copy_only=False) for f in ("ids", "ds", "fresh"))
                order = np.lexsort((fresh, ids))
                ids, ds, fresh = ids[order], ds[order], fresh[order]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
                best = first[np.lexsort((ids[first], ds[first]))[:k]]
                for c, x in zip(out, (node, ids[best], ds[best], fresh[best])):
                    c.append(x)
            yield _lists(*out)

    return lists.groupBy("node").agg(F.collect_list(F.struct("ids", "ds", "fresh")).alias("lists")).mapInArrow(run, _LIST)


def _round(graph: DataFrame, packed: DataFrame, kind: type, k: int, parts: int) -> DataFrame:
    """What the points learn in one round: lists of new neighbours."""
    edges = graph.select(F.col("node").alias("center"), F.explode(F.arrays_zip("ids", "ds", "fresh")).alias("x")).select("center", F.col("x.ids").alias("member"), F.col("x.ds").alias("d"), F.col("x.fresh").alias("fresh"))
    nearest = Window.partitionBy("member").orderBy(F.desc("fresh"), "d", "center")
    ranked = edges.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= 3 * k)
    back = ranked.where(F.col("r") <= k).select(F.col("member").alias("center"), F.col("center").alias("member"), "fresh")
    both = ranked.select("center", "member", "fresh").unionByName(back).groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    worst = graph.select("node", F.when(F.size("ds") >= k, F.array_max("ds")).otherwise(F.lit(float("inf"))).alias("worst"))
    told = both.join(packed, F.col("member") == F.col("node")).drop("node").join(worst, F.col("member") == F.col("node")).drop("node")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["center"], 4000):
            center, member, fresh, worst = (table[c].to_numpy() for c in ("center", "member", "fresh", "worst"))
            m = _matrix(table["h"], kind)
            start = np.flatnonzero(np.concatenate([[True], center[1:] != center[:-1]]))
            out = ([], [], [], [])
            for lo, hi in zip(start, np.append(start[1:], len(center))):
                if not fresh[lo:hi].any() or hi - lo < 2:
                    continue
                d = _distances(m[lo:hi], m[lo:hi])
                d[~(fresh[lo:hi, None] | fresh[None, lo:hi])] = np.inf
                np.fill_diagonal(d, np.inf)
                d[d >= worst[lo:hi, None]] = np.inf
                near = np.argsort(d, axis=1)[:, :10]  # a center tells each member of its ten nearest at most
                dist = np.take_along_axis(d, near, 1)
                for i in np.flatnonzero(np.isfinite(dist[:, 0])):
                    n = int(np.isfinite(dist[i]).sum())
                    for c, x in zip(out, (member[lo + i], member[lo + near[i, :n]], dist[i, :n], np.ones(n, bool))):
                        c.append(x)
            if out[0]:
                yield _lists(*out)

    return told.select("center", "member", "fresh", "worst", "h").repartition(parts, "center").sortWithinPartitions("center").mapInArrow(meet, _LIST)


def nn_descent(points: DataFrame, k: int = 32, trees: int = 8, leaf: int = 250, rounds: int = 10, enough: float = 0.005, most: int = 4_000) -> DataFrame:
    """``points`` (node: distinct long, v: distinct arrays of double) -> node, ids, ds, fresh: the k nearest found, nearest first.

    Ends after ``rounds``, or when a round renews less than the share ``enough`` of all entries. Reverse neighbours are taken up to a
    bound, as NN-descent has it. Every round is written to the shared folder. ``most``: the points of a leaf that one task holds.
    """
    spark = points.sparkSession
    bounded_batches(spark)
    scratch, parts, n = Scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), points.count()
    if not n:
        return spark.createDataFrame([], _LIST)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(b.column(1))[1]], names=["node", "h"])

    packed = scratch.save(points.select("node", "v").mapInArrow(pack, "node long, h binary"), "packed")
    graph = scratch.save(few_files(_merged(_leaves(points, n, k, trees, leaf, parts, most), k), n, 500), "leaves")
    for i in range(rounds):
        known = graph.select("node", "ids", "ds", F.transform("ids", lambda _: F.lit(False)).alias("fresh"))
        after = scratch.save(few_files(_merged(known.unionByName(_round(graph, packed, _kind(points), k, parts)), k), n, 500), f"round{i}")
        scratch.drop(graph)
        graph = after
        release(spark)
        renewed = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if renewed < enough * n * k:
            break
    scratch.drop(packed)
    return graph


def greedy_search(points: DataFrame, graph: DataFrame, queries: DataFrame, k: int, beam: int = 384, step: int = 32, entries: int = 1024, rounds: int = 40) -> DataFrame:
    """``queries`` (q: distinct long, a node of the graph; v) -> q, node, d: the k nearest points found, d in double precision on the original vectors.

    A query starts at its own node, so that it reaches its own group however many groups there are, and at the nearest of a sample of entry points.
    The search graph has the edges of ``graph`` both ways, those back up to a bound. Each round a query expands the ``step`` nearest of its ``beam``
    nearest points that it hasn't expanded yet; queries with none left are done.
    """
    spark = points.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    start = points.orderBy(F.xxhash64("node"), "node").limit(entries).collect()  # entry points: a bounded sample
    gate, gate_m = np.array([r.node for r in start], np.int64), np.array([r.v for r in start], np.float64)
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "ds")).alias("x")).select("node", F.col("x.ids").alias("other"), F.col("x.ds").alias("d"))
    back = edges.withColumn("r", F.row_number().over(Window.partitionBy("other").orderBy("d", "node"))).where("r <= 32").select(F.col("other").alias("node"), F.col("node").alias("other"))
    ways = edges.select("node", "other").unionByName(back).distinct()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(b.column(1))[1]], names=["p", "h"])

    packed, kind = scratch.save(points.select("node", "v").mapInArrow(pack, "p long, h binary"), "packed"), _kind(points)
    around = scratch.save(ways.groupBy("node").agg(F.collect_list("other").alias("near")), "around")
    state_type = "q long, h binary, ids array<bigint>, ds array<double>, done array<boolean>"

    def states(q: list, h: list, ids: list, ds: list, done: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((q, h, ids, ds, done), kinds)], names=["q", "h", "ids", "ds", "done"])

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, h = _packed(b.column(1))
            d = _distances(m, gate_m)
            d[b.column(0).to_numpy()[:, None] == gate] = np.inf  # the query's own node comes first
            near = np.argsort(d, axis=1)[:, : beam - 1]
            near = [x[np.isfinite(own[x])] for x, own in zip(near, d)]
            q = b.column(0).to_pylist()
            yield states(q, h.to_pylist(), [np.append(i, gate[x]) for i, x in zip(q, near)], [np.append(0, own[x]) for own, x in zip(d, near)], [np.zeros(len(x) + 1, bool) for x in near])

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [], [])
            for q, h, ids, ds, done, found in zip(*(b.column(i) for i in range(6))):
                ids, ds, done = (x.values.to_numpy(zero_copy_only=False) for x in (ids, ds, done))
                own = np.frombuffer(h.as_py(), kind).astype(np.float64)
                open_ = np.flatnonzero(~done)[:step]
                done = done.copy()
                done[open_] = True
                if found.is_valid and len(found.values):
                    other, h_other = (found.values.field(i) for i in (0, 1))
                    ids, done = np.concatenate([ids, other.to_numpy()]), np.concatenate([done, np.zeros(len(other), bool)])
                    ds = np.concatenate([ds, _distances(own[None], _matrix(h_other, kind))[0]])
                    best = np.lexsort((ids, ds))[:beam]
                    ids, ds, done = ids[best], ds[best], done[best]
                for c, x in zip(out, (q.as_py(), h.as_py(), ids, ds, done)):
                    c.append(x)
            yield states(*out)

    asked = queries.count()
    state = scratch.save(few_files(queries.select("q", "v").mapInArrow(enter, state_type), asked, 50), "start")
    for i in range(rounds):
        unseen = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda x: ~x["done"]), 1, step)
        ask = state.select("q", F.explode(F.transform(unseen, lambda x: x["ids"])).alias("node"))
        if ask.isEmpty():
            break
        met = ask.join(around, "node").select("q", F.explode("near").alias("p")).distinct()
        new = met.join(state.select("q", F.explode("ids").alias("p")), ["q", "p"], "left_anti")  # vectors travel for these alone
        told = new.join(packed, "p").groupBy("q").agg(F.collect_list(F.struct("p", "h")).alias("found"))
        after = state.join(told, "q", "left").select("q", "h", "ids", "ds", "done", "found").mapInArrow(expand, state_type)
        after = scratch.save(few_files(after, asked, 50), f"hop{i}")
        scratch.drop(state)
        state = after
    near = state.select("q", F.explode("ids").alias("node")).join(points, "node").join(queries.select(F.col("q").alias("q2"), F.col("v").alias("qv")), F.col("q") == F.col("q2"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "qv", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    order = Window.partitionBy("q").orderBy("d", "node")
    return near.select("q", "node", d.alias("d")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "node", "d")


def nearest_vectors(df: DataFrame, queries_where, k: int = 10, vector: str = "embedding", key: str = "vec_id", **graph_options) -> DataFrame:
    """For each row whose key satisfies ``queries_where`` (a function of the id column), its ``k`` nearest other rows found.

    Columns query_id, rank (from 1), vec_id, score (Euclidean distance in double precision); ties go to the smaller id. Vectors that are
    null, zero, of an odd length or hold null or non-finite components take no part, neither do null keys. Equal vectors are one point of
    the graph, whatever their number; of each the k + 1 smallest ids can come up, which are all that a result may name. Fewer than k others: all
    of them. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(usable_vectors(df, vector, key).distinct(), "vectors")
    points = scratch.save(rows.groupBy("v").agg(F.min("id").alias("node")), "points")
    known = rows.join(points, "v").select("node", "id")
    smallest = known.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("node", "id")
    members = scratch.save(smallest, "members")
    asked = scratch.save(known.where(queries_where(F.col("id"))), "asked")
    graph = nn_descent(points, **graph_options)
    queries = asked.select("node").distinct().join(points, "node").select(F.col("node").alias("q"), "v")
    found = greedy_search(points, graph, queries, k + 1)
    order = Window.partitionBy("q").orderBy("d", "id")
    named = found.join(members, "node").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    per = named.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("near"))
    pairs = asked.join(per, F.col("node") == F.col("q"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return pairs.select(F.col("id").alias("query_id"), "near").select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
