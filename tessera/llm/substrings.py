"""Substring dedup by prefix-partitioned suffix trees over word sequences.

The suffixes are sparse: of every ``window`` words in a row the place whose ``GRAM``-word hash is smallest is an anchor, so that equal windows
have their anchor at the same place. An anchor with the words around it, as far as windows have it for their anchor, is a stretch, and a
window's suffix ends where its stretch does. Anchors that only one document has are left out. The stretches are dealt out by prefix: the
anchor's own words, or, for an anchor with more than ``most`` stretches, all words of each window. So each group fits in memory and is put in
order there. The common prefixes of neighbours in that order are the depths of the tree's internal nodes: suffixes that no depth below
``window`` words parts stand under one deep node, and the node's smallest document is where their window starts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, bounded_batches, column_batches, release

GRAM = 4
_BLOCK = 1 << 15  # windows handled at once; a place in a block fits 16 bits
_words = re.compile(WORD).findall


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LONG = 64  # bytes from which a word is hashed by itself


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all words of the texts, one text behind the other, and where each text's begin.

    A word's code comes from sums over powers of a base along the bytes of all texts, so that no word is looked at by itself but long ones.
    """
    held = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(held)
    begin = np.cumsum([0] + [len(x) + 1 for x in held[:-1]]) if held else np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(18, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=sums[1:])
    codes = _stirred((sums[end] - sums[start]) * up[end - 1] + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for i in np.flatnonzero(end - start > _LONG):
        codes[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return codes, np.searchsorted(start, begin)


def chunks(rows: Iterable[tuple], text: int, most: int = 1 << 18) -> Iterator[list[tuple]]:
    """Rows in lists whose texts have about ``most`` code points together; a longer text comes alone."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[text]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[text])
    if held:
        yield held


def stretches(codes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of texts whose words' codes lie one text behind the other, from ``starts``.

    For each: the anchor's hash and place, the first window's place, the number of windows and the text's number. No window reaches
    over a text's end; fewer words than a window: none.
    """
    n, grams = len(codes) - window + 1, window - GRAM + 1
    none = np.empty(0, np.int64)
    if n < 1:
        return none.astype(np.uint64), none, none, none, none
    h = np.zeros(len(codes) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x9FB21C651E98DF25) + codes[j : j + len(h)]
    h = _stirred(h)
    places = []
    for at in range(0, n, _BLOCK):
        here = min(_BLOCK, n - at)
        key = h[at : at + here + grams - 1] & np.uint64(0xFFFFFFFFFFFF0000) | np.arange(here + grams - 1, dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            key, span = np.minimum(key[:-span], key[span:]), span * 2
        if rest := grams - span:
            key = np.minimum(key[:-rest], key[rest:])
        places.append((key & np.uint64(0xFFFF)).astype(np.int64) + at)
    place = np.concatenate(places)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(inside):
        return none.astype(np.uint64), none, none, none, none
    place = place[inside]
    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return h[place[head]], place[head], inside[head], np.diff(np.append(head, len(place))), owner[inside[head]]


def _rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """doc (the smallest long for null), v (a hash of the text, which tells rows of one key apart) and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(whole).alias("v"), whole.alias("text"))


def _shared_anchors(docs: DataFrame, window: int, most: int, scratch: Scratch) -> DataFrame:
    """doc, part -> at: the places of anchors that another document has too; -1 - place for anchors with more than ``most`` stretches.

    ``part`` is some bits of the text's hash, which deal out the rows of a frequent key; rows it doesn't tell apart share their places.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in column_batches(batches, "doc", "part", "text"):
            for rows in chunks(zip(*columns), 2):
                doc, part, texts = zip(*rows)
                codes, starts = word_codes(texts)
                anchor, place, _, _, owner = stretches(codes, starts, window)
                out = (anchor.view(np.int64), np.array(doc, np.int64)[owner], np.array(part, np.int16)[owner], (place - starts[owner]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["anchor", "doc", "part", "place"])

    found = docs.select("doc", _part(), "text").mapInArrow(run, "anchor long, doc long, part short, place int")
    rows = scratch.save(found, "anchors")
    shared = rows.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = scratch.save(shared.select("anchor", (F.col("n") > most).alias("many")), "shared")
    place = F.when(F.col("many"), -1 - F.col("place")).otherwise(F.col("place"))
    out = scratch.save(rows.join(shared, "anchor").select("doc", "part", place.alias("p")).groupBy("doc", "part").agg(F.collect_set("p").alias("at")), "places")
    scratch.drop(rows, shared)
    return out


def _part() -> Column:
    return F.pmod("v", F.lit(32749)).cast("short").alias("part")


_MADE = "content boolean, anchor long, low int, hash long, doc long, top long, v long, first int, n short, words binary"
_MADE_TYPES = (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
_HELD = 150_000  # stretches of a task that are gathered before equal ones become one


def _content_hashes(codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of codes, from sums over powers of a base modulo 2**64."""
    up, down = _powers(1 << max(18, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * down[: len(codes)], out=sums[1:])
    return _stirred((sums[start + size] - sums[start]) * up[start + size - 1] + size.astype(np.uint64))


def _stretch_rows(docs: DataFrame, window: int) -> DataFrame:
    """Rows of two sorts from documents with ``at``: every stretch (content false), and distinct stretches with their words and least and largest documents.

    A stretch's words are told by a 64-bit hash of them and by their anchor, of which every stretch holds the lower half.
    """

    def batch(count: int, **columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        names = [f.split()[0] for f in _MADE.split(", ")]
        return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(count, t) for c, t in zip(names, _MADE_TYPES)], names=names)

    def done(held: list[tuple], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor, start, first, n, doc, v, many = (np.concatenate(c) for c in zip(*held))
        flat = np.concatenate(codes)
        size = n + window - 1
        h = _content_hashes(flat, start, size)
        anchor = np.where(many, h, anchor).view(np.int64)
        h = h.view(np.int64)
        yield batch(len(h), content=np.zeros(len(h), bool), low=anchor.astype(np.int32), hash=h, doc=doc, v=v, first=first, n=n)
        order = np.lexsort((h, anchor))
        head = np.flatnonzero(np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (h[order][1:] != h[order][:-1])]))
        low, top = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
        one = order[head]
        ends = np.cumsum(size[one])
        at = np.repeat(start[one] - (ends - size[one]), size[one]) + np.arange(ends[-1])
        small = (flat >> np.uint64(32)).astype("<u4")[at]
        words = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(small)])
        yield batch(len(one), content=np.ones(len(one), bool), anchor=anchor[one], hash=h[one], doc=low, top=top, n=n[one], words=words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, rows, words = [], [], 0, 0
        for columns in column_batches(batches, "doc", "v", "text", "at"):
            for part in chunks(zip(*columns), 2):
                doc, v, texts, ats = zip(*part)
                own, starts = word_codes(texts)
                anchor, place, first, n, owner = stretches(own, starts, window)
                at, whose = np.array(list(chain.from_iterable(ats)), np.int64), np.repeat(np.arange(len(ats)), list(map(len, ats)))
                at, frequent = np.where(at < 0, -1 - at, at) + starts[whose], at < 0
                many = np.isin(place, at[frequent])
                pick = np.isin(place, at[~frequent]) | many
                anchor, first, n, owner, many = anchor[pick], first[pick], n[pick], owner[pick], many[pick]
                if many.any():  # each of their windows by itself
                    each = np.where(many, n, 1)
                    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    anchor, first, n, owner, many = np.repeat(anchor, each), np.repeat(first, each) + step, np.repeat(np.where(many, 1, n), each), np.repeat(owner, each), np.repeat(many, each)
                if len(anchor):
                    held.append((anchor, first + words, first - starts[owner], n, np.array(doc, np.int64)[owner], np.array(v, np.int64)[owner], many))
                    codes.append(own)
                    rows, words = rows + len(anchor), words + len(own)
                if rows >= _HELD:
                    yield from done(held, codes)
                    held, codes, rows, words = [], [], 0, 0
        if rows:
            yield from done(held, codes)

    return docs.select("doc", "v", "text", "at").mapInArrow(run, _MADE)


def _trees(contents: DataFrame, window: int, partitions: int) -> DataFrame:
    """Distinct stretches with the least document that holds them whole (``lo``) and the windows, as bits, that start in a smaller one still."""

    def solve(anchor: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, words: list[bytes]) -> pa.RecordBatch | None:
        # equal stretches of several tasks are one
        order = np.lexsort((lo, h, anchor))
        head = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (h[order][1:] != h[order][:-1])])
        start = np.flatnonzero(head)
        hi = np.maximum.reduceat(hi[order], start)
        order = order[start]
        anchor, h, lo, n = anchor[order], h[order], lo[order], n[order]
        # groups of one stretch have no node with two leaves
        alone = np.concatenate([[True], anchor[1:] != anchor[:-1]]) & np.concatenate([anchor[1:] != anchor[:-1], [True]])
        at = np.flatnonzero(~alone)
        mask = np.zeros(len(h), np.int64)
        if len(at):
            flat = np.frombuffer(b"".join(words[i] for i in order[at]), "<u4")
            size = n[at] + window - 1
            begin = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(at)), n[at])
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            left = size[owner] - offset  # words from the suffix's place to the stretch's end
            column = np.arange(left.max())
            suffix = np.zeros((len(owner), 2 + len(column)), ">u4")  # the prefix group first, then the words
            suffix[:, :2] = anchor[at][owner].astype(">i8").view(">u4").reshape(-1, 2)
            suffix[:, 2:] = np.where(column < left[:, None], flat[np.minimum((begin[owner] + offset)[:, None] + column, len(flat) - 1)], 0)
            ranks = np.argsort(np.ascontiguousarray(suffix).view(f"V{4 * suffix.shape[1]}").ravel(), kind="stable")
            # neighbours' common prefixes; where they have a window's words, both stand under one internal node of at least that depth
            common = suffix[ranks[1:]] == suffix[ranks[:-1]]
            depth = np.where(common.all(axis=1), common.shape[1], common.argmin(axis=1)) - 2
            depth = np.minimum(depth, np.minimum(left[ranks[1:]], left[ranks[:-1]]))
            node = np.flatnonzero(np.concatenate([[True], depth < window]))
            least = np.minimum.reduceat(lo[at][owner][ranks], node)
            first = np.empty(len(owner), np.int64)
            first[ranks] = np.repeat(least, np.diff(np.append(node, len(ranks))))
            np.bitwise_or.at(mask, at[owner], np.where(first < lo[at][owner], 1 << offset, 0))
        keep = (lo < hi) | (mask > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, h, lo, mask)], names=["anchor", "hash", "lo", "mask"]) if keep.any() else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = [table[c].to_numpy() for c in ("anchor", "hash", "doc", "top", "n")]
            if table.num_rows and (out := solve(*cols[:4], cols[4].astype(np.int64), table["words"].to_pylist())) is not None:
                yield out

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 12_000:
                table = pa.Table.from_batches(held)
                anchor = table["anchor"].to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # the last group may go on
                if cut:
                    yield from done(table.slice(0, cut))
                    held, rows = table.slice(cut).to_batches(), len(anchor) - cut
        if held:
            yield from done(pa.Table.from_batches(held))

    dealt = contents.select("anchor", "hash", "doc", "top", "n", "words").repartition(partitions, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, hash long, lo long, mask long")


def substring_dedup(df: DataFrame, window: int = 13, most: int = 20_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key (long), ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    A word goes if a window of ``window`` consecutive words over it also starts in a document with a smaller key; windows are judged on the
    input. A null or empty text, or one shorter than a window, loses nothing. Rows that repeat a key are one document, each with its own text; a null
    key is the smallest. An empty table gives an empty result; other columns are not read. ``most`` says when an anchor's group is split by
    longer prefixes; it changes no result. Words are compared by 64-bit codes for anchors and 32-bit codes within a group, rows of one
    key by 64-bit hashes of their texts.
    """
    if not GRAM < window <= GRAM + 60:
        raise ValueError(f"a window has {GRAM + 1} to {GRAM + 60} words")
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    docs = _rows(df, text, key)
    places = _shared_anchors(docs, window, most, scratch)
    release(spark)
    dealt = docs.withColumn("part", _part()).join(places, ["doc", "part"])
    made = scratch.save(_stretch_rows(dealt, window), "stretches", partition_by="content")
    scratch.drop(places)
    release(spark)
    nodes = scratch.save(_trees(made.where("content"), window, int(spark.conf.get("spark.sql.shuffle.partitions"))), "nodes")
    release(spark)
    nodes_of = nodes.select(F.col("anchor").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), "hash", "lo", "mask")
    where = made.where("not content").select((F.col("low").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), "hash", "doc", "v", "first", "n")
    where = where.join(nodes_of, ["low", "hash"])
    every = F.expr("shiftleft(1L, cast(n as int)) - 1")
    where = where.withColumn("bits", F.when(F.col("doc") > F.col("lo"), every).otherwise(F.col("mask"))).where("bits <> 0")
    gone = scratch.save(where.groupBy("doc", "v").agg(F.collect_set(F.struct("first", "bits")).alias("gone")), "gone")
    scratch.drop(made, nodes)
    release(spark)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts, gones in column_batches(batches, "doc", "text", "gone"):
            out = []
            for t, g in zip(texts, gones):
                words = _words(t)
                keep = words
                if g:
                    first, bits = np.array([(s["first"], s["bits"]) for s in g]).T
                    step = np.arange(int(bits.max()).bit_length())
                    start = (first[:, None] + step)[(bits[:, None] >> step & 1) == 1]
                    marks = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + window, minlength=len(words) + 1)
                    keep = list(compress(words, (np.cumsum(marks)[:-1] == 0).tolist()))
                kept = " ".join(keep)
                out.append((len(words), len(words) - len(keep), kept))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string())))], names=["doc", "n_words", "n_removed", "kept"])

    out = docs.join(gone, ["doc", "v"], "left").select("doc", "text", "gone").mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") > -(1 << 63), F.col("doc")).alias(key), "n_words", "n_removed", "kept")

