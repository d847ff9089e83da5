"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

The automaton holds all pieces. Read once from left to right, it reports at each position, by its output links, every piece that
ends there; each relaxes the best score of that position (Viterbi). A character that no piece holds becomes bytes, or the unknown piece.
The result is the segmentation of the greatest total score, the leftmost longest last piece among equals, whatever the kind of model.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import bounded_batches

#: Fixed values of the model format: the space mark, the piece kinds that text may match, bytes, and the cost of an unknown character.
SPACE, NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE, PENALTY = "▁", 1, 2, 3, 4, 5, 6, 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    at = 0
    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 5:
            yield tag >> 3, data[at : at + 4]
            at += 4
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        else:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces, with ``encode`` and ``decode``.

    Models with a character map or that collapse white space are refused, as is one in which a space mark follows another character
    within a piece: texts are cut before such marks, and the ids of at most ``remembered`` cuts of up to ``longest`` characters are kept.
    """

    def __init__(self, path: str, remembered: int = 250_000, longest: int = 40):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in fields:
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode("utf-8"))
                self.scores.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(own.get(3, NORMAL))
        norm = dict(_fields(next((v for n, v in fields if n == 3), b"")))
        if norm.get(2) or norm.get(4, 1):
            raise ValueError("the model rewrites texts before it cuts them")
        self.prefix = SPACE if norm.get(3, 1) else ""
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER, UNUSED)]
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in usable):
            raise ValueError("a piece holds a space mark inside")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.low = min((self.scores[i] for i in usable), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), self.scores[i], i))
        self.automaton.make_automaton()
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.remembered, self.longest, self.known = remembered, longest, {}

    def segment(self, cut: str) -> array:
        """The ids of the best path through one cut."""
        n = len(cut)
        best, came, used = [0.0] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        at = 0  # positions up to here are final but for matches still to come

        def bridge(to: int) -> None:
            # a position that no piece reaches is reached by the one character before it
            nonlocal at
            while at < to:
                at += 1
                if best[at] is None:
                    best[at], came[at] = best[at - 1] + self.low, at - 1

        for end, (size, score, i) in self.automaton.iter(cut):
            end += 1
            bridge(end - 1)
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], came[end], used[end] = total, end - size, i
        bridge(n)
        out, end = [], n
        while end:
            start = came[end]
            if used[end] >= 0:
                out.append(used[end])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(cut[start:end].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            end = start
        out.reverse()
        return array("i", out)

    def encode(self, text: str | None) -> array:
        """The ids of a text, without any for its beginning or end; none for an empty text."""
        out = array("i")
        if not text:
            return out
        known = self.known
        for cut in self.cut(self.prefix + text.replace(" ", SPACE)):
            ids = known.get(cut)
            if ids is None:
                ids = self.segment(cut)
                if len(cut) <= self.longest:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[cut] = ids
            out.extend(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes are joined and read as UTF-8, the mark put before the text is taken away again."""
        ids = list(ids)
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            text = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.surface[i].encode() for i in ids).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_models: dict[str, Pieces] = {}


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _per_text(df: DataFrame, text: str, key: str, schema: str, row: Callable[[Pieces, str], tuple], names: list[str], kinds: list[pa.DataType], path: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            rows = [row(model, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["key", *names])

    return df.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``ids`` (array of int) and ``n_pieces``. Null and empty texts have no ids; nothing is cut off.

    Null keys and repeated rows pass through, an empty table gives an empty result, other columns are not read. No shuffle; ``path`` must be readable on every executor.
    """
    return _per_text(df, text, key, "ids array<int>, n_pieces long", lambda m, t: ((ids := np.frombuffer(m.encode(t), np.int32)), len(ids)), ["ids", "n_pieces"], [pa.list_(pa.int32()), pa.int64()], path)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key and ``text``, the text of its ids; null or no ids give an empty text."""
    return _per_text(df, ids, key, "text string", lambda m, t: (m.decode(t or []),), ["text"], [pa.string()], path)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``n_pieces``, ``ids_sha256`` (of the ids as little-endian 32-bit numbers), ``decoded_sha256`` (of the decoded text) and ``same``,
    whether decoding gave the text back. A null text is empty."""

    def row(model: Pieces, t: str | None) -> tuple:
        ids = model.encode(t)
        back = model.decode(ids)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == (t or "")

    return _per_text(df, text, key, "n_pieces long, ids_sha256 string, decoded_sha256 string, same boolean", row, ["n_pieces", "ids_sha256", "decoded_sha256", "same"], [pa.int64(), pa.string(), pa.string(), pa.bool_()], path)


def encode_rows(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``ids``, ``n_pieces`` and ``same`` (decoding gives the text back) in the place of any such columns, and without its text."""
    bounded_batches(df.sparkSession)
    rows = df.drop(*[c for c in df.columns if c in ("ids", "n_pieces", "same")])
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            texts = b.column(len(others)).to_pylist()
            ids = [model.encode(t) for t in texts]
            found = [pa.array([np.frombuffer(i, np.int32) for i in ids], pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array([model.decode(i) == (t or "") for i, t in zip(ids, texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], *found], names=[*others, "ids", "n_pieces", "same"])

    more = [StructField("ids", ArrayType(IntegerType())), StructField("n_pieces", LongType()), StructField("same", BooleanType())]
    kept = rows.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    return kept.mapInArrow(run, StructType([*(df.schema[c] for c in others), *more]))
