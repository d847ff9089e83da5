"""Token counts by byte-pair merging, without making tokens.

A pre-token starts as a doubly linked list of its bytes' symbols. A heap holds the adjacent pairs
that have a merge, keyed by rank and then position; popping the lowest and merging it renews the
two pairs at its sides. The count is the number of initial symbols minus the number of merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, column_batches

#: What the regular expressions of the tokenizer files take as white space.
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of texts for a word-level BPE file: NFC, lower case, white space dropped, word-end marks.

    Special strings inside a text count as one token each. The counts of at most ``chunks`` stretches between
    white space and ``words`` pre-tokens are remembered; ones longer than ``longest`` are counted afresh each time.
    """

    def __init__(self, path: str, chunks: int = 150_000, words: int = 600_000, longest: int = 48):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a BPE file with word-end marks is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"], regex.V0).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        symbols = _byte_symbols()
        self.inner, self.last = [vocab[s] for s in symbols], [vocab[s + end] for s in symbols]
        self.bits = len(vocab).bit_length()
        self.low = (1 << self.bits) - 1
        self.merges: dict[int, int] = {}  # left and right symbol -> rank and merged symbol
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << self.bits | vocab[b], rank << self.bits | vocab[a + b])
        self.most_chunks, self.most_words, self.longest = chunks, words, longest
        self.counts: dict[str, int] = {}
        self.word_counts: dict[str, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(word)
        if n < 2:
            return n
        sym = [self.inner[b] for b in word]
        sym[-1] = self.last[word[-1]]
        bits, low, find = self.bits, self.low, self.merges.get
        heap = []
        for i in range(n - 1):
            m = find(sym[i] << bits | sym[i + 1])
            if m is not None:
                heap.append(m >> bits << 40 | i)
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            e = heappop(heap)
            i = e & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0:
                continue
            m = find(sym[i] << bits | sym[j])
            if m is None or m >> bits != e >> 40:
                continue  # a side has changed since the pair was pushed
            sym[i], sym[j] = m & low, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = find(sym[i] << bits | sym[k])
                if m is not None:
                    heappush(heap, m >> bits << 40 | i)
            h = before[i]
            if h >= 0:
                m = find(sym[h] << bits | sym[i])
                if m is not None:
                    heappush(heap, m >> bits << 40 | h)
        return left

    def _plain(self, chunk: str) -> int:
        if not chunk.isascii():
            # lower case letter by letter, so that a sigma at a word's end gets no form of its own
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        chunk = chunk.lower()
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk)
        return sum(map(self.word, self.split(chunk)))

    def word(self, word: str) -> int:
        """Tokens of one pre-token, remembered."""
        k = self.word_counts.get(word)
        if k is None:
            k = self.merged(word.encode("utf-8", "surrogatepass"))
            if len(word) <= self.longest:
                if len(self.word_counts) >= self.most_words:
                    self.word_counts.clear()
                self.word_counts[word] = k
        return k

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without white space."""
        if self.special is not None and "<|" in chunk:
            parts = self.special.split(chunk)
            return len(parts) - 1 + sum(map(self._plain, filter(None, parts)))
        return self._plain(chunk)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, counts = 0, self.counts
        for c in _CHUNK.findall(text):
            k = counts.get(c)
            if k is None:
                k = self.chunk(c)
                if len(c) <= self.longest:
                    if len(counts) >= self.most_chunks:
                        counts.clear()
                    counts[c] = k
            total += k
        return total


_counters: dict[str, MergeCounter] = {}


def _counter(path: str) -> MergeCounter:
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", over: int = 2048) -> DataFrame:
    """One row per input row: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``over`` tokens).

    A null text counts as empty (0 bytes, 0 tokens); null keys and repeated rows pass through one for one;
    an empty table gives an empty result; other columns are not read. ``tokenizer`` is the file's path,
    readable on every executor. No shuffle; a worker holds one Arrow batch and the counts of remembered chunks.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = rows.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
