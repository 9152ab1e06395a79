"""Token counts of a byte-level BPE vocabulary, without token identifiers in the result.

Each piece starts as the list of its bytes, kept as a doubly linked list. A heap holds the adjacent pairs
that the vocabulary merges; the pair of the lowest rank (leftmost first) is popped and merged until no pair
is left. A piece has as many tokens as it had bytes, less the merges. Counts of short pieces are memoised in
a table of bounded size for each task.
"""

from __future__ import annotations

import json
from array import array
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts
from .pretokens import Splitter

#: Entries of a task's memo table before it is emptied, and the longest piece that it holds.
MEMO, MEMO_CHARS = 400_000, 48

#: Bytes of a piece from which on its numbers are kept in arrays, which are slower and take a fifth of the memory of lists.
LONG = 4096
#: Bits of a place in a heap entry, which is rank << PLACE | place: one number for each pair.
PLACE = 40
#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, as character -> byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ranks of the mergeable pairs over small integers that stand for symbols."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        symbols = {bytes([b]): b for b in range(256)}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = symbols.setdefault(left, len(symbols)), symbols.setdefault(right, len(symbols))
            new = symbols.setdefault(left + right, len(symbols))
            self.pairs.setdefault(a << 32 | b, (rank, new))

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        look = self.pairs.get
        numbers = list if n < LONG else lambda x: array("q", x)
        symbol = numbers(iter(piece))
        heap = []
        for i in range(n - 1):
            found = look(symbol[i] << 32 | symbol[i + 1])
            if found is not None:
                heap.append(found[0] << PLACE | i)
        if not heap:
            return n
        heapify(heap)
        after = numbers(range(1, n + 1))
        before = numbers(range(-1, n - 1))
        merged, places = 0, (1 << PLACE) - 1
        while heap:
            entry = heappop(heap)
            rank, i = entry >> PLACE, entry & places
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            found = look(symbol[i] << 32 | symbol[j])
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            new = symbol[i] = found[1]
            symbol[j] = -1
            merged += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = look(new << 32 | symbol[k])
                if found is not None:
                    heappush(heap, found[0] << PLACE | i)
            if (h := before[i]) >= 0:
                found = look(symbol[h] << 32 | new)
                if found is not None:
                    heappush(heap, found[0] << PLACE | h)
        return n - merged


class Memo(dict):
    """Counts of pieces; computes and keeps those that are missing."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts tokens as the vocabulary file's library does, added tokens inside texts included."""

    def __init__(self, raw: str):
        spec = json.loads(raw)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = Merges([(to_bytes(a), to_bytes(b)) for a, b in pairs])
        self.memo = Memo(self.merges)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level vocabulary without normalizer and prefix space is needed")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        words = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, words))) if words else None
        self.first = words and {w[0] for w in words}
        self.words = words
        self.pieces = Splitter(PATTERN).pieces

    def count(self, text: str) -> int:
        look = self.memo.__getitem__
        if self.words and any(w in text for w in self.words):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(sum(map(look, self.pieces(p))) for p in parts)
        return sum(map(look, self.pieces(text)))


_counters: dict[int, Counter] = {}


def _counter(raw: str) -> Counter:
    """One counter for each worker process and vocabulary, with an empty memo."""
    key = hash(raw)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(raw)
    _counters[key].memo = Memo(_counters[key].merges)
    return _counters[key]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of docs.

    vocabulary: the path of the tokenizer's JSON file on the driver; its content (a few MB) goes to the
    executors as a broadcast. A NULL text counts as empty: no bytes, no tokens. Rows with equal or NULL ids
    each keep their own row. An empty table gives an empty result. Other columns of docs are not read.
    """
    spark: SparkSession = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def make():
        counter = _counter(raw.value)
        count = counter.count

        def work(texts):
            texts = [t or "" for t in texts]
            tokens = [count(t) for t in texts]
            return [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]

        work.done = counter.memo.clear
        return work

    return map_texts(docs, text_col, [id_col], "n_bytes long, n_tokens long, over_limit boolean", make)
