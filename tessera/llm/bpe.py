"""Byte-level BPE encoding in linear time, and decoding.

All vocabulary entries that occur in a piece are found by one Aho-Corasick pass over its bytes, written as
Latin-1 characters. The encoder takes the longest entry at each place and goes back to shorter entries
where the token does not fit its neighbour. Two adjacent tokens fit if merging their joined bytes by rank
would leave the border between them; that is decided by undoing the merges of both along the border and is
memoised for each pair of tokens. A sequence whose neighbours all fit is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Sequence
from hashlib import sha256

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .pretokens import Splitter

#: Entries of a task's memo of pieces before it is emptied, and the longest piece that it holds.
MEMO, MEMO_CHARS = 400_000, 48
#: Bytes of a piece from which on its numbers are kept in arrays, which are slower and take a fifth of the memory of lists.
LONG = 4096
#: Entries of the memo of token pairs before it is emptied.
PAIRS = 600_000


class Vocabulary:
    """ranks: the bytes of each token -> its id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        #: Of each token, its length and the longest token that is a beginning of it; -1 without any.
        self.lengths = list(map(len, self.bytes))
        self.shorter = [-1] * self.size
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.fits_memo: dict[int, bool] = {}
        self.halves: list[tuple[int, int] | None] = [None] * self.size
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = self._split(token, rank)

    def _split(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; the token itself twice where it is never made so."""
        if len(token) == 1:
            return rank, rank
        parts = self._merged(token, rank)
        return (parts[0], parts[1]) if len(parts) == 2 else (rank, rank)

    def _merged(self, token: bytes, below: int) -> list[int]:
        """Merging by rank with the ranks under below; for the short strings of the vocabulary itself."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves the border between them."""
        key = left * self.size + right
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) >= PAIRS:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # From the last merge backwards: undo the younger of the two tokens at the border. A token at the
        # border exists from its own rank on until the merge that was undone before; a merge across the
        # border in that span would have come first. At equal ranks the leftmost merge comes first.
        limit = self.size
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    def encode_piece(self, piece: bytes) -> Sequence[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        size, fits, lengths, shorter = self.size, self.fits, self.lengths, self.shorter
        memo = self.fits_memo
        numbers = list if n < LONG else lambda x: array("q", x)
        choice = numbers([-1]) * n  # the next token to try at each place: the longest one first
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            choice[end - length + 1] = token  # of one place, longer ones come later
        tokens = numbers([])
        dead = bytearray(n + 1)  # places from which no fitting sequence reaches the end
        at = 0
        while at < n:
            last = tokens[-1] if tokens else -1
            token = choice[at]
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    ok = last < 0 or memo.get(last * size + token)
                    if ok is None:
                        ok = fits(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                choice[at] = token
                tokens.append(token)
                at = end
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks some single bytes")
                dead[at] = 1
                token = tokens.pop()
                at -= lengths[token]
                choice[at] = shorter[token]
        return tokens


class Pieces(dict):
    """Ids of pieces as little-endian bytes; computes and keeps those that are missing."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """encode(text) -> ids as little-endian unsigned 32-bit integers; decode is the inverse, to UTF-8 bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.memo = Pieces(self.vocabulary)
        self.pieces = Splitter(pattern).pieces

    @classmethod
    def of(cls, raw: bytes, pattern: str) -> Codec:
        """From the content of a rank file; a worker process keeps the vocabulary, not the memo."""
        key = hash(raw)
        if key not in _vocabularies:
            lines = (line.split() for line in raw.splitlines() if line.strip())
            _vocabularies.clear()
            _vocabularies[key] = Vocabulary({base64.b64decode(a): int(b) for a, b in lines})
        return cls(_vocabularies[key], pattern)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_vocabularies: dict[int, Vocabulary] = {}


def _broadcast(docs: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (or the columns keep) and token_ids, an array of integers, for every row of docs.

    vocabulary: the path of the rank file on the driver; its content (under a MB) goes to the executors as a
    broadcast. pattern: splits a text into the pieces that are encoded separately. NULL counts as an empty
    text: an empty array. Rows with equal or NULL ids each keep their own row.
    """
    raw = _broadcast(docs, vocabulary)

    def make():
        codec = Codec.of(raw.value, pattern)
        return lambda texts: [[np.frombuffer(codec.encode(t or ""), dtype="<u4").astype(np.int32) for t in texts]]

    return map_texts(docs, text_col, keep or [id_col], "token_ids array<int>", make)


def decode(tokens: DataFrame, vocabulary: str, keep: list[str], tokens_col: str = "token_ids") -> DataFrame:
    """The columns keep and text for every row of tokens; NULL tokens give an empty text.

    Ids that are not the encoding of valid UTF-8 give the replacement character; unknown ids raise.
    """
    raw = _broadcast(tokens, vocabulary)

    def make():
        decoded = Codec.of(raw.value, "").decode
        return lambda rows: [[decoded(np.array(r or [], dtype="<u4").tobytes()).decode("utf-8", "replace") for r in rows]]

    return map_texts(tokens, tokens_col, keep, "text string", make)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 for every row of docs; parameters and edge cases as in encode().

    The ids are decoded again, and decoded_sha256 is the digest of those bytes, not of the text.
    """
    raw = _broadcast(docs, vocabulary)

    def make():
        codec = Codec.of(raw.value, pattern)

        def work(texts):
            ids = [codec.encode(t or "") for t in texts]
            return (
                [len(x) // 4 for x in ids],
                [sha256(x).hexdigest() for x in ids],
                [sha256(codec.decode(x)).hexdigest() for x in ids],
            )

        return work

    return map_texts(docs, text_col, [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of round_trip() and token_ids, from one encoding of each text."""
    raw = _broadcast(docs, vocabulary)

    def make():
        codec = Codec.of(raw.value, pattern)

        def work(texts):
            ids = [codec.encode(t or "") for t in texts]
            return (
                [len(x) // 4 for x in ids],
                [sha256(x).hexdigest() for x in ids],
                [sha256(codec.decode(x)).hexdigest() for x in ids],
                [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids],
            )

        return work

    return map_texts(docs, text_col, [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>", make)
