"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own measures and those of the lines before and after it;
neighbouring labels are tied by transition weights. The forward-backward marginals of "good", weighted by the
lines' lengths, add up to a document's share of good text, which a logistic curve turns into a score.

Training takes a bounded sample of labelled documents. A document's label is first given to all its lines; lines
of bad documents that look good by themselves then count as good, and the chains are fitted to these labels.
Measures are computed from the UTF-8 bytes of many lines at once; a long line is measured in stretches whose counts add up, so memory beside the
text is bounded by BLOCK and the number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, released
from .sampling import CHARS, held_out, labelled

#: Labelled documents that are fitted on, at most.
MOST = 6000
#: Bytes of text measured at a time, at most: counts of a stretch fit fields of 21 bits.
BLOCK = 1 << 20

#: Classes of bytes whose share of a line is a measure.
CLASSES = (
    b"|",
    b"!",
    b"#*$%&<>",
    b"~^=+\\{}_@[]`",
    b".",
    b",",
    b";:?\"'()-/",
    b"0123456789",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b" \t\r\x0b\x0c",
    bytes(range(128, 256)),
)
WIDTH = len(CLASSES) + 6


def _tables() -> list[np.ndarray]:
    """Byte -> counts of three classes in fields of 21 bits: a sum over BLOCK bytes does not overflow."""
    found = []
    for at in range(0, len(CLASSES), 3):
        t = np.zeros(256, np.int64)
        for field, chars in enumerate(CLASSES[at : at + 3]):
            t[np.frombuffer(chars, np.uint8)] += 1 << (21 * field)
        found.append(t)
    return found


_TABLES = _tables()
_SPACE = np.zeros(256, bool)
_SPACE[np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)] = True
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Totals of a line: bytes of each class, words equal to the one before and to the one before that, bytes of words, words, and short words.
SAME, AGAIN, INSIDE, WORDS, SHORT = range(len(CLASSES), len(CLASSES) + 5)

Carry = tuple[int, int, int]


def _words(part: np.ndarray, carry: Carry = (0, 0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, Carry]:
    """Starts, lengths and hashes of the words that end in a stretch, and the word that is open at its end.

    A word's hash comes from the sum of its mixed bytes and the sum of them times their places; an open word is
    carried as these two sums and its length so far.
    """
    space = _SPACE[part]
    before = np.concatenate(([carry[2] == 0], space[:-1]))
    a, b = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    if carry[2]:
        a = np.concatenate(([0], a))
    if len(b) < len(a):
        b = np.concatenate((b, [len(part)]))
    mixed = _MIX[part]
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    placed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * np.arange(len(part), dtype=np.uint64), dtype=np.uint64)))
    first = plain[b] - plain[a]
    second = placed[b] - placed[a] - first * a.astype(np.uint64)
    lengths = b - a
    if carry[2]:
        second[:1] += np.uint64(carry[1]) + np.uint64(carry[2]) * first[:1]
        first[:1] += np.uint64(carry[0])
        lengths[0] += carry[2]
    if len(part) and len(a) and not space[-1]:
        rest = (int(first[-1]), int(second[-1]), int(lengths[-1]))
        a, lengths, first, second = a[:-1], lengths[:-1], first[:-1], second[:-1]
    else:
        rest = (0, 0, 0)
    return a, lengths, second + first * _STEP, rest


def _classes(part: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """Adds the counts of each class from each start on to the rows of out."""
    for t, table in enumerate(_TABLES):
        packed = np.add.reduceat(table[part], starts)
        for field in range(3):
            out[:, 3 * t + field] += (packed >> (21 * field)) & ((1 << 21) - 1)


def _short_lines(part: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Totals of whole lines that lie in one stretch, each with its line feed."""
    n = len(starts)
    out = np.zeros((n, len(CLASSES) + 5))
    _classes(part, starts, out)
    a, lengths, hashes, _ = _words(part)
    line = np.searchsorted(starts, a, "right") - 1
    same = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    again = (hashes[2:] == hashes[:-2]) & (line[2:] == line[:-2])
    for column, of in ((SAME, line[1:][same]), (AGAIN, line[2:][again]), (WORDS, line), (SHORT, line[lengths <= 1])):
        out[:, column] = np.bincount(of, minlength=n)
    out[:, INSIDE] = np.bincount(line, weights=lengths, minlength=n)
    return out


def _long_line(data: np.ndarray) -> np.ndarray:
    """Totals of one line with its line feed, stretch by stretch."""
    out = np.zeros((1, len(CLASSES) + 5))
    carry, last = (0, 0, 0), np.zeros(0, np.uint64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        _classes(part, np.zeros(1, np.int64), out)
        _, lengths, hashes, carry = _words(part, carry)
        known, all_ = len(last), np.concatenate((last, hashes))
        out[0, SAME] += (all_[max(known, 1) :] == all_[max(known, 1) - 1 : -1]).sum() if len(all_) > 1 else 0
        out[0, AGAIN] += (all_[max(known, 2) :] == all_[max(known, 2) - 2 : -2]).sum() if len(all_) > 2 else 0
        out[0, [INSIDE, WORDS, SHORT]] += lengths.sum(), len(lengths), (lengths <= 1).sum()
        last = all_[-2:]
    return out


def _measures(totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    k = len(CLASSES)
    out = np.empty((len(totals), WIDTH))
    out[:, :k] = totals[:, :k] / np.maximum(sizes, 1)[:, None]
    words = totals[:, WORDS]
    some = np.maximum(words, 1)
    out[:, k], out[:, k + 1] = totals[:, SAME] / some, totals[:, AGAIN] / some
    out[:, k + 2] = np.minimum(totals[:, INSIDE] / some, 50) / 10
    out[:, k + 3] = np.log1p(words) / 5
    out[:, k + 4] = words == 0
    out[:, k + 5] = totals[:, SHORT] / some
    return out


class Lines:
    """The lines of some texts: lengths in bytes, the first line of each text, and what parts() measures."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(self.data == 10)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))
        self.first = np.searchsorted(self.starts, heads)
        self.lengths = (self.ends - self.starts).astype(np.float64)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """The number of a line, and the measures of it and some following lines."""
        at = 0
        while at < len(self.starts):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + BLOCK)))
            if self.ends[to - 1] + 1 - begin > BLOCK:
                totals = _long_line(self.data[begin : self.ends[at] + 1])
            else:
                totals = _short_lines(self.data[begin : self.ends[to - 1] + 1], self.starts[at:to] - begin)
            yield at, _measures(totals, self.lengths[at:to])
            at = to

    def evidence(self) -> np.ndarray:
        """Measures of each line, of the one before and of the one after (0 at a text's ends), and a constant."""
        out = np.zeros((len(self.starts), 3 * WIDTH + 1), np.float32)
        for at, found in self.parts():
            out[at : at + len(found), :WIDTH] = found
        out[1:, WIDTH : 2 * WIDTH], out[:-1, 2 * WIDTH : 3 * WIDTH] = out[:-1, :WIDTH], out[1:, :WIDTH]
        out[self.first, WIDTH : 2 * WIDTH] = 0
        out[self.last(), 2 * WIDTH : 3 * WIDTH] = 0
        out[:, -1] = 1
        return out

    def last(self) -> np.ndarray:
        return np.concatenate((self.first[1:], [len(self.starts)])) - 1

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """evidence() times the weights, without the evidence of all lines at once."""
        own, before, after = np.zeros((3, len(self.starts)))
        for at, found in self.parts():
            here = slice(at, at + len(found))
            own[here], before[here], after[here] = (found @ weights[:-1].reshape(3, WIDTH).T).T
        own += weights[-1]
        before, after = np.concatenate(([0], before[:-1])), np.concatenate((after[1:], [0]))
        before[self.first] = 0
        after[self.last()] = 0
        return own + before + after


class Chains:
    """Lines of many texts as chains, longest first, so that step t is a slice of those that have a line t."""

    def __init__(self, first: np.ndarray, total: int):
        sizes = np.diff(np.concatenate((first, [total])))
        order = np.argsort(-sizes, kind="stable")
        self.heads, self.sizes = first[order], sizes[order]
        self.steps = int(self.sizes[0]) if len(sizes) else 0
        self.alive = [int(np.searchsorted(-self.sizes, -t, "left")) for t in range(self.steps)]

    def marginals(self, logits: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line, expected transitions (2 x 2), and the log of the partition function.

        logits: evidence for good; ties: log weights of (label before, label).
        """
        n = len(logits)
        emit = np.stack((np.zeros(n), logits), axis=1)
        top = emit.max(axis=1, keepdims=True)
        emit = np.exp(emit - top)
        move = np.exp(ties - ties.max())
        forward, scale = np.empty((n, 2)), np.empty(n)
        backward = np.ones((n, 2))
        for t in range(self.steps):
            at = self.heads[: self.alive[t]] + t
            now = emit[at] * (forward[at - 1] @ move if t else 1.0)
            scale[at] = now.sum(axis=1)
            forward[at] = now / scale[at, None]
        for t in range(self.steps - 1, 0, -1):
            at = self.heads[: self.alive[t]] + t
            backward[at - 1] = ((emit[at] * backward[at]) @ move.T) / scale[at, None]
        marginal = forward * backward
        marginal /= marginal.sum(axis=1, keepdims=True)
        inner = np.ones(n, bool)
        inner[self.heads] = False
        at = np.flatnonzero(inner)
        pairs = forward[at - 1][:, :, None] * move[None] * (emit[at] * backward[at])[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        log_z = float(np.log(scale).sum() + top.sum() + len(at) * ties.max())
        return marginal[:, 1], pairs.sum(axis=0), log_z


def _shares(logits: np.ndarray, ties: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of each text, by length, that is good."""
    if not len(first):
        return np.zeros(0)
    good, _, _ = Chains(first, len(lengths)).marginals(logits, ties)
    weight = lengths + 1  # a text of empty lines has a length too
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


class Model:
    """weights of the evidence, ties of neighbouring labels, and the curve from good shares to scores."""

    def __init__(self, weights: np.ndarray, ties: np.ndarray, curve: tuple[float, float]):
        self.weights, self.ties, self.curve = weights, ties, curve

    def shares(self, lines: Lines) -> np.ndarray:
        return _shares(lines.logits(self.weights), self.ties, lines.first, lines.lengths)

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        slope, middle = self.curve
        found = [1 / (1 + np.exp(-slope * (self.shares(Lines(part)) - middle))) for part in _blocks(texts)]
        return np.concatenate(found) if found else np.zeros(0)


def _blocks(texts: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    """The texts in stretches of about BLOCK bytes."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def _fit_chain(evidence: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties that maximise the likelihood of the lines' labels good, by gradient steps with momentum (Adam)."""
    scale = np.maximum(evidence.std(axis=0), 0.01)
    scale[-1] = 1.0
    evidence = evidence / scale.astype(np.float32)
    chains = Chains(first, len(evidence))
    inner = np.ones(len(evidence), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[at - 1].astype(int), good[at].astype(int)), 1)
    size = evidence.shape[1]
    state, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, rounds + 1):
        p, pairs, _ = chains.marginals((evidence @ state[:size].astype(np.float32)).astype(float), state[size:].reshape(2, 2))
        gradient = np.concatenate((evidence.T @ (good - p).astype(np.float32), (seen - pairs).ravel())) / len(evidence) - decay * state
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        state = state + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return state[:size] / scale, state[size:].reshape(2, 2)


def _fit_curve(shares: np.ndarray, labels: np.ndarray, threshold: float) -> tuple[float, float]:
    """Slope and middle of the logistic curve: the best cut of the shares gets the score threshold."""
    order = np.argsort(shares, kind="stable")
    s, y = shares[order], labels[order]
    # a cut before place i calls the rest good; the cut with the fewest errors, in the middle of the widest such gap
    right = np.concatenate(([0], np.cumsum(np.where(y == 0, 1, -1))))
    padded = np.concatenate(([s[0] - 0.1], s, [s[-1] + 0.1]))
    best = np.flatnonzero(right == right.max())
    i = int(best[np.argmax(padded[best + 1] - padded[best])])
    low, high = (s[i - 1] if i else s[0] - 0.1), (s[i] if i < len(s) else s[-1] + 0.1)
    cut, slope = (low + high) / 2, 12.0
    return slope, float(cut - np.log(threshold / (1 - threshold)) / slope)


def fit(texts: Sequence[bytes], labels: np.ndarray, threshold: float = 0.7, rounds: int = 150, decay: float = 1e-4) -> Model:
    """A model from whole texts and labels (1: good). Without both kinds of label every text scores the same."""
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), (0.0, 0.0) if not len(labels) else (20.0, 1.0 - only))
    evidence, sizes, lengths = [], [], []
    for part in _blocks(texts):
        lines = Lines(part)
        evidence.append(lines.evidence())
        lengths.append(lines.lengths)
        sizes.append(np.diff(np.concatenate((lines.first, [len(lines.lengths)]))))
    evidence, lengths, sizes = np.concatenate(evidence), np.concatenate(lengths), np.concatenate(sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(labels.astype(float), sizes)
    # lines of bad documents that look good by themselves are good, if the document keeps a bad line
    own = evidence[:, [*range(WIDTH), 3 * WIDTH]]
    weights, _ = _fit_chain(own, np.arange(len(own)), of, rounds, decay)
    looks = 1 / (1 + np.exp(-(own @ weights)))
    worst = np.repeat(np.minimum.reduceat(looks, first), sizes)
    good = np.where((of == 0) & (looks > 0.5) & (looks > worst), 1.0, of)
    weights, ties = _fit_chain(evidence, first, good, rounds, decay)
    return Model(weights, ties, _fit_curve(_shares(evidence @ weights, ties, first, lengths), labels, threshold))


def trained(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MOST, most_chars: int = CHARS, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents whose id's CRC-32 modulo parts is not part: at most `most`, with at most most_chars characters in all."""
    rows = labelled(docs, labels, "quality", parts, part, most, most_chars, id_col, text_col).toPandas()
    rows = rows.assign(raw=[(t or "").encode() for t in rows.pop("__text")]).sort_values("raw", kind="stable")
    found = fit(rows["raw"].tolist(), rows["__label"].to_numpy(), threshold)
    del rows
    released()  # the driver lives on
    return found


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most: int = MOST, most_chars: int = CHARS, parts: int = 4, part: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    Labels (id, quality) teach only where the id's CRC-32 modulo parts is not part; held_out marks the others.
    predicted is 1 from the threshold on. Only the text enters a score. NULL counts as an empty text: one
    empty line, scored like any other; texts and lines may be of any length. Rows with equal or NULL ids each keep their own row; a NULL id is not
    held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, threshold, most, most_chars, parts, part, id_col, text_col))

    def make():
        return lambda texts: [model.value.scores([(t or "").encode() for t in texts])]

    found = map_texts(docs, text_col, [id_col], "__score double", make)
    return found.select(
        F.col(f"`{id_col}`"), held_out(f"`{id_col}`", parts, part).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fitting) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold; parameters as in scored()."""
    text_col = fitting.get("text_col", "text")
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, threshold, **fitting))

    def make():
        return lambda texts: [model.value.scores([(t or "").encode() for t in texts]) >= threshold]

    return map_texts(docs, text_col, docs.columns, "__good boolean", make, drop_where_false="__good")
